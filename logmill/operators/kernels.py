"""Classic analytics kernels as DataFrame queries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.functions.text import shift_letters, words

#: The words that the string match looks for.
TARGET_WORDS = ("Helloworld", "howareyou", "ferrari", "whotheman")

#: Bytes of a matrix of points, and of a task's points.
BLOCK, PART = 1 << 19, 64 << 20


def word_count(texts: DataFrame, column: str = "text") -> DataFrame:
    """``word, n``: runs of ASCII letters, upper-cased, over all texts."""
    return texts.select(F.explode(words(F.col(column))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def top_words(texts: DataFrame, n: int, column: str = "text") -> DataFrame:
    return word_count(texts, column).orderBy(F.desc("n"), "word").limit(n)


def word_positions(texts: DataFrame, doc: str, column: str = "text") -> DataFrame:
    """``word, doc, pos``: every occurrence; ``pos`` is the word's number in its text, from 0."""
    return texts.select(F.col(doc).alias("doc"), F.posexplode(words(F.col(column))).alias("pos", "word")).select("word", "doc", "pos")


def inverted_index(texts: DataFrame, doc: str, column: str = "text") -> DataFrame:
    """``word, doc, positions``: a posting per word and document, so no list grows with the corpus.

    A document in one row has its postings made there, from one sort of its words;
    only rows of documents that come more than once are shuffled.
    """
    rows = texts.select(F.col(doc).alias("doc"), F.col(column).alias("_text"))
    again = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc")
    if again.isEmpty():
        return _postings(rows)
    several = word_positions(rows.join(again, rows.doc.eqNullSafe(again.doc), "left_semi"), "doc", "_text")
    grouped = several.groupBy("word", "doc").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return _postings(rows.join(again, rows.doc.eqNullSafe(again.doc), "left_anti")).unionByName(grouped)


def _postings(rows: DataFrame) -> DataFrame:
    """``word, doc, positions`` of each row (doc, _text) by itself."""
    placed = rows.select("doc", F.sort_array(F.transform(words(F.col("_text")), lambda w, i: F.struct(w.alias("word"), i.alias("pos")))).alias("_p"))
    word = lambda i: F.get("_p", i)["word"]
    edge = F.filter(F.sequence(F.lit(0), F.size("_p")), lambda i: (i == 0) | (i == F.size("_p")) | (word(i) != word(i - 1)))
    placed = placed.where(F.size("_p") > 0).withColumn("_e", edge)
    runs = F.transform(F.slice("_e", F.lit(1), F.size("_e") - 1), lambda i, k: F.struct(word(i).alias("word"), F.transform(F.slice("_p", i + 1, F.get("_e", k + 1) - i), lambda x: x["pos"]).alias("positions")))
    return placed.select("doc", F.explode(runs).alias("_r")).select("_r.word", "doc", "_r.positions")


def histogram(values: DataFrame, channel: str | Column, value: str | Column, weight: str | None = None) -> DataFrame:
    """``channel, value, n``."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return values.groupBy(as_column(channel).alias("channel"), as_column(value).alias("value")).agg(n.alias("n"))


def channel_key(channel: Column, value: Column) -> Column:
    """Numeric key of a bitmap count: 1000 + blue, 2000 + green, 3000 + red."""
    return F.when(channel == "B", 1000 + value).when(channel == "G", 2000 + value).otherwise(3000 + value)


def linear_regression(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: n, the five sums, intercept a, slope b, means and r2 of y over x."""
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    sums = {"n": F.count(F.lit(1)), "sx": F.sum(cx), "sy": F.sum(cy), "sxx": F.sum(cx * cx), "syy": F.sum(cy * cy), "sxy": F.sum(cx * cy)}
    fit = {"a": F.regr_intercept(cy, cx), "b": F.regr_slope(cy, cx), "xbar": F.avg(cx), "ybar": F.avg(cy), "r2": F.regr_r2(cy, cx)}
    return points.agg(*(c.alias(k) for k, c in {**sums, **fit}.items()))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v.cast("double"))


def assign_nearest(points: DataFrame, means: Sequence[Sequence[float]], point: str = "point") -> DataFrame:
    """Add ``cluster``: the nearest mean, the lowest number among equals.

    The k means are literals of the expression, so assigning needs no join.
    """
    distances = F.array(*(squared_distance(F.col(point), F.array(*(F.lit(float(v)) for v in m))) for m in means))
    return points.withColumn("cluster", (F.array_position(distances, F.array_min(distances)) - 1).cast("int"))


def cluster_means(assigned: DataFrame, point: str = "point", integer: bool = False) -> DataFrame:
    """``cluster, dim, mean``; whole numbers are truncated towards zero if ``integer``."""
    cells = assigned.select("cluster", F.posexplode(point).alias("dim", "v"))
    mean = F.sum("v") / F.count(F.lit(1))
    return cells.groupBy("cluster", "dim").agg((mean.cast("bigint") if integer else mean).alias("mean"))


def kmeans(points: DataFrame, k: int, order: str = "id", point: str = "point", integer: bool = False, most_rounds: int | None = None) -> tuple[list[list[float]], DataFrame]:
    """Lloyd's algorithm from the first ``k`` points (by ``order``) until no assignment changes.

    Returns the means and the assigned points. An empty cluster keeps its mean.
    The points are read once, into matrices that stay with the executors; a round is one
    job over them, and a task of it sends k x dimensions numbers to the driver.
    Points without a place (null, with a null in them, of another length) belong to no
    cluster.  Assignments are unchanged when the means are.  Means that
    come back (truncated ones can) would go round for ever: an error, as is an end
    by ``most_rounds``.
    """
    means = [list(map(float, r[0])) for r in points.orderBy(order).limit(k).select(point).collect()]
    if not means or not means[0]:
        return means, assign_nearest(points, means, point)
    seen = {str(means)}
    blocks = _blocks(points.select(F.col(point).cast("array<double>")), len(means[0])).persist()
    try:
        while True:
            if most_rounds is not None and len(seen) > most_rounds:
                raise RuntimeError(f"k-means: means still change after {most_rounds} rounds")
            new, _ = _next_means(blocks, means, integer)
            if new == means:
                break
            # Sums in another order differ in their last digits: the assignments decide.
            if all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for x, y in zip(new, means) for a, b in zip(x, y)):
                if not _next_means(blocks, new, integer, was=means)[1]:
                    break
            if str(new) in seen:
                raise RuntimeError("k-means: means come back without settling")
            seen.add(str(new))
            means = new
    finally:
        blocks.unpersist()
    return means, assign_nearest(points, means, point)


def _blocks(points: DataFrame, dims: int) -> DataFrame:
    """``n, block``: the points as matrices of ``n`` rows in bytes, dealt evenly; single precision where that loses nothing."""
    high = max(1, BLOCK // (8 * dims))

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            rows = b.column(0)
            whole = pc.fill_null(pc.equal(pc.list_value_length(rows), dims), False)
            if rows.flatten().null_count:
                nulls = pc.list_parent_indices(rows).filter(rows.flatten().is_null())
                whole = pc.and_(whole, pc.invert(pc.is_in(pa.array(range(len(rows)), nulls.type), nulls)))
            x = rows.filter(whole).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for at in range(0, len(x), high):
                part = x[at : at + high]
                with np.errstate(over="ignore"):
                    single = part.astype(np.float32)
                yield pa.RecordBatch.from_pydict({"n": [len(part)], "block": [(single if np.array_equal(single, part) else part).tobytes()]})

    spark, n = points.sparkSession, points.count()
    parts = max(min(spark.sparkContext.defaultParallelism, -(-n // high)), -(-n * dims * 8 // PART), 1)
    return points.mapInArrow(pack, "n long, block binary").repartition(parts)


def _next_means(blocks: DataFrame, means: list[list[float]], integer: bool = False, was: list[list[float]] | None = None) -> tuple[list[list[float]], int]:
    """The means of what is nearest to each of ``means``, and how many points ``was`` assigns otherwise."""

    def step(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        now, before = np.array(means), None if was is None else np.array(was)
        sums, counts, moved = np.zeros(now.shape), np.zeros(len(now), np.int64), 0
        for b in batches:
            for n, block in zip(b.column(0).to_pylist(), b.column(1)):
                held = block.as_buffer()
                x = np.frombuffer(held, np.float32 if held.size == 4 * n * now.shape[1] else np.float64).reshape(n, -1).astype(np.float64)
                cluster = _nearest(x, now)
                if before is not None:
                    moved += int(np.count_nonzero(cluster != _nearest(x, before)))
                own = np.bincount(cluster, minlength=len(now))
                found = np.flatnonzero(own)
                sums[found] += np.add.reduceat(x[np.argsort(cluster, kind="stable")], (np.cumsum(own) - own)[found], axis=0)
                counts += own
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "moved": [moved], "counts": [counts.tobytes()], "sums": [sums.tobytes()]})

    import numpy as np

    new, moved = [list(m) for m in means], 0
    sums, counts = np.zeros((len(new), len(new[0]))), np.zeros(len(new), np.int64)
    # In the order of the parts, so that the same assignments give the same sums.
    for r in sorted(blocks.mapInArrow(step, "part long, moved long, counts binary, sums binary").collect(), key=lambda r: r["part"]):
        sums += np.frombuffer(r["sums"]).reshape(sums.shape)
        counts += np.frombuffer(r["counts"], np.int64)
        moved += r["moved"]
    for c in np.flatnonzero(counts):
        mean = sums[c] / counts[c]
        new[c] = (np.trunc(mean) + 0.0 if integer else mean).tolist()
    return new, moved


def _nearest(x, means):
    """``assign_nearest`` of the rows of a matrix: by products, and where these leave a doubt by the same sums in the same order."""
    import numpy as np

    with np.errstate(all="ignore"):
        size = (means * means).sum(1)
        score = size - 2 * (x @ means.T)
        cluster = score.argmin(1)
        if len(means) == 1:
            return cluster
        doubt = 16 * (x.shape[1] + 8) * np.finfo(float).eps * (np.einsum("ij,ij->i", x, x) + size.max())
        close = np.flatnonzero(np.count_nonzero(score <= (score.min(1) + doubt)[:, None], axis=1) != 1)
        if len(close):
            best, at = np.full(len(close), np.nan), np.zeros(len(close), cluster.dtype)
            for c, m in enumerate(means):
                d = np.zeros(len(close))
                for j in range(x.shape[1]):
                    v = x[close, j] - m[j]
                    d += v * v
                nearer = (d < best) | (np.isnan(best) & ~np.isnan(d))  # as Spark orders: NaN is above all numbers
                best[nearer], at[nearer] = d[nearer], c
            cluster[close] = at
    return cluster


def row_covariance(matrix: DataFrame, integer: bool = False) -> DataFrame:
    """``i, j, cov`` for ``i <= j``: covariance of the rows of a matrix in coordinates (i, j, v); absent cells are 0, as in ``matrix_product``.

    Sums of products over the columns are divided by the number of rows less one.
    Integer means and results truncate, as the small-integer variant has it.  An
    empty matrix gives no rows.
    """
    width, height = matrix.agg(F.max("j") + 1, F.max("i") + 1).collect()[0]
    mean = F.sum("v") / F.lit(width)
    sums = matrix.groupBy("i").agg(F.sum("v").alias("s"), (mean.cast("bigint") if integer else mean).alias("m"))
    x, y = (matrix.select(F.col("i").alias(i), F.col("j").alias("c"), F.col("v").alias(v)) for i, v in (("i", "x"), ("k", "y")))
    products = x.join(y, "c").where("i <= k").groupBy("i", "k").agg(F.sum(F.col("x") * F.col("y")).alias("p"))
    # All pairs of rows are the result itself; a row without cells has sum and mean 0.
    rows = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((height or 0) - 1))).alias("i")
    every = matrix.sparkSession.range(1).select(rows) if height else matrix.select(F.col("i").cast("bigint").alias("i")).where("false")
    pairs = every.select("i", F.explode(F.sequence("i", F.lit((height or 1) - 1))).alias("k"))
    other = sums.select(F.col("i").alias("k"), F.col("s").alias("sk"), F.col("m").alias("mk"))
    joined = pairs.join(sums, "i", "left").join(other, "k", "left").join(products, ["i", "k"], "left")
    s, m, sk, mk, p = (F.coalesce(F.col(c), F.lit(0)) for c in ("s", "m", "sk", "mk", "p"))
    cov = (p - mk * s - m * sk + F.lit(width) * m * mk) / F.lit(max(1, (height or 0) - 1))
    return joined.select("i", F.col("k").alias("j"), (cov.cast("bigint") if integer else cov).alias("cov"))


def column_covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with ``cov_<a>_<b>`` of every pair of columns, in one pass."""
    return df.agg(*(F.covar_samp(a, b).alias(f"cov_{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]))


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """``i, j, v``: the product of two matrices in coordinates (missing cells are 0)."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def string_match(texts: DataFrame, column: str = "word", targets: Sequence[str] = TARGET_WORDS) -> DataFrame:
    """``target, n``: how many words equal each target once both are shifted by five letters; 0 counts too."""
    marks = texts.sparkSession.createDataFrame([(t,) for t in targets], "target string")
    shifted = marks.withColumn("shifted", shift_letters(F.col("target")))
    wanted = [t for t in targets]
    found = texts.where(F.length(column).isin(sorted({len(t) for t in wanted}))).select(shift_letters(F.col(column)).alias("shifted"))
    counts = found.groupBy("shifted").agg(F.count(F.lit(1)).alias("c"))
    return shifted.join(counts, "shifted", "left").select("target", F.coalesce("c", F.lit(0)).alias("n"))
