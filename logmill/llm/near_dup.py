"""MinHash near-duplicates with min-max hashing.

A document's set holds its distinct shingles of five lower-cased words (fewer
words: the whole sequence).  Each of 50 hash functions gives two signature
values, the least and the greatest hash of the set, so 100 values cost 50
evaluations per shingle.  Bands of values propose candidates, as long as a pair at
the threshold shares no band with a chance of 1 in 100,000 at most: 20 bands of 5
for a similarity of 0.85, 25 of 4 for 0.8.

1. Documents with equal sets (a 128-bit digest) form a class; from here on only
   one document stands for it, however many copies there are.
2. Classes that share a band are joined to the least class of the band, and the
   components of these candidate edges are the groups in which links can lie.
3. Sets of grouped classes are read again and links confirmed on them.  A group
   of usual size goes to one task, which grows one component at a time: a class
   is compared with all that no component holds yet, through the postings of its
   shingles.  A group with more than ``LOCAL`` shingles is dealt into blocks of
   half of that.  A block of classes picked by hash meets every other block first, which
   joins most copies; then every two blocks meet in a task, except blocks that lie in
   one component.  So any two classes of different components are compared.  These
   tasks run in waves, each of which moves the groups' sets ``WAVE`` times on average;
   only links that span a task's components are written.

Pairs inside a band are never listed.  Shingle hashes have 64 bits.  Documents
without words, and null texts, have the empty set and link with nothing.  Rows
equal in id and text share their outcome; a null ``doc_id`` takes part, but a
component is named by its least known id.  An empty table gives no rows.  Columns but
doc_id and text are not looked at, and pass through ``keep_one``, whatever their names.
A very long text is one set, held by one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.llm.arrays import gather_runs, inside, mix, rolling, slices, split_words
from logmill.llm.components import components
from logmill.llm.frequent import Bloom
from logmill.llm.storage import forget, fresh, materialize
from logmill.llm.substrings import keyed

SHINGLE, THRESHOLD = 5, 85
VALUES, MISS = 100, 1e-5
#: Shingles of a group that one task takes.
LOCAL = 2_000_000
#: Copies of larger groups' sets that one wave of tasks reads.
WAVE = 8


def banding(threshold: int, values: int = VALUES) -> tuple[int, int]:
    """``(bands, rows)`` with the most rows that keep the chance to miss a pair at the threshold below ``MISS``."""
    for rows in range(16, 1, -1):
        bands = values // rows
        if (1 - (threshold / 100) ** rows) ** bands <= MISS:
            return bands, rows
    return values, 1


def shingle_sets(text: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)``: the sorted distinct shingle hashes of each text."""
    words = split_words(text, lower=True)
    n, count = len(words.codes), np.diff(words.bounds)
    h = words.hashes()
    whole = np.flatnonzero(inside(words.bounds, size, n))
    doc, value = words.doc[whole], rolling(h, size)[whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = [rolling(h[words.bounds[d] : words.bounds[d + 1]], int(count[d]))[0] ^ np.uint64(count[d]) for d in short]
        doc, value = np.concatenate((doc, short)), np.concatenate((value, np.array(extra, np.uint64)))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[keep], value[keep]
    return value, np.searchsorted(doc, np.arange(len(count) + 1))


def signatures(value: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts x bands) of min-max signatures; rows of empty sets mean nothing."""
    half = -(-bands * rows // 2)
    rng = np.random.default_rng(20_240_601)
    mul = rng.integers(0, 1 << 63, half, np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, half, np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, bands), np.uint64)
    if not len(full):
        return out
    starts = bounds[:-1][full]
    sig = np.zeros((len(full), 2 * half), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(half):
            x = value * mul[k] + add[k]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            sig[:, k] = np.minimum.reduceat(x, starts)
            sig[:, half + k] = np.maximum.reduceat(x, starts)
        # Values of a band come from different functions, least and greatest in turn.
        order = [(k // 2 if k % 2 == 0 else half + (k // 2 + half // 2) % half) for k in range(2 * half)]
        sig = sig[:, order]
        for b in range(bands):
            acc = np.full(len(full), b + 1, np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + sig[:, k])
            out[full, b] = acc
    return out


def sketches(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``_key, doc_id, n, d1, d2, bands`` per row of ``docs`` (doc_id, text)."""
    bands, rows = banding(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                value, bounds = shingle_sets(part.column("text"))
                band = signatures(value, bounds, bands, rows).view(np.int64)
                with np.errstate(over="ignore"):
                    digest = []
                    for salt in (0x1234567, 0x89ABCDE):
                        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(salt)))))
                        digest.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, bands, dtype=np.int32)), pa.array(band.ravel()))
                yield pa.RecordBatch.from_pydict(
                    {"_key": part.column("_key"), "doc_id": part.column("doc_id"), "n": pa.array(np.diff(bounds)), "d1": pa.array(digest[0]), "d2": pa.array(digest[1]), "bands": lists}
                )

    return keyed(docs.select("doc_id", "text")).mapInArrow(run, "_key long, doc_id long, n long, d1 long, d2 long, bands array<long>")


def group_links(sizes: np.ndarray, flat: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Component number of each set of a group; sets lie one after the other in ``flat``."""
    m = len(sizes)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    _, item = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(item, kind="stable")
    posting, ends = owner[order], np.concatenate(([0], np.cumsum(np.bincount(item, minlength=1))))
    label, free, found = np.full(m, -1), m, 0
    for seed in range(m):
        if label[seed] >= 0:
            continue
        label[seed], queue, free = found, [seed], free - 1
        while queue and free:
            u = queue.pop()
            own = item[bounds[u] : bounds[u + 1]]
            both = np.bincount(gather_runs(posting, ends[own], ends[own + 1] - ends[own]), minlength=m)
            linked = np.flatnonzero((label < 0) & (100 * both >= threshold * (sizes[u] + sizes - both)))
            label[linked] = found
            free -= len(linked)
            queue.extend(linked.tolist())
        found += 1
    return label


def _links(tasks: DataFrame, by: list[str], threshold: int, name: str) -> DataFrame:
    """``(u, v)`` links that span the components inside every task; tasks: cls, n, shingles (bytes) and the columns ``by``."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("cls").sort_values("cls", ignore_index=True)
        flat = np.frombuffer(b"".join(rows["shingles"]), np.uint64)
        first = _first_of(group_links(rows["n"].to_numpy(), flat, threshold))
        out = pd.DataFrame({"u": rows["cls"], "v": rows["cls"].to_numpy()[first]})
        return out[out["u"] != out["v"]]

    return materialize(tasks.groupBy(*by).applyInPandas(compare, "u long, v long"), name)


def _grow_by_blocks(large: DataFrame, threshold: int, local: int) -> DataFrame:
    """``(cls, root)`` of groups too large for a task; large: grp, cls, n, total, shingles (bytes)."""
    def dealt(total: Column, salt: str) -> Column:
        return F.pmod(F.xxhash64("cls", F.lit(salt)), F.ceil(2 * total / local))

    loops = large.select(F.col("cls").alias("u"), F.col("cls").alias("v"))
    rows = large.withColumn("block", dealt(F.col("total"), "block")).withColumn("pivot", dealt(F.col("total"), "pivot") == 0)
    blocks = rows.where("not pivot").select("grp", "block").distinct()
    columns = ("grp", "block", "cls", "n", "shingles")
    near = rows.where("not pivot").select(*columns).unionByName(rows.where("pivot").drop("block").join(blocks, "grp").select(*columns))
    links = [_links(near, ["grp", "block"], threshold, "group-links")]
    labels = components(links[0].unionByName(loops), "group-labels").select(F.col("v").alias("cls"), F.col("root").alias("label"))
    # Components that fill a block have blocks of their own, the other classes of a group share the rest.
    known = materialize(large.select("grp", "cls", "n").join(labels, "cls"), "group-known")
    forget(labels)
    held = known.groupBy("grp", "label").agg(F.sum("n").alias("held"))
    rest = 2 * F.col("held") < local
    own = known.join(held, ["grp", "label"]).select("grp", "cls", "n", rest.alias("rest"), F.when(~rest, F.col("label")).otherwise(0).alias("own"))
    filled = own.groupBy("grp", "rest", "own").agg(F.sum("n").alias("filled"))
    placed = own.join(filled, ["grp", "rest", "own"])
    placed = materialize(placed.withColumn("block", F.xxhash64("grp", "rest", "own", dealt(F.col("filled"), "again"))), "group-blocks")
    sizes = placed.groupBy("grp", "rest", "own", "block").agg(F.sum("n").alias("size"))
    a, b = (sizes.select("grp", *(F.col(c).alias(f"{c}_{k}") for c in ("rest", "own", "block", "size"))) for k in "ab")
    met = a.join(b, "grp").where("block_a <= block_b and (rest_a or rest_b or own_a <> own_b)")
    pairs = materialize(met.select(F.xxhash64("block_a", "block_b").alias("pair"), "block_a", "block_b", (F.col("size_a") + F.col("size_b")).alias("size")), "group-pairs")
    volume = pairs.agg(F.sum("size")).collect()[0][0] or 0
    waves = math.ceil(volume / (WAVE * max(1, known.agg(F.sum("n")).collect()[0][0] or 0)))
    for wave in range(waves):
        now = pairs.where(F.pmod(F.xxhash64("pair", F.lit("wave")), F.lit(waves)) == wave)
        now = now.select("pair", F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block"))
        sets = large.select("cls", "n", "shingles").join(placed.select("cls", "block"), "cls").join(now, "block")
        links.append(_links(sets.select("pair", "cls", "n", "shingles"), ["pair"], threshold, "group-links"))
    every = loops
    for more in links:
        every = every.unionByName(more)
    found = materialize(components(every, "large-groups").select(F.col("v").alias("cls"), "root"), "group-roots")
    forget(known, placed, pairs, *links)
    return found


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, local: int = LOCAL, scratch: list[DataFrame] | None = None) -> DataFrame:
    """``_key, doc_id, n_shingles, component_id`` per row of ``docs`` (doc_id, text); ``scratch`` gets the tables that the result still reads."""
    spark = docs.sparkSession
    sketch = materialize(sketches(docs, threshold), "sketches")
    classes = materialize(
        sketch.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("_key").alias("cls"), F.min("doc_id").alias("least"), F.first("bands").alias("bands")),
        "classes",
    )
    banded = classes.select("cls", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("cls").alias("u"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    edges = banded.join(shared, "band").select("u", F.col("cls").alias("v")).distinct()
    groups = components(edges, "candidates").select(F.col("v").alias("cls"), F.col("root").alias("grp"))
    members = materialize(groups.join(classes.select("cls", "least", "n"), "cls"), "members")
    forget(groups)
    # Sixteen bits a class, as far as the filter's bound allows: beyond it more sets are read than needed.
    bits = min(28, max(16, (16 * members.count()).bit_length()))
    wanted = spark.sparkContext.broadcast(Bloom.of(members, F.xxhash64("cls"), bits))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = wanted.value.has(batch.column("_probe").to_numpy(zero_copy_only=False).view(np.uint64))
            for part in slices(batch.filter(pa.array(hit))):
                value, bounds = shingle_sets(part.column("text"))
                raw = value.tobytes()
                pieces = [raw[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_pydict({"cls": part.column("_key"), "shingles": pa.array(pieces, pa.binary())})

    probed = keyed(docs.select("doc_id", "text")).withColumn("_probe", F.xxhash64("_key"))
    again = probed.mapInArrow(sets, "cls long, shingles binary").dropDuplicates(["cls"])
    totals = members.groupBy("grp").agg(F.sum("n").alias("total"))
    full = materialize(members.join(totals, "grp").join(again, "cls"), "member-sets")

    def local_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cls", ignore_index=True)
        flat = np.frombuffer(b"".join(rows["shingles"]), np.uint64)
        return pd.DataFrame({"cls": rows["cls"], "root": rows["cls"].to_numpy()[_first_of(group_links(rows["n"].to_numpy(), flat, threshold))]})

    small = full.where(F.col("total") <= local)
    found = small.groupBy("grp").applyInPandas(local_group, "cls long, root long")
    large = full.where(F.col("total") > local).select("grp", "cls", "n", "total", "shingles")
    if large.take(1):
        found = found.unionByName(_grow_by_blocks(large, threshold, local))
    linked = materialize(found, "links")
    forget(full)
    if scratch is not None:
        scratch += [sketch, classes, members, linked]
    rooted = linked.join(members.select("cls", "least"), "cls")
    names = rooted.groupBy("root").agg(F.min("least").alias("name"))
    named = rooted.join(names, "root").select("cls", "name")
    final = classes.join(named, "cls", "left").select("n", "d1", "d2", F.coalesce("name", "least").alias("name"))
    out = sketch.select("_key", "doc_id", "n", "d1", "d2").join(final, ["n", "d1", "d2"], "left")
    return out.select("_key", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("name")).alias("component_id"))


def _first_of(label: np.ndarray) -> np.ndarray:
    """For each member the position of the first with its label."""
    first = np.full(int(label.max()) + 1 if len(label) else 0, -1)
    for i in range(len(label) - 1, -1, -1):
        first[label[i]] = i
    return first[label]


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """All columns of the documents that stay: one of each component, the one with the least id.

    Rows equal in id and text stay or go together; where no id of a component is
    known, all its rows stay.
    """
    scratch: list[DataFrame] = []
    out, key, probe = near_duplicates(docs, threshold, scratch=scratch), fresh(docs, "_key"), fresh(docs, "_probe")
    gone = out.where("component_id is not null and not (doc_id <=> component_id)").select(F.col("_key").alias(key)).distinct()
    gone = materialize(gone, "near-copies")
    forget(*scratch)
    # Only rows that the filter finds are shuffled.
    bits = min(28, max(16, (16 * gone.count()).bit_length()))
    sent = docs.sparkSession.sparkContext.broadcast(Bloom.of(gone, F.xxhash64(key), bits))

    @F.arrow_udf("boolean")
    def may_go(hashes: pa.Array) -> pa.Array:
        return pa.array(sent.value.has(hashes.to_numpy(zero_copy_only=False).view(np.uint64)))

    rows = keyed(docs, key).withColumn(probe, may_go(F.xxhash64(key)))
    sure, unsure = rows.where(~F.col(probe)), rows.where(F.col(probe)).join(gone, key, "left_anti")
    return sure.select(*docs.columns).union(unsure.select(*docs.columns))
