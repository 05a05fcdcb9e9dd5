"""Co-training of a text-content classifier and a page-metadata classifier.

Two logistic regressions see separate views of a document: the words and shape of its
text, and its metadata columns.  In each round both score all unlabelled documents on
the executors; the rows that one is surest of, by a threshold over all of them, teach
the other.  Both are then calibrated (Platt scaling) on held-out labels, their
calibrated log-odds are combined by weights learned there, and all documents are
scored.

Features of all documents are computed once and written as packed arrays, so rounds and
scores do not read texts again.  Classifiers are fitted on the driver from bounded
samples of labelled rows: ``MAX_LABELLED`` documents with labels, chosen by a hash of
their id, and ``MAX_EXCHANGED`` pseudo-labelled rows a view and round, the most certain
of all unlabelled ones (among equally certain ones a hash decides).  Thresholds of the
text's shape are quantiles of the labelled rows.  A document is good if its quality
label is 1 and its toxic label isn't.

Null labels and null ids are not learned from; a document labelled twice is bad if any
label says so; of labelled rows with one id, that with the least features is learned
from.  Null text has no words; null metadata are a value of their own; of metadata
columns those that exist are used, other columns are left out, whatever their names.
Repeated ``doc_id``s are scored row by row.  With labels of one kind only, or none,
every score is the share of good labels (0.5 without labels).  An empty table gives no
rows.  A very long text is read whole by its task, and is one row of features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.llm.arrays import flat_text, gather_runs, hash_words, pack_arrays, run_sums, slices, split_words, uniform, unpack_arrays
from logmill.llm.storage import materialize

MAX_LABELLED, MAX_EXCHANGED = 16_000, 4_000
TEXT_BITS, META_BITS = 17, 10
METADATA = ("lang", "source", "n_chars")


@dataclass
class Sparse:
    """Rows of binary features: row ``i`` has ``index[bounds[i]:bounds[i + 1]]``."""

    index: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def take(self, rows: np.ndarray) -> "Sparse":
        n = np.diff(self.bounds)[rows]
        return Sparse(gather_runs(self.index, self.bounds[:-1][rows], n), np.concatenate(([0], np.cumsum(n))))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return run_sums(weights[self.index], self.bounds)


def _rows(row: np.ndarray, value: np.ndarray, rows: int, bits: int) -> Sparse:
    keys = np.sort(row.astype(np.int64) << bits | (value >> np.uint64(64 - bits)).astype(np.int64))
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    return Sparse((keys & ((1 << bits) - 1)).astype(np.int64), np.searchsorted(keys >> bits, np.arange(rows + 1)))


def _named(kind: str, values: np.ndarray) -> np.ndarray:
    return hash_words([f"\0{kind}\0{v}" for v in values.tolist()])


#: What is measured of a text's shape, per word.
SHAPE = ("marks", "capitals", "digits", "repeats", "repeated pairs", "word length")
#: Quantiles of the labelled rows that are thresholds of each.
QUANTILES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98)
#: Words that a text needs for its shape to mean something.
LEAST_WORDS = 12


def _fresh(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether a position is the first of its value in its row."""
    order = np.lexsort((np.arange(len(row)), value, row))
    r, v = row[order], value[order]
    out = np.ones(len(row), bool)
    out[order[1:]] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return out


def text_features(text: pa.Array) -> tuple[Sparse, np.ndarray]:
    """Distinct lower-cased words without marks around them, and the values of ``SHAPE`` (rows x kinds; NaN for few words)."""
    raw_text = flat_text(text)
    rows = len(raw_text)
    plain = split_words(pc.utf8_lower(pc.replace_substring_regex(raw_text, r"[!-/:-@\[-`{-~]+", " ")))
    words = split_words(raw_text)
    count = np.diff(words.bounds)
    n = np.maximum(count, 1)
    _, offsets, data = raw_text.buffers()
    ends = np.frombuffer(offsets, np.int64)[: rows + 1] if rows else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None else np.zeros(0, np.uint8)

    def share(*ranges: tuple[int, int]) -> np.ndarray:
        inside = np.zeros(256, bool)
        for low, high in ranges:
            inside[low : high + 1] = True
        return run_sums(inside[raw], ends) / n

    doc, codes = words.doc, words.codes
    # A word is repeated if it is one of the two before it; a pair if the text has had it.
    again = np.zeros(len(codes), bool)
    for k in (1, 2):
        again[k:] |= (codes[k:] == codes[:-k]) & (doc[k:] == doc[:-k])
    pair_doc = doc[1:][doc[1:] == doc[:-1]]
    pair = (codes[:-1] * max(1, len(words)) + codes[1:])[doc[1:] == doc[:-1]]
    old = np.bincount(pair_doc, weights=~_fresh(pair_doc, pair), minlength=rows)
    shape = np.column_stack([
        share((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)),
        share((0x41, 0x5A)),
        share((0x30, 0x39)),
        run_sums(again, words.bounds) / n,
        old / n,
        share((0x21, 0x7E), (0xC0, 0xFF)),
    ]).astype(np.float32).reshape(rows, len(SHAPE))
    shape[count < LEAST_WORDS] = np.nan
    return _rows(plain.doc, plain.hashes(), rows, TEXT_BITS), shape


def meta_features(columns: dict[str, pa.Array]) -> Sparse:
    """A feature per column: its text, or the bucket of its size if it is a number."""
    rows, row, value = 0, [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for name, column in columns.items():
        rows = len(column)
        if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
            x = pc.fill_null(column.cast(pa.float64()), -1.0).to_numpy(zero_copy_only=False)
            x = np.where(x < 0, -1, np.floor(2 * np.log2(np.maximum(x, 0) + 1))).astype(np.int64)
            value.append(_named(name, x))
        else:
            value.append(hash_words([f"\0{name}\0{v}" for v in column.cast(pa.string()).to_pylist()]))
        row.append(np.arange(rows))
    return _rows(np.concatenate(row), np.concatenate(value), rows, META_BITS)


def telling(x: Sparse, y: np.ndarray, size: int, least: float = 4.0) -> np.ndarray:
    """Which features differ between the kinds of rows by ``least`` standard errors: the others would only be learned by heart."""
    row = np.repeat(np.arange(len(x)), np.diff(x.bounds))
    n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    p1 = np.bincount(x.index, weights=y[row], minlength=size) / n1
    p0 = np.bincount(x.index, weights=1.0 - y[row], minlength=size) / n0
    p = (n1 * p1 + n0 * p0) / (n1 + n0)
    return np.abs(p1 - p0) >= least * np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))


def fit_logistic(x: Sparse, y: np.ndarray, size: int, steps: int = 80, decay: float = 1e-4) -> np.ndarray:
    """Weights of telling features and, last, the intercept; Adam on the whole batch, the same for the same rows."""
    use = telling(x, y, size)
    keep = use[x.index]
    row = np.repeat(np.arange(len(x)), np.diff(x.bounds))[keep]
    x = Sparse(x.index[keep], np.searchsorted(row, np.arange(len(x) + 1)))
    w = np.zeros(size + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = sigmoid(x.dot(w[:-1]) + w[-1]) - y
        grad = np.append(np.bincount(x.index, weights=g[row], minlength=size), g.sum()) / max(1, len(y)) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_dense(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression on few columns by Newton steps; the intercept is last."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


class Views:
    """Features of some documents: words, shape, metadata."""

    def __init__(self, text: Sparse, shape: np.ndarray, meta: Sparse):
        self.text, self.shape, self.meta = text, shape, meta

    def __len__(self) -> int:
        return len(self.text)

    def take(self, rows: np.ndarray) -> "Views":
        return Views(self.text.take(rows), self.shape[rows], self.meta.take(rows))

    @classmethod
    def joined(cls, parts: Sequence["Views"]) -> "Views":
        def sparse(xs: list[Sparse]) -> Sparse:
            return Sparse(np.concatenate([x.index for x in xs]), np.concatenate(([0], np.cumsum(np.concatenate([np.diff(x.bounds) for x in xs])))))

        return cls(sparse([p.text for p in parts]), np.concatenate([p.shape for p in parts]), sparse([p.meta for p in parts]))

    def view(self, name: str, cuts: list[np.ndarray]) -> Sparse:
        """The features of one view; a text also has one for each threshold that its shape reaches."""
        return self.meta if name == "meta" else _with_shape(self.text, self.shape, cuts)


def no_views() -> Views:
    none = Sparse(np.zeros(0, np.int64), np.zeros(1, np.int64))
    return Views(none, np.zeros((0, len(SHAPE)), np.float32), none)


def _with_shape(text: Sparse, shape: np.ndarray, cuts: list[np.ndarray]) -> Sparse:
    row, index, base = [np.repeat(np.arange(len(text)), np.diff(text.bounds))], [text.index], 1 << TEXT_BITS
    for k, c in enumerate(cuts):
        reached = np.where(np.isnan(shape[:, k]), 0, np.searchsorted(c, shape[:, k], side="right"))
        row.append(np.repeat(np.arange(len(text)), reached))
        index.append(base + gather_runs(np.arange(len(c)), np.zeros(len(text), np.int64), reached))
        base += len(c)
    row, index = np.concatenate(row), np.concatenate(index)
    order = np.argsort(row, kind="stable")
    return Sparse(index[order], np.searchsorted(row[order], np.arange(len(text) + 1)))


def shape_cuts(shape: np.ndarray) -> list[np.ndarray]:
    """Thresholds: distinct quantiles of the rows that have a shape."""
    known = shape[~np.isnan(shape[:, 0])] if len(shape) else shape
    return [np.unique(np.quantile(known[:, k], QUANTILES)) if len(known) else np.zeros(0) for k in range(len(SHAPE))]


@dataclass
class CoTrained:
    """Thresholds, both views' weights, their calibrations (slope, intercept) and how they combine."""

    cuts: list[np.ndarray]
    text: np.ndarray
    meta: np.ndarray
    calibrate_text: np.ndarray
    calibrate_meta: np.ndarray
    combine: np.ndarray
    exchanged: int = 0

    def log_odds(self, views: Views) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.calibrate_text[0] * raw_odds(views, "text", self.text, self.cuts) + self.calibrate_text[1]
        b = self.calibrate_meta[0] * raw_odds(views, "meta", self.meta, self.cuts) + self.calibrate_meta[1]
        return a, b, self.combine[0] * a + self.combine[1] * b + self.combine[2]


def raw_odds(views: Views, name: str, weights: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return views.view(name, cuts).dot(weights[:-1]) + weights[-1]


#: Certainty is counted in steps of log-odds, from ``STEPS`` to one.
STEPS, MOST_STEPS = 8, 400


def certainty(odds: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """``(kind, step)``: 1 or 0 for rows that are good or bad with a probability of ``sure`` or more, else -1; and how certain that is."""
    least = np.log(sure / (1 - sure))
    kind = np.where(odds >= least, 1, np.where(odds <= -least, 0, -1))
    return kind, np.minimum(np.floor(np.abs(odds) * STEPS), MOST_STEPS).astype(np.int64)


def thresholds(counts: dict[tuple[str, int, int], int], limits: dict[int, int]) -> dict[tuple[str, int], tuple[int, float]]:
    """Per view and kind ``(step, share)``: rows of higher steps, and that share of the rows of this one, are as many as the limit."""
    out = {}
    for view in ("text", "meta"):
        for kind, room in limits.items():
            for step in sorted({k[2] for k in counts if k[:2] == (view, kind)}, reverse=True):
                n = counts[view, kind, step]
                out[view, kind] = (step, min(1.0, room / n))
                if n >= room:
                    break
                room -= n
    return out


def chosen(kind: np.ndarray, step: np.ndarray, dice: np.ndarray, view: str, cut: dict[tuple[str, int], tuple[int, float]]) -> np.ndarray:
    pick = np.zeros(len(kind), bool)
    for k in (0, 1):
        if (view, k) in cut:
            least, share = cut[view, k]
            pick |= (kind == k) & ((step > least) | ((step == least) & (dice < share)))
    return pick


class Pool:
    """Where confident rows come from. This one holds all rows in memory; ``SparkPool`` asks the executors."""

    def __init__(self, views: Views, row: np.ndarray, dice: np.ndarray):
        self.views, self.row, self.dice = views, row, dice

    def __len__(self) -> int:
        return len(self.views)

    def counts(self, weights: dict[str, np.ndarray], cuts: list[np.ndarray], sure: float) -> dict[tuple[str, int, int], int]:
        out: dict[tuple[str, int, int], int] = {}
        for name in weights:
            kind, step = certainty(raw_odds(self.views, name, weights[name], cuts), sure)
            for (k, s), n in _pairs_counted(kind, step):
                out[name, k, s] = n
        return out

    def rows(self, weights: dict[str, np.ndarray], cuts: list[np.ndarray], sure: float, cut: dict) -> dict[str, tuple[np.ndarray, np.ndarray, Views]]:
        """Per view ``(row, kind, features)`` of the rows that it is sure of."""
        out = {}
        for name in weights:
            kind, step = certainty(raw_odds(self.views, name, weights[name], cuts), sure)
            at = np.flatnonzero(chosen(kind, step, self.dice, name, cut))
            out[name] = (self.row[at], kind[at], self.views.take(at))
        return out


def _pairs_counted(kind: np.ndarray, step: np.ndarray) -> list[tuple[tuple[int, int], int]]:
    at = kind >= 0
    keys, n = np.unique(kind[at] * (MOST_STEPS + 1) + step[at], return_counts=True)
    return [(divmod(int(k), MOST_STEPS + 1), int(c)) for k, c in zip(keys, n)]


def cotrain(labelled: Views, label: np.ndarray, fold: np.ndarray, pool: Pool, rounds: int = 3, share: float = 0.1, sure: float = 0.95, most: int = MAX_EXCHANGED) -> CoTrained:
    """Fit on labelled rows (1 or 0) and a pool; rows of fold 0 only calibrate.

    In a round a view hands over up to ``share`` of the pool and ``most`` rows, in the
    labels' proportions, each with a probability of ``sure`` or more.
    """
    cuts = shape_cuts(labelled.shape)
    sizes = {"text": (1 << TEXT_BITS) + sum(map(len, cuts)), "meta": 1 << META_BITS}
    fixed, check = np.flatnonzero(fold != 0), np.flatnonzero(fold == 0)
    good = label[fixed].mean() if len(fixed) else 0.5
    if not len(fixed) or good in (0.0, 1.0) or len(check) < 10 or label[check].mean() in (0.0, 1.0):
        prior = float(np.clip(label.mean() if len(label) else 0.5, 1e-6, 1 - 1e-6))
        flat, none = np.array([0.0, np.log(prior / (1 - prior))]), np.zeros
        return CoTrained(cuts, none(sizes["text"] + 1), none(sizes["meta"] + 1), flat, flat, np.array([0.5, 0.5, 0.0]))
    learned = {name: ([labelled.take(fixed)], [label[fixed]]) for name in sizes}
    taken: dict[str, set[int]] = {name: set() for name in sizes}
    n_pool, exchanged, weights = len(pool), 0, {}
    for number in range(rounds + 1):
        for name, size in sizes.items():
            parts, y = learned[name]
            weights[name] = fit_logistic(Views.joined(parts).view(name, cuts), np.concatenate(y).astype(float), size)
        if number == rounds or not n_pool:
            break
        room = min(int(share * n_pool), most)
        cut = thresholds(pool.counts(weights, cuts, sure), {1: int(room * good), 0: int(room * (1 - good))})
        for name, (row, kind, views) in pool.rows(weights, cuts, sure, cut).items():
            other = "meta" if name == "text" else "text"
            new = np.array([k for k, r in enumerate(row.tolist()) if r not in taken[other]], np.int64)
            taken[other].update(row[new].tolist())
            learned[other][0].append(views.take(new))
            learned[other][1].append(kind[new])
            exchanged += len(new)
    y = label[check].astype(float)
    odds = [raw_odds(labelled.take(check), name, weights[name], cuts) for name in sizes]
    platt = [fit_dense(o[:, None], y) for o in odds]
    calibrated = np.column_stack([p[0] * o + p[1] for p, o in zip(platt, odds)])
    return CoTrained(cuts, weights["text"], weights["meta"], platt[0], platt[1], fit_dense(calibrated, y), exchanged)


# ---- features of all documents, a row per slice of texts

BLOB = "blob binary"


def _dump(doc_id: pa.Array, label: np.ndarray, row: np.ndarray, views: Views) -> bytes:
    """Distinct indexes of a row ascend: their differences are small."""

    def steps(x: Sparse) -> np.ndarray:
        out = np.diff(x.index, prepend=0)
        first = x.bounds[:-1][np.diff(x.bounds) > 0]
        out[first] = x.index[first]
        return out.astype(np.int32)

    ids, valid = pc.fill_null(doc_id, 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_valid(doc_id).to_numpy(zero_copy_only=False).astype(np.uint8)
    sizes = [np.diff(x.bounds).astype(np.int32) for x in (views.text, views.meta)]
    return pack_arrays(ids, valid, label.astype(np.int8), row, sizes[0], steps(views.text), views.shape.ravel(), sizes[1], steps(views.meta))


def _load(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, Views]:
    ids, valid, label, row, n_text, text, shape, n_meta, meta = unpack_arrays(raw)

    def sparse(n: np.ndarray, steps: np.ndarray) -> Sparse:
        bounds = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        total = np.cumsum(steps, dtype=np.int64)
        before = np.concatenate(([0], total))[bounds[:-1]]
        return Sparse(total - np.repeat(before, n), bounds)

    return pa.array(ids, mask=valid == 0), label, row, Views(sparse(n_text, text), shape.reshape(len(ids), len(SHAPE)), sparse(n_meta, meta))


def featurize(docs: DataFrame, marks: dict[int, int], metadata: Sequence[str] = METADATA) -> DataFrame:
    """Features of all rows of ``docs`` (doc_id, text, metadata); ``marks`` labels some ids (1 or 0)."""
    names = [n for n in metadata if n in docs.columns]
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "_text"):
                text, shape = text_features(part.column("_text"))
                none = Sparse(np.zeros(0, np.int64), np.zeros(part.num_rows + 1, np.int64))
                meta = meta_features({n: part.column(n) for n in names}) if names else none
                label = np.fromiter((sent.value.get(i, -1) for i in part.column("_id").to_pylist()), np.int64, part.num_rows)
                blob = _dump(part.column("_id"), label, at + np.arange(part.num_rows), Views(text, shape, meta))
                at += part.num_rows
                yield pa.RecordBatch.from_pydict({"blob": pa.array([blob], pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), *names)
    return materialize(rows.mapInArrow(run, BLOB), "cotrain-features")


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, Views]]:
    for batch in batches:
        for raw in batch.column("blob").to_pylist():
            yield _load(raw)


_ROW = "id long, row long, label int, view string, blob binary"


def _rows_out(ids: pa.Array, row: np.ndarray, label: np.ndarray, view: str, views: Views) -> pa.RecordBatch:
    one = [_dump(pa.array([0]), np.zeros(1), np.zeros(1, np.int64), views.take(np.array([k]))) for k in range(len(views))]
    return pa.RecordBatch.from_pydict({"id": ids, "row": pa.array(row), "label": pa.array(label.astype(np.int32)), "view": pa.array([view] * len(row)), "blob": pa.array(one, pa.binary())})


def _views_of(blobs: list[bytes]) -> Views:
    return Views.joined([_load(b)[3] for b in blobs]) if blobs else no_views()


class SparkPool:
    """All unlabelled rows of a feature table; the driver gets counts, and the rows that thresholds let through."""

    def __init__(self, features: DataFrame, seed: int = 11):
        self.features, self.seed = features, seed

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, label, _, _ in _blobs(batches):
                yield pa.RecordBatch.from_pydict({"n": pa.array([int((label < 0).sum())], pa.int64())})

        self.n = features.mapInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]

    def __len__(self) -> int:
        return self.n

    def counts(self, weights, cuts, sure):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, label, _, views in _blobs(batches):
                views = views.take(np.flatnonzero(label < 0))
                for name, w in sent.value.items():
                    found = _pairs_counted(*certainty(raw_odds(views, name, w, cuts), sure))
                    yield pa.RecordBatch.from_pydict({"v": pa.array([name] * len(found), pa.string()), "k": pa.array([k for (k, _), _ in found], pa.int32()), "s": pa.array([s for (_, s), _ in found], pa.int32()), "n": pa.array([n for _, n in found], pa.int64())})

        sent = self.features.sparkSession.sparkContext.broadcast(weights)
        got = self.features.mapInArrow(run, "v string, k int, s int, n long").groupBy("v", "k", "s").agg(F.sum("n").alias("n")).collect()  # steps x kinds x views
        return {(r["v"], r["k"], r["s"]): r["n"] for r in got}

    def rows(self, weights, cuts, sure, cut):
        seed = self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, label, row, views in _blobs(batches):
                pool = np.flatnonzero(label < 0)
                for name, w in sent.value.items():
                    kind, step = certainty(raw_odds(views.take(pool), name, w, cuts), sure)
                    at = np.flatnonzero(chosen(kind, step, uniform(seed, row[pool]), name, cut))
                    if len(at):
                        yield _rows_out(ids.take(pa.array(pool[at])), row[pool[at]], kind[at], name, views.take(pool[at]))

        sent = self.features.sparkSession.sparkContext.broadcast(weights)
        got = self.features.mapInArrow(run, _ROW).toArrow().sort_by([("view", "ascending"), ("row", "ascending")])
        out = {}
        for name in weights:
            mine = got.filter(pc.equal(got["view"], name))
            out[name] = (mine["row"].to_numpy(), mine["label"].to_numpy(), _views_of(mine["blob"].to_pylist()))
        return out


def fit(docs: DataFrame, labels: DataFrame, metadata: Sequence[str] = METADATA, labelled: int = MAX_LABELLED, most: int = MAX_EXCHANGED, seed: int = 11) -> tuple[CoTrained, DataFrame]:
    """Fit from labels (doc_id, quality, toxic) and ``docs``; returns the model and the features of all rows."""
    toxic = F.coalesce(F.max("toxic"), F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.when((F.min("quality") == 1) & (toxic == 0), 1).otherwise(0).alias("good"))
    dice = F.pmod(F.xxhash64("doc_id", F.lit("cotrain")), F.lit(1 << 30)) / float(1 << 30)
    chosen_marks = marks.where(dice < labelled / max(1, marks.count())).toArrow()
    features = featurize(docs, dict(zip(chosen_marks["doc_id"].to_pylist(), chosen_marks["good"].to_pylist())), metadata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, label, row, views in _blobs(batches):
            at = np.flatnonzero(label >= 0)
            if len(at):
                yield _rows_out(ids.take(pa.array(at)), row[at], label[at], "", views.take(at))

    # One row an id, however often it is there.
    got = features.mapInArrow(run, _ROW).groupBy("id", "label").agg(F.min("blob").alias("blob")).toArrow().sort_by("id")
    ids = got["id"].to_pylist()
    fold = np.array([hash_words([str(i)])[0] % np.uint64(4) for i in ids], np.int64)
    return cotrain(_views_of(got["blob"].to_pylist()), got["label"].to_numpy().astype(np.int64), fold, SparkPool(features, seed), most=most), features


def score(features: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, p_text, p_meta, score (probability to be good) and kept (0.5 or more) of every row."""
    sent = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, _, views in _blobs(batches):
            a, b, both = sent.value.log_odds(views)
            p = sigmoid(both)
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "p_text": pa.array(sigmoid(a)), "p_meta": pa.array(sigmoid(b)), "score": pa.array(p), "kept": pa.array(p >= 0.5)})

    return features.mapInArrow(run, "doc_id long, p_text double, p_meta double, score double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit and score in one: see ``fit`` and ``score``."""
    model, features = fit(docs, labels)
    return score(features, model)
