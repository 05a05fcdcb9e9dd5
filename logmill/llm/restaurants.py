"""The passes of the Pitman-Yor model over a corpus, with a restaurant for every context.

A cell is a word in a context.  Cells are counted, seated and looked up in buckets, one
task each, of a bounded number of token pairs; slices of texts reach them as packed
arrays of their distinct pairs.  The ``HOT`` most frequent words (a fixed bound) are
known to all tasks by rank, with their totals.  A cell with a rare context lies in the
context's bucket, else one with a rare word in the word's, else in a bucket of the
word's; a word with a large share of all tokens has as many buckets as its share needs.
So a rare context's totals are complete where its cells are.  A rare word's are but for
its cells in rare contexts: those buckets and the word's own add up such words' tables
in Spark after each round.  Which words are frequent only routes: results are the same.

A cell with one customer has one table, so only cells with more are kept, in a file per
bucket below the shared folder; a round writes their tables beside it.  Rows between
steps hold paths and totals.  Pairs of rows not learned from are counted as zero.

Scoring reads the texts again.  The most frequent pairs' probabilities are known to all
tasks (a fixed bound); the others go to their buckets with the documents they are in,
and each bucket returns one sum per document.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.llm.arrays import give_back, mix, pack_arrays, run_sums, slices, split_words, unpack_arrays, uniform
from logmill.llm.frequent import frequent
from logmill.llm.pitman_yor import SCALE, discount_of, draw_tables, log_probability
from logmill.llm.storage import file_system, materialize, new_folder

#: Words and pairs that every task knows, and tokens of the corpus for each bucket.
HOT, HOT_PAIRS, BUCKET = 1 << 17, 1 << 18, 2_000_000
#: Occurrences in a slice from which it proposes a word as frequent.
OFTEN = 8
SLICE = 8 << 20
#: Tasks that add up the totals of frequent words.
PARTS = 16
#: One in so many slices proposes frequent words (the first of a task always does).
PROPOSE = 4

TOP = np.uint64(1 << 63)
END_HASH, START_HASH = np.uint64(0xE2D0F7E875A3B1C5), np.uint64(0xDB7E151628AED2A7)

#: Rows between the steps. ``kind`` says what ``key`` and ``vs`` are.
ROWS = "b int, kind int, key long, vs array<long>, blob binary, path string"
TOTAL, WORD, CONTEXT, RARE, SIZES, FILE, ASKED, SHARED, PAIR, REPLY, ANSWER, BLOB, DOCS = range(13)


def rows_of(b: int | np.ndarray, kind: int, key: np.ndarray, vs: np.ndarray) -> pa.RecordBatch:
    """Rows with numbers: ``vs`` has a row each."""
    n = len(key)
    vs = np.ascontiguousarray(vs, np.int64).reshape(n, -1) if n else np.zeros((0, 1), np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, vs.size + 1, max(1, vs.shape[1]), dtype=np.int32)[: n + 1]), pa.array(vs.ravel()))
    b = np.broadcast_to(np.asarray(b, np.int32), n)
    columns = [pa.array(b), pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(key).astype(np.uint64).view(np.int64)), lists, pa.nulls(n, pa.binary()), pa.nulls(n, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["b", "kind", "key", "vs", "blob", "path"])


def blobs_of(b: list[int], kind: int, key: int, blobs: list[bytes], paths: list[str | None] | None = None) -> pa.RecordBatch:
    n = len(b)
    columns = [pa.array(b, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([key] * n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.array(blobs, pa.binary()), pa.array(paths or [None] * n, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["b", "kind", "key", "vs", "blob", "path"])


def messages(sender: int, kind: int, to: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """Keys and numbers for other buckets, packed by bucket."""
    order, runs = _runs(to.astype(np.int64))
    keys, values = keys[order], [v[order].astype(np.int64) for v in values]
    small = [v.astype(np.int32) if not len(v) or v.max() < 1 << 31 else v for v in values]
    return blobs_of([b for b, _, _ in runs], kind, sender, [pack_arrays(keys[a:z], *(v[a:z] for v in small)) for _, a, z in runs])


def received(rows: dict[int, list], kind: int, width: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(sender, keys, numbers)`` of every message."""
    out = []
    for part in rows.get(kind, []):
        for sender, raw in zip(part.column("key").to_pylist(), part.column("blob").to_pylist()):
            keys, *values = unpack_arrays(raw)
            out.append((sender, keys, np.stack([v.astype(np.int64) for v in values], 1) if len(keys) else np.zeros((0, width), np.int64)))
    return out


def write_file(folder: str, *arrays: np.ndarray) -> str:
    path = f"{folder}/{uuid.uuid4().hex}"
    fs, local = file_system(path)
    fs.create_dir(local.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(local, compression=None) as out:
        out.write(pack_arrays(*arrays))
    return path


def read_file(path: str) -> list[np.ndarray]:
    fs, local = file_system(path)
    with fs.open_input_stream(local, compression=None) as f:
        return unpack_arrays(f.read())


# ---- words, pairs and where they go


@dataclass(frozen=True)
class Routes:
    """Frequent words in order of their ids, their ranks and numbers of buckets, and how many buckets there are."""

    ids: np.ndarray
    rank: np.ndarray
    spread: np.ndarray
    buckets: int

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """A rank for frequent words, else the hash with its top bit set."""
        ids = hashes | TOP
        if not len(self.ids):
            return ids
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, self.rank[at], ids)

    def owner(self, word: np.ndarray) -> np.ndarray:
        return mix(word) % np.uint64(self.buckets)

    def bucket(self, h: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The bucket of each cell."""
        frequent_h = np.where(h < TOP, h, np.uint64(0)).astype(np.int64)
        part = mix(u) % self.spread[frequent_h] if len(self.spread) else np.uint64(0)
        hot = mix((h << np.uint64(32)) ^ part) % np.uint64(self.buckets)
        return np.where(u >= TOP, self.owner(u), np.where(h >= TOP, self.owner(h), hot)).astype(np.int64)


def tokens_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(codes, before, bounds, hashes)``: token ``i`` is ``hashes[codes[i]]`` after ``hashes[before[i]]``."""
    words = split_words(text, lower=True)
    rows = len(words.bounds) - 1
    hashes = np.concatenate((words.word_hashes(), [END_HASH, START_HASH])).astype(np.uint64)
    bounds = words.bounds + np.arange(rows + 1)
    codes = np.full(int(bounds[-1]), len(words), np.int64)
    if len(words.codes):
        codes[np.arange(len(words.codes)) + words.doc] = words.codes
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[bounds[:-1]] = len(words) + 1
    return codes, before, bounds, hashes


def routes_of(docs: DataFrame, hot: int, bucket: int) -> Routes:
    """Choose the frequent words of (text) from words that are frequent in some slices: which they are changes only where cells go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = -1
        for batch in batches:
            for part in slices(batch, size=SLICE):
                number += 1
                if number % PROPOSE:
                    continue
                words = split_words(part.column("text"), lower=True)
                n = np.bincount(words.codes, minlength=len(words))
                often = np.flatnonzero(n >= OFTEN)
                ids = words.word_hashes()[often] | TOP
                ids = np.concatenate((ids, [END_HASH | TOP, START_HASH | TOP, np.uint64(0)])).astype(np.uint64)
                size = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                ids = np.append(ids, np.uint64(1))
                n = np.concatenate((n[often], [part.num_rows, part.num_rows, len(words.codes) + part.num_rows, size]))
                yield pa.RecordBatch.from_pydict({"h": pa.array(ids.view(np.int64)), "n": pa.array(n)})

    counted = materialize(docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "lm-frequent")
    seen = {r["h"]: r["n"] for r in counted.where("h in (0, 1)").collect()}
    tokens, read = seen.get(0, 0), max(1, seen.get(1, 0))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0]["n"]
    buckets = max(1, int(-(-tokens * max(1.0, size / read) // bucket)))
    top = frequent(counted.where("h not in (0, 1)"), "n", hot).toArrow()
    ids, n = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    rank = np.empty(len(ids), np.uint64)
    rank[np.lexsort((ids, -n))] = np.arange(len(ids))
    spread = np.ones(len(ids), np.uint64)
    spread[rank.astype(np.int64)] = np.clip(-(-4 * buckets * n // max(1, tokens)), 1, buckets)
    order = np.argsort(ids)
    return Routes(ids[order], rank[order], spread, buckets)


def _split_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rare = ids >= TOP
    return np.where(rare, 0, ids + np.uint64(1)).astype(np.uint32), ids[rare]


def _join_ids(ranks: np.ndarray, rare: np.ndarray) -> np.ndarray:
    out = ranks.astype(np.uint64) - np.uint64(1)
    out[ranks == 0] = rare
    return out


def encode_pairs(h: np.ndarray, u: np.ndarray, *more: np.ndarray) -> bytes:
    new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return pack_arrays(*_split_ids(h[new]), np.diff(np.append(new, len(h))).astype(np.uint32), *_split_ids(u), *more)


def decode_pairs(raw: bytes) -> tuple[np.ndarray, ...]:
    ranks, rare, lengths, ranks_u, rare_u, *more = unpack_arrays(raw)
    return (np.repeat(_join_ids(ranks, rare), lengths), _join_ids(ranks_u, rare_u), *more)


def pair_key(h: np.ndarray, u: np.ndarray) -> np.ndarray:
    return mix(h + mix(u ^ np.uint64(0x9E3779B97F4A7C15)))


def _runs(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order by bucket, and ``(bucket, start, end)`` of each in it."""
    order = np.argsort(bucket.astype(np.uint16) if not len(bucket) or bucket.max() < 1 << 16 else bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    return order, list(zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]))


def gathered(rows: DataFrame, buckets: int, work: Callable[[int, dict[int, list]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``work(bucket, rows)`` for every bucket that has rows; the rows by kind, as batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, list]] = {}
        for batch in batches:
            b, kind = batch.column("b").to_numpy(), batch.column("kind").to_numpy()
            both = b.astype(np.int64) << 8 | kind
            for k in np.unique(both).tolist():
                part = batch.filter(pa.array(both == k))
                held.setdefault(k >> 8, {}).setdefault(k & 255, []).append(part)
        for bucket in sorted(held):
            yield from work(bucket, held.pop(bucket))
            give_back()

    return rows.repartitionById(buckets, "b").mapInArrow(run, ROWS)


def _numbers(parts: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(key, vs)`` of rows with numbers."""
    keys = [p.column("key").to_numpy().view(np.uint64) for p in parts]
    vs = [p.column("vs").flatten().to_numpy().reshape(-1, width) for p in parts]
    return (np.concatenate(keys), np.concatenate(vs)) if parts else (np.zeros(0, np.uint64), np.zeros((0, width), np.int64))


def _find(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in sorted ``known``, -1 where they are not in it."""
    if not len(known):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


def _by(ids: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, and their customers, kinds and kinds with one customer (cells that are empty count nothing)."""
    found, at = np.unique(ids, return_inverse=True)
    return found, np.stack([np.bincount(at, weights=w, minlength=len(found)).astype(np.int64) for w in (c, c > 0, c == 1)], 1)


# ---- counting


def count_cells(docs: DataFrame, routes, folder: str) -> DataFrame:
    """Count all cells of (text, train) and write those with two customers or more; rows with totals and paths."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way = routes.value
        for batch in batches:
            for part in slices(batch, size=SLICE):
                codes, before, bounds, hashes = tokens_of(part.column("text"))
                ids, width = way.number(hashes), len(hashes)
                train = np.repeat(part.column("train").to_numpy(zero_copy_only=False), np.diff(bounds))
                key, rare = codes * width + before, ids >= TOP
                k, n = np.unique(key[train], return_counts=True)
                # Buckets of rare contexts ask for the totals of their rare words, also of those only scored.
                extra = np.unique(key[~train & rare[codes] & rare[before]])
                extra = extra[_find(k, extra) < 0]
                k, n = np.concatenate((k, extra)), np.concatenate((n, np.zeros(len(extra), np.int64))).astype(np.uint32)
                h, u = np.divmod(k, max(1, width))
                h, u = ids[h], ids[u]
                order, runs = _runs(way.bucket(h, u))
                h, u, n = h[order], u[order], n[order]
                yield blobs_of([b for b, _, _ in runs], BLOB, 0, [encode_pairs(h[a:z], u[a:z], n[a:z]) for _, a, z in runs])

    def merge(b: int, rows: dict[int, list]) -> Iterator[pa.RecordBatch]:
        way = routes.value
        found = [decode_pairs(raw) for p in rows.pop(BLOB) for raw in p.column("blob").to_pylist()]
        h, u, n = (np.concatenate(x) for x in zip(*found))
        del found
        key = pair_key(h, u)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        c = np.add.reduceat(n[order].astype(np.int64), first)
        h, u = h[order[first]], u[order[first]]
        hot_h, hot_u = h < TOP, u < TOP
        for kind, ids, at in ((WORD, h, hot_h), (CONTEXT, u, hot_u)):
            found, sums = _by(ids[at], c[at])
            yield messages(b, kind, part_of(found, len(way.ids)), found, *sums.T)
        both = c[hot_h & hot_u & (c > 1)]
        size, many = np.unique(np.floor(np.log2(both) * 8).astype(np.int64), return_counts=True)
        yield rows_of(b, SIZES, size, many)
        shared, sums = _by(h[~hot_h & ~hot_u], c[~hot_h & ~hot_u])
        several = np.isin(shared, h[~hot_h & ~hot_u & (c > 1)])
        yield messages(b, RARE, way.owner(shared), shared, *sums.T, several)
        own, own_sums = _by(h[~hot_h & hot_u], c[~hot_h & hot_u])
        contexts, context_sums = _by(u[~hot_u & (c > 0)], c[~hot_u & (c > 0)])
        more = c > 1
        path = write_file(folder, h[more], u[more], c[more], own, own_sums.ravel(), contexts, context_sums.ravel(), shared)
        yield rows_of(b, TOTAL, np.zeros(1), np.array([[c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum()]]))
        yield blobs_of([b], FILE, 0, [b""], [path])

    found = docs.select("text", "train").mapInArrow(scan, ROWS)
    return materialize(gathered(found, routes.value.buckets, merge), "lm-cells")


class Bucket:
    """The files of a bucket: cells with several customers, rare words and contexts whose totals are here, and tables so far."""

    def __init__(self, paths: str):
        cells, words, *tables = paths.split("\n")
        h = np.zeros(0, np.uint64)
        empty = [h, h, np.zeros(0, np.int64), h, np.zeros(0, np.int64), h, np.zeros(0, np.int64), h]
        self.h, self.u, self.c, self.own, own_sums, self.contexts, context_sums, self.shared = read_file(cells) if cells else empty
        self.context_sums = context_sums.reshape(-1, 3)
        if words:
            self.own, own_sums, self.asked, self.rare = read_file(words)
        self.own_sums = own_sums.reshape(-1, 3)
        self.tables = [x.astype(np.int64) for x in read_file(tables[0])] if tables else [np.ones(len(self.h), np.int64)]
        self.hot_h, self.hot_u = self.h < TOP, self.u < TOP
        self.here = ~self.hot_h & self.hot_u  # cells that count for the words of this bucket
        self.away = ~self.hot_h & ~self.hot_u
        self.word = _find(self.own, self.h[self.here])
        self.context = _find(self.contexts, self.u[~self.hot_u])

    def own_tables(self, t: np.ndarray) -> np.ndarray:
        return self.own_sums[:, 2] + np.bincount(self.word, weights=t[self.here], minlength=len(self.own)).astype(np.int64)

    def context_tables(self, t: np.ndarray) -> np.ndarray:
        return self.context_sums[:, 2] + np.bincount(self.context, weights=t[~self.hot_u], minlength=len(self.contexts)).astype(np.int64)

    def away_tables(self, words: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Tables in this bucket of rare words of other buckets (those of single customers are known there)."""
        at = _find(words, self.h[self.away])
        return np.bincount(at[at >= 0], weights=t[self.away][at >= 0], minlength=len(words)).astype(np.int64)

    def hot_sums(self, b: int, ts: list[np.ndarray], n_hot: int) -> Iterator[pa.RecordBatch]:
        """Tables of frequent words and contexts, and of all, in cells with several customers."""
        for kind, ids, at in ((WORD, self.h, self.hot_h), (CONTEXT, self.u, self.hot_u)):
            found, inverse = np.unique(ids[at], return_inverse=True)
            yield messages(b, kind, part_of(found, n_hot), found, *(np.bincount(inverse, weights=t[at], minlength=len(found)) for t in ts))
        yield rows_of(b, TOTAL, np.zeros(1), np.array([[t.sum() for t in ts]]))


def _sums(rows: DataFrame, kind: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals by key, on the driver: keys are ranks of frequent words or sizes, whose number is fixed."""
    got = rows.where(F.col("kind") == kind).groupBy("key").agg(*(F.sum(F.col("vs")[k]).alias(f"v{k}") for k in range(width))).toArrow()
    return got["key"].to_numpy(), np.column_stack([got[f"v{k}"].to_numpy() for k in range(width)]) if got.num_rows else np.zeros((0, width), np.int64)


def part_of(ranks: np.ndarray, n_hot: int) -> np.ndarray:
    """Which of ``PARTS`` tasks adds up a frequent word's totals."""
    return ranks.astype(np.int64) * PARTS // max(1, n_hot)


def _hot_totals(rows: DataFrame, kind: int, width: int, n_hot: int) -> np.ndarray:
    """Totals of frequent words by rank (width x words), added up by ``PARTS`` tasks from what buckets sent."""

    def add(part: int, sent: dict[int, list]) -> Iterator[pa.RecordBatch]:
        found = received(sent, kind, width)
        keys, at = np.unique(np.concatenate([k for _, k, _ in found]), return_inverse=True)
        values = np.concatenate([v for _, _, v in found])
        yield messages(part, kind, np.zeros(len(keys)), keys, *(np.bincount(at, weights=v, minlength=len(keys)) for v in values.T))

    out = np.zeros((width, n_hot), np.int64)
    for r in gathered(rows.where(F.col("kind") == kind), PARTS, add).select("blob").collect():  # a row per part
        keys, *values = unpack_arrays(r["blob"])
        out[:, keys.astype(np.int64)] = np.stack(values)
    return out


@dataclass(frozen=True)
class Fitted:
    """The seated model. ``words``, ``contexts``: customers and, by sample, tables of frequent ones by rank."""

    routes: Routes
    rows: DataFrame
    words: np.ndarray
    contexts: np.ndarray
    roots: list[float]
    customers: int
    n_words: int
    discount: float
    root_discount: float
    pairs: np.ndarray
    pair_log: np.ndarray

    @property
    def norm(self) -> float:
        return self.customers + 0.5 * (self.n_words + 1)

    def base(self, customers: np.ndarray) -> np.ndarray:
        return np.rint(np.log10((customers + 0.5) / self.norm) * SCALE).astype(np.int64)

    def log(self, c, t, cu, tu, tw) -> np.ndarray:
        return log_probability(c, t, cu, tu, tw, self.roots, self.n_words, self.discount, self.root_discount)


def _answers(sent: DataFrame) -> DataFrame:
    """The sum of what all buckets sent about a word, to each of them."""
    total = sent.groupBy("key").agg(F.sum(F.col("vs")[0]).alias("v"))
    found = sent.select("b", "key").join(total, "key")
    return found.select("b", F.lit(REPLY).alias("kind"), "key", F.array("v").alias("vs"), F.lit(None).cast("binary").alias("blob"), F.lit(None).cast("string").alias("path"))


def _path_of(rows: dict[int, list]) -> str:
    paths = [p for part in rows.get(FILE, []) for p in part.column("path").to_pylist()]
    return paths[0] if paths else "\n"


def fit(docs: DataFrame, rounds: int = 2, samples: int = 3, seed: int = 17, hot: int = HOT, bucket: int = BUCKET, hot_pairs: int = HOT_PAIRS) -> Fitted:
    """Learn from the rows of ``docs`` (text, train) with ``train``; ``rounds`` settle before the samples."""
    spark = docs.sparkSession
    folder, routes = new_folder(spark, "lm-files"), routes_of(docs, hot, bucket)
    sent = spark.sparkContext.broadcast(routes)
    n_hot, buckets = len(routes.ids), routes.buckets
    cells = count_cells(docs, sent, folder)
    customers, n_cells, singles, twos = (int(v) for v in _sums(cells, TOTAL, 4)[1].sum(axis=0))
    word_c, word_kinds, word_single = _hot_totals(cells, WORD, 3, n_hot)
    context_c, context_kinds, context_single = _hot_totals(cells, CONTEXT, 3, n_hot)
    size, many = _sums(cells, SIZES, 1)
    room, cut = hot_pairs, None
    for s, m in sorted(zip(size.tolist(), many.ravel().tolist()), reverse=True):
        if m > room:
            break
        room, cut = room - m, s

    def complete(b: int, rows: dict[int, list]) -> Iterator[pa.RecordBatch]:
        path = _path_of(rows)
        here = Bucket(path if path.count("\n") else f"{path}\n")
        sent = received(rows, RARE, 4)
        key, vs = (np.concatenate([x[k] for x in sent]) if sent else e for k, e in ((1, np.zeros(0, np.uint64)), (2, np.zeros((0, 4), np.int64))))
        own, at = np.unique(np.concatenate((here.own, key)), return_inverse=True)
        sums = np.stack([np.bincount(at, weights=w, minlength=len(own)).astype(np.int64) for w in np.concatenate((here.own_sums, vs[:, :3])).T], 1)
        asked = np.unique(key[vs[:, 3] > 0])
        words = write_file(folder, own, sums.ravel(), asked, np.unique(key))
        known = sums[:, 0] > 0
        yield rows_of(b, TOTAL, np.zeros(1), np.array([[known.sum(), (sums[:, 1] == 1).sum(), (sums[:, 1] == 2).sum()]]))
        # At first every cell has one table: a word has as many as it has kinds.
        for sender, mine, numbers in [(b, asked, np.ones((len(asked), 4))), *sent]:
            mine = mine[numbers[:, 3] > 0]
            yield messages(b, ANSWER, np.full(len(mine), sender), mine, sums[_find(own, mine), 1])
        yield blobs_of([b], FILE, 0, [b""], [f"{path.split(chr(10))[0]}\n{words}"])

    # Rare words' totals are completed in their own buckets by their cells in rare contexts.
    owned = materialize(gathered(cells.where(F.col("kind").isin(FILE, RARE)), buckets, complete), "lm-words")
    n_rare, rare_one, rare_two = (int(v) for v in _sums(owned, TOTAL, 3)[1].sum(axis=0))
    n_words = n_rare + int((word_c > 0).sum())
    discount = discount_of(singles, twos)
    root_discount = discount_of(rare_one + int((word_kinds == 1).sum()), rare_two + int((word_kinds == 2).sum()))

    state, replies = owned.where(F.col("kind") == FILE), owned.where(F.col("kind") == ANSWER)
    of_words, of_contexts, root = word_kinds, context_kinds, float(n_cells)
    for number in range(rounds + samples):
        now = spark.sparkContext.broadcast((of_words, of_contexts, root))

        def draw(b: int, rows: dict[int, list], number: int = number, now=now) -> Iterator[pa.RecordBatch]:
            path = _path_of(rows)
            here, (hot_words, hot_contexts, all_tables) = Bucket(path), now.value
            told, vs = _numbers(rows.get(REPLY, []), 1)
            first = received(rows, ANSWER, 1)
            told, vs = (np.concatenate([x, *(y[k] for y in first)]) for k, x in ((1, told), (2, vs)))
            order = np.argsort(told)
            told, vs = told[order], vs[order, 0]
            t = here.tables[0]
            own = here.own_tables(t)
            at = _find(told, here.own)
            own = np.where(at >= 0, vs[at] if len(vs) else 0, own)
            of_word, of_context = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
            of_word[here.hot_h] = hot_words[here.h[here.hot_h].astype(np.int64)]
            of_word[here.here] = own[here.word]
            of_word[here.away] = vs[_find(told, here.h[here.away])]
            of_context[here.hot_u] = hot_contexts[here.u[here.hot_u].astype(np.int64)]
            of_context[~here.hot_u] = here.context_tables(t)[here.context]
            key = pair_key(routes_key(here.h, sent.value), routes_key(here.u, sent.value))
            moves = np.flatnonzero(uniform(seed, number, 3, key) < 0.5) if number else np.arange(len(t))
            k = key[moves]
            new = t.copy()
            new[moves] = draw_tables(here.c[moves], t[moves], of_word[moves], of_context[moves], all_tables, discount, root_discount, uniform(seed, number, 1, k), uniform(seed, number, 2, k), 3 if number else 12)
            kept = [*here.tables[1:], new] if number >= rounds else []
            cells_path, words_path, *_ = path.split("\n")
            yield from here.hot_sums(b, [new], n_hot)
            yield rows_of(b, ASKED, here.asked, here.own_tables(new)[_find(here.own, here.asked)])
            away = np.unique(here.h[here.away])
            yield rows_of(b, ASKED, away, here.away_tables(away, new))
            yield blobs_of([b], FILE, 0, [b""], [f"{cells_path}\n{words_path}\n{write_file(folder, new.astype(np.int32), *(x.astype(np.int32) for x in kept))}"])

        drawn = materialize(gathered(state.unionByName(replies), buckets, draw), "lm-round")
        state, replies = drawn.where(F.col("kind") == FILE), _answers(drawn.where(F.col("kind") == ASKED))
        of_words = word_single + _hot_totals(drawn, WORD, 1, n_hot)[0]
        of_contexts = context_single + _hot_totals(drawn, CONTEXT, 1, n_hot)[0]
        root = float(singles + _sums(drawn, TOTAL, 1)[1].sum())

    def finish(b: int, rows: dict[int, list]) -> Iterator[pa.RecordBatch]:
        path = _path_of(rows)
        here = Bucket(path)
        ts = here.tables[1:]
        yield from here.hot_sums(b, ts, n_hot)
        yield messages(b, SHARED, sent.value.owner(here.shared), here.shared, *(here.away_tables(here.shared, t) for t in ts))
        if cut is not None:
            pick = here.hot_h & here.hot_u & (np.floor(np.log2(here.c) * 8).astype(np.int64) >= cut)
            yield rows_of(b, PAIR, here.h[pick] << np.uint64(32) | here.u[pick], np.stack([here.c[pick], *(t[pick] for t in ts)], 1))
        yield blobs_of([b], FILE, 0, [b""], [path])

    last = materialize(gathered(state, buckets, finish), "lm-samples")
    words = np.concatenate(([word_c], word_single + _hot_totals(last, WORD, samples, n_hot)))
    contexts = np.concatenate(([context_c], context_single + _hot_totals(last, CONTEXT, samples, n_hot)))
    roots = [float(singles + v) for v in _sums(last, TOTAL, samples)[1].sum(axis=0)]

    def answer(b: int, rows: dict[int, list]) -> Iterator[pa.RecordBatch]:
        """What other buckets need of this one's rare words: customers and, by sample, tables."""
        path = _path_of(rows)
        here, asking = Bucket(path), received(rows, SHARED, samples)
        totals = np.stack([here.own_sums[:, 0], *(here.own_tables(t) for t in here.tables[1:])], 1)[_find(here.own, here.rare)]
        for _, keys, numbers in asking:
            totals[_find(here.rare, keys), 1:] += numbers
        for sender, keys in [(b, here.rare), *((x, k) for x, k, _ in asking)]:
            yield messages(b, ANSWER, np.full(len(keys), sender), keys, *totals[_find(here.rare, keys)].T)
        yield blobs_of([b], FILE, 0, [b""], [path])

    rows = materialize(gathered(last.where(F.col("kind").isin(FILE, SHARED)), buckets, answer), "lm-answers")
    top = last.where(F.col("kind") == PAIR).select("key", "vs").toArrow()  # at most ``hot_pairs``
    key = top["key"].to_numpy().view(np.uint64)
    vs = np.array(top["vs"].to_pylist(), np.int64).reshape(len(key), 1 + samples)
    order = np.argsort(key)
    key, vs = key[order], vs[order]
    fitted = Fitted(routes, rows, words, contexts, roots, customers, n_words, discount, root_discount, key, np.zeros(0, np.int64))
    if len(key):
        h, u = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        log = fitted.log(vs[:, 0], vs[:, 1:].T, contexts[0, u], contexts[1:, u], words[1:, h])
        fitted = Fitted(**{**fitted.__dict__, "pair_log": log})
    return fitted


def routes_key(ids: np.ndarray, routes: Routes) -> np.ndarray:
    """Hashes of words again, so that random numbers do not depend on ranks."""
    by_rank = np.empty(len(routes.ids), np.uint64)
    by_rank[routes.rank.astype(np.int64)] = routes.ids
    hot = ids < TOP
    out = ids.copy()
    out[hot] = by_rank[ids[hot].astype(np.int64)]
    return out


# ---- scoring


def score(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, train), the rows that ``fit`` saw: doc_id, n_tokens, n_known, base_score, score (log10 probabilities)."""
    spark = docs.sparkSession
    rows, model = fitted.rows, Fitted(**{**fitted.__dict__, "rows": None})
    sent = spark.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, number = sent.value, 0
        partition = TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, size=SLICE):
                name = partition << 32 | number
                number += 1
                codes, before, bounds, hashes = tokens_of(part.column("text"))
                ids, width, n_docs = m.routes.number(hashes), len(hashes), part.num_rows
                hot = ids < TOP
                count = np.zeros(width, np.int64)
                count[hot] = m.words[0, ids[hot].astype(np.int64)]
                known = run_sums((count > 0)[codes].astype(np.int64), bounds)
                base = run_sums(np.where(hot, m.base(count), 0)[codes], bounds)
                k, back = np.unique(codes * width + before, return_inverse=True)
                h, u = np.divmod(k, width)
                h, u = ids[h], ids[u]
                at = np.where((h < TOP) & (u < TOP), _find(m.pairs, h << np.uint64(32) | u), -1)
                logs = np.where(at >= 0, m.pair_log[at] if len(m.pair_log) else 0, 0)
                total = run_sums(logs[back], bounds)
                doc_id = part.column("doc_id")
                ids_there = pc.fill_null(doc_id, 0).to_numpy(zero_copy_only=False).astype(np.int64)
                known_id = pc.is_valid(doc_id).to_numpy(zero_copy_only=False).astype(np.uint8)
                info = pack_arrays(ids_there, known_id, np.diff(bounds), known, base, total)
                yield blobs_of([int(mix(np.array([name]))[0] % np.uint64(m.routes.buckets))], DOCS, name, [info])
                rest = np.flatnonzero(at < 0)
                if not len(rest):
                    continue
                order, runs = _runs(m.routes.bucket(h[rest], u[rest]))
                rest = rest[order]
                place = np.full(len(k), -1)
                place[rest] = np.arange(len(rest))
                doc = np.repeat(np.arange(n_docs), np.diff(bounds))
                train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
                pos = place[back]
                there = pos >= 0
                inc, n = np.unique(pos[there] * n_docs + doc[there], return_counts=True)
                pair, doc = np.divmod(inc, n_docs)
                learned = np.bincount(pair, weights=n * train[doc], minlength=len(rest)).astype(np.uint32)
                first = np.searchsorted(pair, np.arange(len(rest) + 1))
                h, u, n_inc, doc, n = h[rest], u[rest], np.diff(first).astype(np.uint32), doc.astype(np.uint32), n.astype(np.uint32)
                packed = [encode_pairs(h[a:z], u[a:z], learned[a:z], n_inc[a:z], doc[first[a] : first[z]], n[first[a] : first[z]]) for _, a, z in runs]
                yield blobs_of([b for b, _, _ in runs], BLOB, name, packed)

    def look_up(b: int, rows: dict[int, list]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        yield from rows.pop(DOCS, [])
        blobs = [(key, raw) for p in rows.pop(BLOB, []) for key, raw in zip(p.column("key").to_pylist(), p.column("blob").to_pylist())]
        if not blobs:
            return
        names = [k for k, _ in blobs]
        found = [decode_pairs(raw) for _, raw in blobs]
        del blobs
        h, u, learned = (np.concatenate([f[k] for f in found]) for k in range(3))
        incidences = [f[3:] for f in found]
        sizes = np.array([len(f[0]) for f in found])
        del found
        key = pair_key(h, u)
        order = np.argsort(key)
        new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        first = np.flatnonzero(new)
        cell = np.empty(len(key), np.int64)
        cell[order] = np.cumsum(new) - 1
        c = np.add.reduceat(learned[order].astype(np.int64), first)
        h, u, key = h[order[first]], u[order[first]], key[order[first]]
        log, base, known = cell_logs(m, Bucket(_path_of(rows)), received(rows, ANSWER, 1 + len(m.roots)), h, u, c, key)
        ends = np.cumsum(sizes)
        for name, start, end, (n_inc, doc, n) in zip(names, ends - sizes, ends, incidences):
            at = np.repeat(cell[start:end], n_inc)
            seen, back = np.unique(doc, return_inverse=True)
            sums = [np.bincount(back, weights=v[at] * n.astype(np.int64), minlength=len(seen)).astype(np.int64) for v in (log, base, known)]
            yield blobs_of([b], BLOB, name, [pack_arrays(seen.astype(np.uint32), *sums)])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for kind, name, raw in zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist(), batch.column("blob").to_pylist()):
                held.setdefault(name, [None, []])
                if kind == DOCS:
                    held[name][0] = raw
                else:
                    held[name][1].append(raw)
        for name in sorted(held):
            info, parts = held.pop(name)
            ids, valid, tokens, known, base, log = unpack_arrays(info)
            known, base, log = known.copy(), base.copy(), log.copy()
            for raw in parts:
                at, *sums = unpack_arrays(raw)
                for mine, more in zip((log, base, known), sums):
                    mine[at] += more
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, mask=valid == 0), "n_tokens": pa.array(tokens), "n_known": pa.array(known), "base_score": pa.array(base / SCALE), "score": pa.array(log / SCALE)})

    buckets = fitted.routes.buckets
    asked = docs.select("doc_id", "text", "train").mapInArrow(scan, ROWS)
    parts = gathered(asked.unionByName(rows), buckets, look_up)
    return parts.select("kind", "key", "blob").repartition(buckets, "key").mapInArrow(add_up, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def cell_logs(m: Fitted, here: Bucket, told: list[tuple[int, np.ndarray, np.ndarray]], h: np.ndarray, u: np.ndarray, c: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of cells, and the base's and whether it is known for rare words (0 for frequent ones)."""
    samples, n = len(m.roots), len(h)
    t = np.tile((c == 1).astype(np.int64), (samples, 1))
    order = np.argsort(pair_key(here.h, here.u))
    several = np.flatnonzero(c > 1)
    at = order[_find(pair_key(here.h, here.u)[order], key[several])] if len(several) else several
    ts = here.tables[1:] or [np.zeros(0, np.int64)] * samples
    for s in range(samples):
        t[s, several] = ts[s][at]
    hot_h, hot_u = h < TOP, u < TOP
    word, context = np.zeros((1 + samples, n), np.int64), np.zeros((1 + samples, n), np.int64)
    word[:, hot_h] = m.words[:, h[hot_h].astype(np.int64)]
    context[:, hot_u] = m.contexts[:, u[hot_u].astype(np.int64)]
    at = _find(here.contexts, u[~hot_u])
    values = np.stack([here.context_sums[:, 0], *(here.context_tables(x) for x in ts)])
    context[:, ~hot_u] = np.where(at >= 0, values[:, at] if values.shape[1] else 0, 0)
    keys, vs = (np.concatenate([x[k] for x in told]) if told else e for k, e in ((1, np.zeros(0, np.uint64)), (2, np.zeros((0, 1 + samples), np.int64))))
    order = np.argsort(keys)
    keys, vs = keys[order], vs[order].T
    own = np.stack([here.own_sums[:, 0], *(here.own_tables(x) for x in ts)])
    rare = np.flatnonzero(~hot_h)
    at, mine = _find(keys, h[rare]), _find(here.own, h[rare])
    word[:, rare] = np.where(at >= 0, vs[:, at] if vs.shape[1] else 0, np.where((mine >= 0) & hot_u[rare], own[:, mine] if own.shape[1] else 0, 0))
    log = m.log(c, t, context[0], context[1:], word[1:])
    base = np.where(hot_h, 0, m.base(word[0]))
    return log, base, np.where(hot_h, 0, word[0] > 0).astype(np.int64)
