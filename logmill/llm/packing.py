"""Best-fit decreasing packing of token sequences, over all documents at once.

Documents longer than a sequence are cut into full pieces and a rest.  Best-fit
decreasing (longest piece first, into the open sequence with the least room that
still takes it) sees a piece by its length alone, and lengths are whole numbers up
to the sequence's, so it is planned on the driver over the histogram of lengths: a
segment tree over the remaining capacities finds the tightest open sequences in
logarithmic time, and all pieces of one length and all open sequences of one room
are handled as a run.  The plan is what packing piece by piece gives, its size is
bounded by the capacity and not by the corpus, and nothing is packed in parts.

Pieces then take their places: the k-th piece of a length has the k-th place of that
length.  Pieces are dealt by a hash of their row into groups of about ``GROUP``;
counts per group and length give the rank of a group's first piece of a length.
Pieces of one length are ranked by group, row hash and piece, so they are
interchangeable and a hot length is spread like any other.

Null or empty text: one piece with the end id alone.  Repeated ``doc_id``s are
packed as separate documents; columns but doc_id and text are not looked at, so
their names do not matter.  A very long text is encoded whole, in its worker's
memory.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmill.llm.arrays import slices
from logmill.llm.storage import materialize
from logmill.llm.tokenize import ENCODE_BYTES, END_ID, word_encoder

GROUP = 32_768


class CapacityTree:
    """Segment tree over the capacities 0..most; a leaf counts the open bins with that much room and holds them as runs of numbers."""

    def __init__(self, most: int):
        self.size = 1 << max(1, most).bit_length()
        self.count = [0] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]

    def _change(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def add(self, room: int, first: int, n: int) -> None:
        """Open ``n`` bins numbered from ``first`` with this room."""
        if n and room:
            self.runs[room].append((first, n))
            self._change(room, n)

    def tightest(self, least: int) -> int | None:
        """The smallest room of ``least`` or more that an open bin has."""
        count, i = self.count, least + self.size
        if not count[i]:
            while not (i & 1 == 0 and count[i + 1]):  # climb until a right sibling has bins
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        return i - self.size

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Remove ``(first, n)``: up to ``most`` bins of one run with this room."""
        first, n = self.runs[room].pop()
        if n > most:
            self.runs[room].append((first + most, n - most))
            n = most
        self._change(room, -n)
        return first, n


@dataclass(frozen=True)
class Plan:
    """Places of all pieces of each length, in runs.

    Run ``i`` takes the pieces of ``length[i]`` from the ``rank[i]``-th on: ``each[i]``
    one after the other from ``offset[i]`` in bin ``first[i]``, then in the next bin.
    """

    length: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    bins: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(bin, offset)`` of the ``rank``-th pieces of a length."""
        if not len(length):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Runs are ordered by falling length, then by rank; both fit into one key (ranks below 2**50).
        key = (-self.length << 50) + self.rank
        at = np.searchsorted(key, (-length.astype(np.int64) << 50) + rank, side="right") - 1
        turn, place = np.divmod(rank - self.rank[at], self.each[at])
        return self.first[at] + turn, self.offset[at] + place * length


def plan_best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing of ``counts[length]`` pieces of each length up to ``capacity``."""
    tree, used, out = CapacityTree(capacity), 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                each = min(left, capacity // length)
                first, n = used, left // each
                used += n
            else:
                # A bin just used is the tightest again, until the length no longer fits.
                each = min(left, room // length)
                first, n = tree.take(room, left // each)
            out.append((length, rank, first, each, capacity - room))
            tree.add(room - each * length, first, n)
            rank += n * each
            left -= n * each
    columns = np.array(out, np.int64).reshape(-1, 5).T
    return Plan(*columns, used)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of each length; bins are numbered from 0."""
    kinds, counts = np.unique(lengths, return_counts=True)
    plan = plan_best_fit(dict(zip(kinds.tolist(), counts.tolist())), capacity)
    return plan.places(lengths, _rank_in_length(lengths))


def _rank_in_length(lengths: np.ndarray) -> np.ndarray:
    """How many equal lengths stand before each."""
    order = np.argsort(lengths, kind="stable")
    x = lengths[order]
    rank = np.empty(len(x), np.int64)
    rank[order] = np.arange(len(x)) - np.searchsorted(x, x)
    return rank


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids as bytes) of every piece of every text."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, spread long" + (", ids binary" if with_ids else "")
    rows = docs.select("doc_id", "text", F.xxhash64(F.monotonically_increasing_id()).alias("spread"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, size=ENCODE_BYTES):
                ids, bounds = encoder.encode(part.column("text"), END_ID)
                ids = ids.astype("<u4", copy=False)
                total = np.diff(bounds)
                n = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, total[row] - start)
                view = memoryview(ids.tobytes())
                first = 4 * (bounds[:-1][row] + start)
                raw = [view[a:b] for a, b in zip(first.tolist(), (first + 4 * length).tolist())]
                take = pa.array(row)
                out = {
                    "doc_id": part.column("doc_id").take(take),
                    "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                    "spread": part.column("spread").take(take),
                }
                if with_ids:
                    out["ids"] = pa.array([bytes(x) for x in raw], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = 4096, group: int = GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` and a row hash ``spread``.

    Only lengths are dealt to the groups; ids, if there are any, are joined again.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group))
    whole = [f.name for f in pieces.schema if f.name not in ("spread", "ids")]
    dealt = pieces.drop("ids").withColumn("_group", F.pmod(F.xxhash64("spread", "piece"), F.lit(groups)))
    counts = materialize(dealt.groupBy("_group", F.col("length").alias("_length")).agg(F.count(F.lit(1)).alias("_n")), "piece-counts")
    total = counts.groupBy("_length").agg(F.sum("_n").alias("n")).collect()  # a row per length: as many as the capacity at most
    sent = spark.sparkContext.broadcast(plan_best_fit({r["_length"]: r["n"] for r in total}, capacity))
    before = F.sum("_n").over(Window.partitionBy("_length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("_group", "_length", F.coalesce(before, F.lit(0)).alias("_first"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema if f.name != "_group")

    def place(rows: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "spread", "piece"], ignore_index=True).drop(columns=["_group"])
        length = rows["length"].to_numpy()
        starts = first.set_index("_length")["_first"].loc[length].to_numpy() if len(rows) else length
        rows["sequence_id"], rows["offset"] = sent.value.places(length, starts + _rank_in_length(length))
        return rows

    placed = dealt.groupBy("_group").cogroup(first.groupBy("_group")).applyInPandas(place, f"{schema}, sequence_id long, offset long")
    if "ids" not in pieces.columns:
        return placed.select(*whole, "sequence_id", "offset")
    return placed.join(pieces.select("spread", "piece", "ids"), ["spread", "piece"]).select(*whole, "ids", "sequence_id", "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids, doc_ids``: every sequence put together from packed pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    grouped = placed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))
    return grouped.select("sequence_id", "n_tokens", joined.alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))
