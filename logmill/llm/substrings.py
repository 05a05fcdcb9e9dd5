"""Removal of repeated passages: Rabin-Karp hashes of every 35-word window, counted in Spark.

A window that occurs twice contains the same smallest 17-word hash both times, so
windows whose smallest 17-word hash is unique in the corpus are unique as well.

1. Every window's smallest 17-word Rabin-Karp hash (its anchor) is counted; the
   anchors found at two places or more go into a Bloom filter of fixed size.
2. The windows behind these anchors are hashed and counted.  A window that a task
   sees twice is known to be repeated; from then on the task only remembers that it
   has said so.  So a window that is everywhere has about two rows per task, however
   often it occurs.  The memory has a fixed size; what falls out of it costs a row
   more and changes no result.
3. Repeated windows merge into maximal intervals of each text, which go.

Words are runs without the six ASCII white-space characters, unchanged.  Null
text: no words.  Rows are told apart by a 64-bit hash of id and text; rows equal
in both have equal windows and so one outcome.  Word and window hashes have 64
bits: two different windows are taken for equal with a chance of about
``windows**2 / 2**65``.  An empty table gives no rows.  Columns but doc_id and text are
left out, so their names do not matter.  A very long text is hashed in one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmill.llm.arrays import inside, mix, rolling, slices, sliding, split_words
from logmill.llm.frequent import Bloom
from logmill.llm.storage import materialize

WIDTH, ANCHOR = 35, 17
#: Bits of the Bloom filters: 2**26 are 8 MB.
LOG2_BITS = 26


#: Places of a task's memory.
SLOTS = 1 << 19


class Memory:
    """Windows that a task has met before, and whether it has reported them as repeated; a fixed number, newer ones displace older ones."""

    def __init__(self, slots: int = SLOTS):
        # An empty place holds a value that belongs to another one.
        self.hash, self.told = np.arange(slots, dtype=np.uint64) ^ np.uint64(1), np.zeros(slots, bool)

    def meet(self, window: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(known, tell)`` of distinct windows, of which ``twice`` are in this slice more than once: known to be repeated, and to be reported now."""
        slot = (window & np.uint64(len(self.hash) - 1)).astype(np.int64)
        met = self.hash[slot] == window
        known, tell = met | twice, (met | twice) & ~(met & self.told[slot])
        # Of several windows with one slot the last stays.
        order = np.argsort(slot, kind="stable")
        last = order[np.flatnonzero(np.append(np.diff(slot[order]), 1))] if len(order) else order
        self.hash[slot[last]], self.told[slot[last]] = window[last], known[last]
        return known, tell


class ShardWindows:
    """Word hashes of a shard with the anchor of every window."""

    def __init__(self, text: pa.Array, width: int, anchor: int):
        self.words = split_words(text)
        n = len(self.words.codes)
        self.hashes = self.words.hashes()
        self.whole = inside(self.words.bounds, width, n)
        self.grams = rolling(self.hashes, anchor)
        self.span = width - anchor + 1
        self.least = sliding(self.grams, self.span, np.minimum) if n >= width else np.zeros(0, np.uint64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors and at how many places each is one."""
        if not self.whole.any():
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        edge = np.zeros(self.span - 1, np.uint64)
        most = sliding(np.concatenate((edge, np.where(self.whole, self.least, np.uint64(0)), edge)), self.span, np.maximum)
        return np.unique(self.grams[(self.grams == most) & (most > 0)], return_counts=True)


def keyed(docs: DataFrame, name: str = "_key") -> DataFrame:
    """Add a hash of id and text that is the same in every pass."""
    return docs.withColumn(name, F.xxhash64("doc_id", "text"))


def repeated_anchors(docs: DataFrame, width: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                a, n = ShardWindows(part.column("text"), width, anchor).anchors()
                yield pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "n": pa.array(np.minimum(n, 2).astype(np.int64))})

    counted = docs.select("text").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    return counted.where("n > 1").select("a")


def repeated_windows(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, log2_bits: int = LOG2_BITS, slots: int = SLOTS) -> DataFrame:
    """``_key, start, n``: runs of windows that occur elsewhere too, by first word; runs may be cut up."""
    bloom = Bloom.of(repeated_anchors(docs, width, anchor), F.col("a"), log2_bits)
    sent = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(slots)
        for batch in batches:
            for part in slices(batch):
                w = ShardWindows(part.column("text"), width, anchor)
                at = np.flatnonzero(w.whole)
                least = w.least[at]
                change = np.ones(len(at), bool)
                change[1:] = least[1:] != least[:-1]
                may = sent.value.has(least[change])[np.cumsum(change) - 1] if len(at) else np.zeros(0, bool)
                at = at[may]
                window = rolling(w.hashes, width)[at]
                doc = w.words.doc[at] if len(at) else at
                distinct, back, n = np.unique(window, return_inverse=True, return_counts=True)
                repeated, tell = memory.meet(distinct, n > 1)
                twice = repeated[back]
                # Those known to be repeated: as runs, under a key that spreads them, plus one row that says so.
                known, kdoc = at[twice], doc[twice]
                new = np.ones(len(known), bool)
                new[1:] = (np.diff(known) != 1) | (np.diff(kdoc) != 0)
                first = np.flatnonzero(new)
                runs = np.diff(np.append(first, len(known)))
                present = distinct[tell]
                once, odoc = at[~twice], doc[~twice]
                key = part.column("_key").to_numpy(zero_copy_only=False)
                base = w.words.bounds
                kkey, okey = key[kdoc[first]], key[odoc]
                kstart = known[first] - base[kdoc[first]]
                spread = mix(kkey.view(np.uint64) ^ mix(kstart.astype(np.uint64)))
                z = np.zeros(len(present), np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "h": pa.array(np.concatenate((spread, present, window[~twice])).view(np.int64)),
                        "_key": pa.array(np.concatenate((kkey, z, okey)).astype(np.int64)),
                        "start": pa.array(np.concatenate((kstart, z, once - base[odoc])).astype(np.int32)),
                        # n > 0: a run known to be repeated; 0: the window is repeated in a task; -1: to be counted
                        "n": pa.array(np.concatenate((runs, z, z[:0], np.full(len(once), -1))).astype(np.int32)),
                    }
                )

    found = keyed(docs.select("doc_id", "text")).select("_key", "text").mapInArrow(run, "h long, _key long, start int, n int")
    seen = F.count(F.when(F.col("n") <= 0, 1)).over(Window.partitionBy("h"))
    return found.withColumn("seen", seen).where("n > 0 or (n < 0 and seen > 1)").select("_key", "start", F.abs("n").alias("n"))


def removal_spans(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, log2_bits: int = LOG2_BITS, slots: int = SLOTS) -> DataFrame:
    """``_key, spans``: unordered runs ``start << 31 | n`` of repeated windows for every text that has some."""
    runs = repeated_windows(docs, width, anchor, log2_bits, slots)
    packed = F.shiftleft(F.col("start").cast("long"), 31).bitwiseOR(F.col("n").cast("long"))
    return runs.groupBy("_key").agg(F.collect_set(packed).alias("spans"))


def intervals(spans: list[int] | np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal half-open word intervals covered by runs of windows."""
    out: list[tuple[int, int]] = []
    for s in sorted(int(x) for x in spans):
        a, b = s >> 31, (s >> 31) + (s & 0x7FFFFFFF) - 1 + width
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, with_text: bool = True, log2_bits: int = LOG2_BITS, slots: int = SLOTS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_removed, kept_sha256 and, if asked for, the kept words as ``text``.

    Only texts that lose words are shuffled; the others are finished where they are read.
    """
    spans = materialize(removal_spans(docs, width, anchor, log2_bits, slots), "removal-spans")
    touched = docs.sparkSession.sparkContext.broadcast(Bloom.of(spans, F.xxhash64("_key"), log2_bits - 2))
    rows = keyed(docs.select("doc_id", "text")).withColumn("_probe", F.xxhash64("_key"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if with_text else "")

    def finish(words: list[bytes], gone: list[tuple[int, int]]) -> tuple[int, int, str, str | None]:
        kept = words
        if gone:
            kept, at = [], 0
            for a, b in gone:
                kept += words[at:a]
                at = b
            kept += words[at:]
        joined = b" ".join(kept)
        return len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            later = touched.value.has(batch.column("_probe").to_numpy(zero_copy_only=False).view(np.uint64))
            done = [(None,) * 4 if l else finish((t or "").encode().split(), []) for t, l in zip(batch.column("text").to_pylist(), later)]
            out = {"doc_id": batch.column("doc_id"), "_key": batch.column("_key")}
            for k, (name, kind) in enumerate((("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()))):
                out[name] = pa.array([d[k] for d in done], kind)
            out["text"] = pa.array([t if l else None for t, l in zip(batch.column("text").to_pylist(), later)], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["n_words"] is None:
                    done = finish((r["text"] or "").encode().split(), intervals(r["spans"] or [], width))
                else:
                    done = (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"])
                rows.append((r["doc_id"], *done))
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: 4 + with_text]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kinds[k]) for k in range(len(names))], names)

    opened = rows.mapInArrow(first, "doc_id long, _key long, n_words long, n_removed long, kept_sha256 string, kept string, text string")
    return opened.join(spans, "_key", "left").select("doc_id", "n_words", "n_removed", "kept_sha256", "kept", "text", "spans").mapInArrow(second, schema)
