"""Benchmark decontamination with suffix arrays of the training documents.

A scanning task cuts its documents into shards and builds one suffix array for each:
positions sorted by their next 13 words, by doubling (ranks of 2, 4 and 8 words give
those of twice as many).  Every suffix of a benchmark item that can begin a window is
binary-searched in it, again by doubling, so most fall out after two or four words.  A
range of the array holds all places of a window; windows that follow each other on one
diagonal join into the longest verbatim matches with their places.  Documents are not
shuffled.

Words that no item has (by a Bloom filter of fixed size over the benchmark's words)
end a suffix, and stretches too short for any window are left out before sorting; both
only save work.  The benchmark is a query set of unknown size, so executors write it
as blocks of about ``BLOCK`` bytes of text below the shared folder, dealt by row.  A
shard's array is built once and searched with one block after the other; a worker
remembers blocks up to ``REMEMBER`` bytes and reads further ones once per shard.

Words are runs of ASCII digits and letters (lower-cased) and of non-ASCII characters,
told apart by 64-bit hashes.  A window is 13 words of an item; an item of fewer, but
not none, is one window.  Null texts have no words; a null ``item_id`` stands as the
empty string; equal ids count once.  A table without rows gives no rows, an empty
benchmark no hits.  Repeated ``doc_id``s are separate documents.  Other columns pass
through ``remove_contaminated`` unread, whatever their names; ``scan`` leaves them out.
A very long text is a shard of its own.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.llm.arrays import gather_runs, pack_arrays, run_sums, slices, split_words, translate, unpack_arrays
from logmill.llm.frequent import Bloom
from logmill.llm.storage import file_system, materialize, new_folder

WINDOW = 13
#: Bytes of benchmark text in a block, of documents in a shard, and of blocks that a worker remembers.
BLOCK, SHARD, REMEMBER = 4 << 20, 6 << 20, 64 << 20
#: Matches that are spelled out at a time.
MATCHES = 1 << 20

_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[0x41:0x5B] += 0x20
for _a, _b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _TABLE[_a : _b + 1] = 0x20


def words_of(text: pa.Array):
    return split_words(translate(text, _TABLE))


@dataclass
class Block:
    """Some benchmark items: the sorted hashes of their words, the number of every word's, where items start, and their ids."""

    hashes: np.ndarray
    codes: np.ndarray
    bounds: np.ndarray
    ids: list[str]

    @classmethod
    def of(cls, item_ids: list, texts: list[str | None]) -> "Block":
        words = words_of(pa.array(texts, pa.string()))
        hashes, codes = np.unique(words.hashes(), return_inverse=True)
        return cls(hashes, codes.astype(np.int64), words.bounds, ["" if i is None else str(i) for i in item_ids])

    @property
    def nbytes(self) -> int:
        return self.hashes.nbytes + self.codes.nbytes + self.bounds.nbytes

    def dump(self) -> bytes:
        return pack_arrays(self.hashes, self.codes.astype(np.uint32), self.bounds, np.frombuffer(json.dumps(self.ids).encode(), np.uint8))

    @classmethod
    def load(cls, raw: bytes) -> "Block":
        hashes, codes, bounds, ids = unpack_arrays(raw)
        return cls(hashes, codes.astype(np.int64), bounds, json.loads(ids.tobytes()))


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and each key's number among them, from 1 (0 is for what is missing)."""
    known, rank = np.unique(key, return_inverse=True)
    return known, rank.astype(np.int64) + 1


def _ahead(rank: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(rank)
    out[: max(0, len(rank) - by)] = rank[by:]
    return out


def _rank_of(known: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Numbers of keys among the known ones, 0 where they are not."""
    if not len(known):
        return np.zeros(len(key), np.int64)
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return np.where(known[at] == key, at + 1, 0)


class SuffixArray:
    """Suffixes of a shard's texts in the order of their first ``width`` words, for searching.

    Between texts, and where words were left out, stands a word that equals no other.
    """

    def __init__(self, hashes: np.ndarray, codes: np.ndarray, place: np.ndarray, width: int = WINDOW):
        """``codes`` index ``hashes`` from 1, 0 is a break; ``place`` tells where each stands in the shard."""
        self.width, self.place = width, place
        order = np.argsort(hashes, kind="stable")
        self.words = hashes[order]
        rank = np.zeros(len(hashes) + 1, np.int64)
        rank[order + 1] = np.arange(1, len(hashes) + 1)
        #: ``ranks[k]``: numbers of the next ``2**k`` words at every position; ``known[k]`` the keys that they number.
        self.ranks, self.known = [rank[codes]], [self.words]
        while 1 << len(self.ranks) <= width:
            known, rank = _ranks(self._joined(self.ranks[-1], _ahead(self.ranks[-1], 1 << (len(self.ranks) - 1))))
            self.ranks.append(rank)
            self.known.append(known)
        self.order = np.argsort(self.key(width), kind="stable")
        self._sorted: dict[int, np.ndarray] = {}

    @staticmethod
    def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a << 32 | b

    def level(self, length: int) -> int:
        return length.bit_length() - 1

    def key(self, length: int) -> np.ndarray:
        """A number for the next ``length`` words of every position, in their order."""
        r = self.ranks[self.level(length)]
        return self._joined(r, _ahead(r, length - (1 << self.level(length))))

    def lookup(self, hashes: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
        """By level, the numbers here of the next ``2**k`` of the words ``hashes[codes]`` at every place; 0 where they do not occur."""
        out = [_rank_of(self.words, hashes)[codes]]
        for k in range(1, len(self.known)):
            rank = np.zeros_like(codes)
            after = _ahead(out[-1], 1 << (k - 1))
            both = np.flatnonzero((out[-1] > 0) & (after > 0))
            rank[both] = _rank_of(self.known[k], self._joined(out[-1][both], after[both]))
            out.append(rank)
        return out

    def search(self, found: list[np.ndarray], start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """``(place, which)`` of every occurrence of the ``length`` words from ``start[which]`` of a text that was looked up."""
        none = np.zeros(0, np.int64)
        if not len(self.order) or not len(start):
            return none, none
        rank = found[self.level(length)]
        rest = length - (1 << self.level(length))
        a, b = rank[start], rank[start + rest]
        which = np.flatnonzero((a > 0) & (b > 0))
        if not len(which):
            return none, none
        if length not in self._sorted:
            self._sorted[length] = self.key(length)[self.order]
        wanted = self._joined(a[which], b[which])
        low = np.searchsorted(self._sorted[length], wanted, side="left")
        high = np.searchsorted(self._sorted[length], wanted, side="right")
        return self.place[self.order[gather_runs(np.arange(len(self.order)), low, high - low)]], np.repeat(which, high - low)


def shard_array(hashes: np.ndarray, codes: np.ndarray, bounds: np.ndarray, usable: np.ndarray, shortest: int, width: int = WINDOW) -> SuffixArray:
    """The array of a shard's words ``hashes[codes]``: stretches of ``shortest`` or more usable words within a text."""
    ok = usable[codes]
    edge = np.zeros(len(codes) + 1, bool)
    edge[bounds] = True
    # A stretch begins at a usable word after a break or an edge, and ends before the next.
    begins = np.flatnonzero(ok & (edge[:-1] | np.concatenate(([True], ~ok[:-1])))) if len(codes) else np.zeros(0, np.int64)
    ends = np.flatnonzero(ok & (edge[1:] | np.concatenate((~ok[1:], [True])))) + 1 if len(codes) else begins
    keep = ends - begins >= shortest
    begins, size = begins[keep], (ends - begins)[keep]
    place = gather_runs(np.arange(len(codes)), begins, size)
    # One break after each stretch.
    at = np.arange(len(place)) + np.repeat(np.arange(len(size)), size)
    text, where = np.zeros(len(place) + len(size), np.int64), np.full(len(place) + len(size), -1)
    text[at], where[at] = codes[place] + 1, place
    return SuffixArray(hashes, text, where, width)


def longest_matches(position: np.ndarray, item: np.ndarray, item_position: np.ndarray, length: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(item, position, item position, words)`` of maximal verbatim matches, from all places of windows."""
    order = np.lexsort((position, position - item_position, item, doc))
    position, item, item_position, length, doc = (x[order] for x in (position, item, item_position, length, doc))
    new = np.ones(len(position), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(position) != 1) | (np.diff(item_position) != 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(position)) - 1 if len(a) else a
    return item[a], position[a], item_position[a], position[b] + length[b] - position[a]


@dataclass(frozen=True)
class Benchmark:
    """Where the blocks are, how many words the shortest window has, and a filter of the words."""

    blocks: list[str]
    shortest: int
    words: Bloom


def write_blocks(benchmark: DataFrame, block: int = BLOCK) -> Benchmark:
    """Write (item_id, text) as blocks of about ``block`` bytes; nothing but their names reaches the driver."""
    spark = benchmark.sparkSession
    folder = new_folder(spark, "benchmark")
    size = benchmark.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0]["n"] or 0
    dealt = benchmark.select("item_id", "text").repartition(max(1, -(-size // block)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=block):
                made = Block.of(part.column("item_id").to_pylist(), part.column("text").to_pylist())
                counts = np.diff(made.bounds)
                if not counts.any():
                    continue
                path = f"{folder}/{uuid.uuid4().hex}"
                fs, local = file_system(path)
                fs.create_dir(local.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(local, compression=None) as out:
                    out.write(made.dump())
                words = made.hashes.view(np.int64)
                none = len(words)
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] + [None] * none, pa.string()), "shortest": pa.array([int(min(WINDOW, counts[counts > 0].min()))] + [None] * none, pa.int32()), "word": pa.array(np.concatenate(([0], words)))})

    made = materialize(dealt.mapInArrow(write, "path string, shortest int, word long"), "benchmark-blocks")
    found = made.where("path is not null").select("path", "shortest").collect()  # a row per block
    words = Bloom.of(made.where("path is null"), F.col("word"), 24)
    return Benchmark(sorted(r["path"] for r in found), min((r["shortest"] for r in found), default=WINDOW), words)


_remembered: dict[str, Block] = {}
_size = 0
#: How many blocks this process has read.
reads = 0


def _block(path: str) -> Block:
    global _size, reads
    if path in _remembered:
        return _remembered[path]
    reads += 1
    fs, local = file_system(path)
    with fs.open_input_stream(local, compression=None) as f:
        block = Block.load(f.read())
    if _size + block.nbytes <= REMEMBER:
        _remembered[path] = block
        _size += block.nbytes
    return block


def scan_shard(text: pa.Array, benchmark: Benchmark) -> dict[str, list | np.ndarray]:
    """n_words, n_hit, the sorted item ids and the longest matches of each text."""
    words = words_of(text)
    n, rows = len(words.codes), len(text)
    hashes = words.word_hashes()
    array = shard_array(hashes, words.codes, words.bounds, benchmark.words.has(hashes), benchmark.shortest)
    doc, cover = words.doc, np.zeros(n + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(rows)]
    matches: list[list[dict]] = [[] for _ in range(rows)]
    for path in benchmark.blocks:
        block = _block(path)
        counts = np.diff(block.bounds)
        item = np.repeat(np.arange(len(counts)), counts)
        rest = np.repeat(block.bounds[1:], counts) - np.arange(len(block.codes))
        ranks = array.lookup(block.hashes, block.codes)
        found = []
        for length in np.unique(np.minimum(counts[counts > 0], WINDOW)).tolist():
            # A suffix begins a window if the item's length is that of windows, or more and there are as many words left.
            start = np.flatnonzero((rest >= length) & (np.minimum(counts[item], WINDOW) == length))
            at, which = array.search(ranks, start, length)
            found.append((at, start[which], np.full(len(at), length)))
        at, begin, length = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        order = np.argsort(doc[at], kind="stable")
        for part in np.split(order, _cuts(doc[at][order])):
            if len(part):
                i, pos, item_pos, size = longest_matches(at[part], item[begin[part]], begin[part] - block.bounds[item[begin[part]]], length[part], doc[at[part]])
                for i, d, p, q, m in zip(i.tolist(), doc[pos].tolist(), pos.tolist(), item_pos.tolist(), size.tolist()):
                    items[d].add(block.ids[i])
                    matches[d].append({"item_id": block.ids[i], "word": p - int(words.bounds[d]), "item_word": q, "n_words": m})
    hit = (np.cumsum(cover)[:-1] > 0).astype(np.int64)
    order = lambda m: (m["word"], -m["n_words"], m["item_id"], m["item_word"])
    return {"n_words": np.diff(words.bounds), "n_hit": run_sums(hit, words.bounds), "items": [sorted(s) for s in items], "matches": [sorted(m, key=order) for m in matches]}


def _cuts(doc: np.ndarray) -> np.ndarray:
    """Where to cut rows sorted by document so that parts have whole documents and about ``MATCHES`` rows."""
    wanted = np.arange(MATCHES, len(doc), MATCHES)
    return np.unique(np.searchsorted(doc, doc[wanted], side="left")) if len(wanted) else wanted


_MATCHES = "array<struct<item_id:string,word:long,item_word:long,n_words:long>>"


def scan(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): n_words, n_hit, items (ids as sorted strings) and the longest matches by place."""
    written = docs.sparkSession.sparkContext.broadcast(write_blocks(benchmark, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item_id", pa.string()), ("word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))
        for batch in batches:
            for part in slices(batch, size=SHARD):
                got = scan_shard(part.column("text"), written.value)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column("doc_id"), "n_words": pa.array(got["n_words"]), "n_hit": pa.array(got["n_hit"]), "items": pa.array(got["items"], pa.list_(pa.string())), "matches": pa.array(got["matches"], kind)}
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_words long, n_hit long, items array<string>, matches {_MATCHES}")


def contaminated(n_hit, n_words):
    """The rule: hit words, and a twentieth of all words or more of them."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents without any match, with all their columns as they are.

    One occurrence of a window is enough to go; the rule of a twentieth of the words
    (``contaminated``) is for reports.
    """
    written = docs.sparkSession.sparkContext.broadcast(write_blocks(benchmark, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SHARD):
                got = scan_shard(part.column("text"), written.value)
                yield part.filter(pa.array(got["n_hit"] == 0))

    return docs.mapInArrow(run, docs.schema)
