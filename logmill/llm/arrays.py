"""Vectorised helpers shared by the operators: word splitting, hashing, runs."""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows holding about ``size`` bytes of text (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
        give_back()


_libc = ctypes.CDLL(None)


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and their share of an executor is small."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


class Words:
    """Words of some texts as dictionary codes.

    ``codes[i]`` indexes ``dictionary``; ``doc[i]`` is the row of the word; ``bounds``
    holds, per row, where its words start (length rows + 1).
    """

    def __init__(self, codes: np.ndarray, bounds: np.ndarray, dictionary: pa.Array):
        self.codes, self.bounds, self.dictionary = codes, bounds, dictionary

    def __len__(self) -> int:
        """How many different words there are."""
        return len(self.dictionary)

    @property
    def names(self) -> list[str]:
        return self.dictionary.to_pylist()

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def word_hashes(self) -> np.ndarray:
        """64-bit hash of every different word."""
        return hash_strings(self.dictionary)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word, by position."""
        return self.word_hashes()[self.codes] if len(self.codes) else np.zeros(0, np.uint64)


_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
#: Random numbers for the values of a byte.
_BYTES = np.random.default_rng(20_240_602).integers(0, 1 << 64, 256, np.uint64)


def hash_strings(text: pa.Array) -> np.ndarray:
    """64-bit hash of each string's bytes: a polynomial over random numbers for them, scrambled with the length.

    Like ``rolling``, from prefix sums, so no string becomes a Python object.
    """
    text = flat_text(text)
    if not len(text):
        return np.zeros(0, np.uint64)
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, np.int64)[: len(text) + 1]
    raw = np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None else np.zeros(0, np.uint8)
    with np.errstate(over="ignore"):
        power = np.full(len(raw) + 1, _B, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        down = np.full(len(raw), _B_INV, np.uint64)
        down[:1] = 1
        np.cumprod(down, out=down)
        prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * down, out=prefix[1:])
        value = (prefix[ends[1:]] - prefix[ends[:-1]]) * power[ends[:-1]]
        return mix(value ^ mix(np.diff(ends).astype(np.uint64)))


def hash_words(names: list[str]) -> np.ndarray:
    return hash_strings(pa.array(names, pa.string()))


def flat_text(text: pa.Array) -> pa.Array:
    """A copy of string values with offsets from 0 and nulls as empty texts.

    Some of pyarrow's ASCII kernels misread slices that begin inside a buffer.
    """
    text = pc.fill_null(text.cast(pa.large_string()), "")
    return text.take(pa.array(np.arange(len(text)))) if len(text) else text


def split_words(text: pa.Array, lower: bool = False) -> Words:
    """Split on runs of the six ASCII white-space characters; null is no words."""
    text = flat_text(text)
    if lower:
        text = pc.ascii_lower(text)
    lists = pc.ascii_split_whitespace(text)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    coded = values.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    empty = np.flatnonzero(pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) == 0)
    if len(empty):  # at the edges of a text
        keep = codes != empty[0]
        bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
        codes = codes[keep]
    return Words(codes, bounds, coded.dictionary)


def translate(text: pa.Array, table: np.ndarray) -> pa.Array:
    """Map the bytes of texts through a 256-entry table (lengths stay)."""
    text = flat_text(text)
    _, offsets, data = text.buffers()
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(text), offsets, pa.py_buffer(table[raw].tobytes()))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(*keys: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the keys alone, so reruns repeat them."""
    h = np.uint64(0x9E3779B97F4A7C15)
    for k in keys:
        k = np.asarray(k).astype(np.uint64) if not isinstance(k, int) else np.asarray(k & (2**64 - 1), dtype=np.uint64)
        with np.errstate(over="ignore"):
            h = mix(np.atleast_1d(h ^ k) + np.uint64(0x9E3779B97F4A7C15))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash (modulo 2**64, then scrambled) of every ``width`` consecutive values.

    With prefix sums of ``x[j] * B**-j`` a window's polynomial is a difference
    times a power of ``B``, so no pass depends on the width.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        down = np.full(n, _B_INV, np.uint64)
        down[0] = 1
        np.cumprod(down, out=down)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * down, out=prefix[1:])
        up = np.full(n - width + 1, _B, np.uint64)
        up[0] = 1
        np.cumprod(up, out=up)
        return mix((prefix[width:] - prefix[:-width]) * up)


def inside(bounds: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of the ``total - width + 1`` windows lie within one row."""
    if total < width:
        return np.zeros(0, bool)
    ok = np.ones(total + 1, bool)
    ends = bounds[1:]
    for k in range(1, width):  # windows that start 1..width-1 before a row's end cross it
        at = ends - k
        ok[at[at >= 0]] = False
    ok = ok[: total - width + 1]
    # a window that starts near the end of a short row may end in a later one
    doc_end = np.repeat(ends, np.diff(bounds))[: total - width + 1]
    return ok & (np.arange(len(ok)) + width <= doc_end)


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (np.minimum or np.maximum) over every ``width`` consecutive values, by doubling."""
    if len(x) < width:
        return x[:0]
    have, y = 1, x
    while have * 2 <= width:
        y = op(y[:-have], y[have:])
        have *= 2
    rest = width - have
    return op(y[: len(y) - rest], y[rest:]) if rest else y


def gather_runs(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[starts[i] : starts[i] + lengths[i]]`` without a loop."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    at = np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
    return flat[at]


def run_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive bounds (empty runs give 0)."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[bounds])


#: Bytes from which packed arrays are compressed.
_WORTH = 512


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """One-dimensional arrays as bytes: their n-th bytes together, then compressed; a few bytes of overhead for small ones."""
    import zstandard

    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<cBI", a.dtype.kind.encode(), a.dtype.itemsize, len(a)) for a in arrays)
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays)
    if len(body) < _WORTH:
        return b"\0" + head + body
    return b"\1" + head + zstandard.ZstdCompressor(level=1).compress(body)


def unpack_arrays(raw: bytes) -> list[np.ndarray]:
    """What ``pack_arrays`` was given."""
    import zstandard

    count, at, kinds = raw[1], 2, []
    for _ in range(count):
        kind, size, n = struct.unpack_from("<cBI", raw, at)
        kinds.append((np.dtype(f"{kind.decode()}{size}"), n))
        at += 6
    body = zstandard.ZstdDecompressor().decompress(raw[at:]) if raw[0] else raw[at:]
    out, at = [], 0
    for kind, n in kinds:
        planes = np.frombuffer(body, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out
