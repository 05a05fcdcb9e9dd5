"""Token counts from counts of distinct pre-tokens; no id sequence is ever made for a text.

1. Every text is cut into pre-tokens; distinct ones are counted over the corpus.
2. The library counts the pieces of each distinct pre-token once.
3. Per-document pre-token frequencies are joined to these counts and summed: the
   frequent pre-tokens (``HOT`` at most, a fixed bound) meet their counts in the
   scanning task, the others in a shuffle join, so that no frequent pre-token
   becomes a hot key.

For byte-level BPE files.  The strings of special tokens count as the library's
default has it (one token).  Null or empty text: no tokens.  Repeated ``doc_id``s
give one row each; an empty table gives no rows.  Columns but doc_id and text are not
looked at.  A very long text is cut into pre-tokens in one piece, by its task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.llm.arrays import flat_text, gather_runs, slices
from logmill.llm.frequent import frequent
from logmill.llm.storage import materialize
from logmill.llm.tokenize import load_tokenizer

HOT = 262_144
#: The public pre-tokenizer pattern of byte-level BPE, over ASCII text.
ASCII_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


#: Units that are one pre-token as they are: a word of Latin letters or a run of ASCII marks, after a space or not.
SINGLE = r"^ ?(?:[A-Za-zÀ-ÖØ-öø-ÿĀ-ž]+|[!-&(-/:-@\[-`{-~]+)$"
#: Bytes of text at a time: distinct units take many times their size.
SLICE = 4 << 20


class PreTokenizer:
    """Cuts texts into the library's pre-tokens, one call per distinct unit between plain spaces."""

    _loaded: dict[str, "PreTokenizer"] = {}

    @classmethod
    def of(cls, path: str) -> "PreTokenizer":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.marks = [s[:2] for s in special]

    def unit(self, text: str) -> list[str]:
        """Pre-tokens of a text; a special string is one of its own."""
        if self.special is not None and any(m in text for m in self.marks):
            parts = self.special.split(text)
            return [p for i, s in enumerate(parts) if s for p in ([s] if i % 2 else self._plain(s))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def tokens(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """``(row, code, names)`` of every pre-token occurrence: text ``row`` has ``names[code]`` there."""
        rows, units = cut_units(text)
        coded = units.dictionary_encode()
        distinct = coded.dictionary
        single = pc.match_substring_regex(distinct, SINGLE)
        alone = single.to_numpy(zero_copy_only=False).astype(bool)
        lists = [self.unit(u) for u in distinct.filter(pc.invert(single)).to_pylist()]
        flat = pa.concat_arrays([distinct.filter(single), pa.array([p for x in lists for p in x], pa.large_string())]).dictionary_encode()
        many = np.fromiter(map(len, lists), np.int64, len(lists))
        lengths, starts = np.ones(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        starts[alone] = np.arange(int(alone.sum()))
        lengths[~alone] = many
        starts[~alone] = int(alone.sum()) + np.cumsum(many) - many
        at = coded.indices.to_numpy().astype(np.int64)
        codes = gather_runs(flat.indices.to_numpy().astype(np.int64), starts[at], lengths[at])
        return np.repeat(rows, lengths[at]), codes, flat.dictionary


_ASCII = np.zeros(256, bool)
_ASCII[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK = _ASCII & ~_LETTER
_MARK[[*range(0x30, 0x3A), 0x27, 0x7C]] = False
_LEAD = np.zeros(256, bool)  # first bytes of two-byte characters, without those of U+0085 and U+00A0
_LEAD[0xC3:0xE0] = True


def cut_units(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Cut texts before single spaces between characters that are surely no white space,
    and between an ASCII letter and a mark other than an apostrophe or bar.

    No pre-token crosses such a cut: a space can only begin one there, and letters end
    before a mark.  Bars are left out for the special strings, which hold one after a letter.
    """
    text = flat_text(text)
    if not len(text):
        return np.zeros(0, np.int64), text
    _, offsets, data = text.buffers()
    bounds = np.frombuffer(offsets, np.int64)[: len(text) + 1]
    raw = np.frombuffer(data, np.uint8)[: bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    at = np.flatnonzero(raw == 0x20)
    at = at[(at >= bounds[0] + 2) & (at + 1 < len(raw))]
    before, after = raw[at - 1], raw[at + 1]
    ok = (_ASCII[before] | ((before >= 0x80) & _LEAD[raw[at - 2]])) & (_ASCII[after] | _LEAD[after])
    marks = np.flatnonzero(_LETTER[raw[:-1]] & _MARK[raw[1:]]) + 1 if len(raw) else at[:0]
    cuts = np.sort(np.concatenate((at[ok], marks, bounds)))  # np.unique would hash, which is slower here
    cuts = cuts[np.concatenate(([True], cuts[1:] != cuts[:-1]))]
    starts = np.repeat(np.arange(len(text)), np.diff(np.searchsorted(cuts, bounds)))
    if len(cuts) < 2:
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    units = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64).tobytes()), data)
    return starts, units


def distinct_pretokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """pretoken, n: every distinct pre-token of all texts with its number of occurrences."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = PreTokenizer.of(tokenizer)
        for batch in batches:
            for part in slices(batch, size=SLICE):
                _, code, names = pre.tokens(part.column("text"))
                yield pa.RecordBatch.from_pydict({"pretoken": names.cast(pa.string()), "n": pa.array(np.bincount(code, minlength=len(names)))})

    return docs.select("text").mapInArrow(cut, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))


def count_pieces(pretokens: DataFrame, tokenizer: str) -> DataFrame:
    """Add ``pieces``, the library's number of tokens for each pre-token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PreTokenizer.of(tokenizer).tokenizer
        for batch in batches:
            coded = coder.encode_batch_fast(batch.column("pretoken").to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(e) for e in coded], pa.int64())], [*batch.schema.names, "pieces"])

    return pretokens.mapInArrow(count, "pretoken string, n long, pieces long")


def token_counts(docs: DataFrame, tokenizer: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of ``docs`` (doc_id, text)."""
    pieces = materialize(count_pieces(distinct_pretokens(docs, tokenizer), tokenizer), "pretokens")
    top = frequent(pieces, "n", hot).select("pretoken", "pieces").toArrow()
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(top["pretoken"].to_pylist(), top["pieces"].to_pylist())))
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, table = PreTokenizer.of(tokenizer), known.value
        for batch in batches:
            for part in slices(batch, size=SLICE):
                text = part.column("text")
                row, code, names = pre.tokens(text)
                pieces = np.fromiter((table.get(x, 0) for x in names.to_pylist()), np.int64, len(names))
                size = len(text)
                each = pieces[code]
                sums = np.bincount(row, weights=each, minlength=size).astype(np.int64)
                other = each == 0
                keys, n = np.unique(row[other] * max(1, len(names)) + code[other], return_counts=True)
                row, code = keys // max(1, len(names)), keys % max(1, len(names))
                ids = part.column("_row")
                # A row per document: no pre-token has a NUL before letters, so this key joins with nothing.
                own = pa.array([f"\0row{i}" for i in ids.to_pylist()], pa.string())
                tail = names.cast(pa.string()).take(pa.array(code))
                take = pa.array(row)
                empty = pa.nulls(len(row), pa.int64())
                yield pa.RecordBatch.from_pydict(
                    {
                        "_row": pa.concat_arrays([ids, ids.take(take)]),
                        "doc_id": pa.concat_arrays([part.column("doc_id"), empty]),
                        "n_bytes": pa.concat_arrays([pc.fill_null(pc.binary_length(text), 0).cast(pa.int64()), empty]),
                        "pretoken": pa.concat_arrays([own, tail]),
                        "n": pa.array(np.concatenate((sums, n))),
                    }
                )

    parts = rows.mapInArrow(frequencies, "_row long, doc_id long, n_bytes long, pretoken string, n long")
    tail = pieces.select("pretoken", "pieces")
    joined = parts.join(tail, "pretoken", "left")
    return (
        joined.groupBy("_row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_bytes").alias("n_bytes"),
            F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"),
        )
        .drop("_row")
    )
