"""Exact token ids of whole texts from a public tokenizer, one library call per distinct word.

``word_bpe`` files drop white space and never let a piece cross it, so a text's
ids are the ids of its white-space separated words in order.  A boundary between
a (Latin-1) letter and an ASCII punctuation mark other than the apostrophe is one
as well.  Texts that contain ``<|`` (where special strings could stand) go to
the library whole.  The files are read from a path parameter and never copied.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from logmill.llm.arrays import flat_text, gather_runs, run_sums, split_words

END_ID = 1
#: A worker adds words to those whose ids it remembers until it has so many.
CACHE_WORDS = 300_000
#: Bytes of text that an encoder takes at a time: more text has fewer distinct words for its size.
ENCODE_BYTES = 8 << 20
#: Words per library call: its result objects are large.
CALL_WORDS = 16_384

_encoders: dict[str, "WordEncoder"] = {}


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary file ``name`` is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def word_encoder(path: str) -> "WordEncoder":
    """The worker's encoder for a file; loaded once per process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class WordEncoder:
    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.cache: dict[str, bytes] = {}

    def _words(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has."""
        cache = self.cache
        found = [cache.get(w) for w in names]
        missing = [w for w, b in zip(names, found) if b is None]
        if missing:
            calls = (missing[a : a + CALL_WORDS] for a in range(0, len(missing), CALL_WORDS))
            new = (np.array(e.ids, np.uint32).tobytes() for c in calls for e in self.tokenizer.encode_batch_fast(c, add_special_tokens=False))
            found = [next(new) if b is None else b for b in found]
            if len(cache) < CACHE_WORDS:
                cache.update(zip(names, found))
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), np.uint32), lengths

    def encode(self, text: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, bounds)``: row ``i`` has ``ids[bounds[i]:bounds[i + 1]]``; null counts as empty."""
        text = flat_text(text)
        odd = pc.match_substring(text, "<|").to_numpy(zero_copy_only=False)
        plain = text if not odd.any() else pc.if_else(pa.array(odd), "", text)
        plain = pc.replace_substring_regex(pc.ascii_lower(plain), r"([a-zà-öø-ÿ])([!-&(-/:-@\[-`{-~])", r"\1 \2")
        words = split_words(plain)
        flat, per_word = self._words(words.names)
        starts = np.cumsum(per_word) - per_word
        lengths = per_word[words.codes]
        ids = gather_runs(flat, starts[words.codes], lengths)
        bounds = np.concatenate(([0], np.cumsum(run_sums(lengths, words.bounds)))).astype(np.int64)
        if not odd.any() and end_id is None:
            return ids, bounds
        counts = np.diff(bounds)
        whole: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(odd):
            e = self.tokenizer.encode_batch_fast([text[int(i)].as_py()], add_special_tokens=False)[0]
            whole[int(i)] = np.array(e.ids, np.uint32)
            counts[i] = len(whole[int(i)])
        extra = 0 if end_id is None else 1
        new = np.concatenate(([0], np.cumsum(counts + extra))).astype(np.int64)
        out = np.full(int(new[-1]), 0 if end_id is None else end_id, np.uint32)
        if whole:
            for i, x in whole.items():
                out[new[i] : new[i] + len(x)] = x
            usual = np.flatnonzero(~odd)
            at = np.repeat(new[usual] - bounds[usual], np.diff(bounds)[usual])
            src = gather_runs(np.arange(len(ids)), bounds[usual], np.diff(bounds)[usual])
            out[src + at] = ids[src]
        else:
            at = np.arange(len(ids)) + np.repeat(np.arange(len(counts)) * extra, counts)
            out[at] = ids
        return out, new
