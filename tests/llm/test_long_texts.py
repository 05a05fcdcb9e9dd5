"""One text beyond every slice and shard among short ones: it is handled whole."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from logmill.llm import cotraining, decontaminate, frames, lines, near_dup, packing, restaurants, rules, substrings, token_counts
from logmill.llm import pitman_yor as py
from logmill.llm.tokenize import tokenizer_path


@pytest.fixture(scope="module")
def long_text():
    """Some 13 MB: more than the largest slice or shard."""
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    out = [rng.choice(vocab) for _ in range(2_000_000)]
    text = " ".join(w + ("\n" if k % 50 == 49 else "") for k, w in enumerate(out))
    assert len(text) > max(decontaminate.SHARD, restaurants.SLICE)
    return text


@pytest.fixture(scope="module")
def docs(spark, long_text):
    short = "a b c d e f g h i j k l m n o p q r s t"
    rows = [(1, long_text), (2, short), (3, long_text[-6_000:]), (4, short), (5, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_scores(docs, long_text):
    got = by_id(py.score_corpus(docs, 1, 1))
    assert got[1].n_tokens == 2_000_001 and all(r.score < 0 for r in got.values())


def test_statistics(docs, long_text):
    got = by_id(rules.with_stats(docs))
    assert got[1]._stats.n_words == 2_000_000 and got[1]._stats.word_chars == len("".join(long_text.split()))
    assert got[1]._stats.n_dup_lines == 0


def test_tokens(spark, docs, long_text):
    path = tokenizer_path("word_bpe_49k.json")
    ids = np.array([*Tokenizer.from_file(path).encode(long_text, add_special_tokens=False).ids, 1], "<u4")
    got = by_id(frames.read_shards(spark, frames.write_shards(docs, path)))
    assert (got[1].n_tokens, got[1].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    pieces = [r for r in packing.pack(packing.token_pieces(docs, path)).collect() if r.doc_id == 1]
    assert sum(r.length for r in pieces) == len(ids) and len(pieces) == -(-len(ids) // 4096)
    byte = tokenizer_path("byte_bpe_50k.json")
    want = len(Tokenizer.from_file(byte).encode(long_text, add_special_tokens=False).ids)
    assert by_id(token_counts.token_counts(docs, byte))[1].n_tokens == want


def test_passages(spark, docs, long_text):
    bench = spark.createDataFrame([(9, " ".join(long_text.split()[-40:]))], "item_id long, text string")
    got = by_id(decontaminate.scan(docs, bench))
    assert (got[1].n_words, got[1].n_hit, got[3].n_hit) == (2_000_000, 40, 40) and got[1].matches[0].word == 1_999_960
    kept = by_id(substrings.remove_repeats(docs))
    tail = len(long_text[-6_000:].split())
    assert (kept[1].n_words, kept[2].n_removed) == (2_000_000, 0) and tail - 1 <= kept[1].n_removed <= tail
    left = by_id(lines.remove_repeated_windows(docs))
    assert left[1].text == long_text and len(left[3].text) < 1000


def test_duplicates_and_classifier(spark, docs):
    got = by_id(near_dup.near_duplicates(docs))
    assert [got[k].component_id for k in (1, 2, 3, 4)] == [1, 2, 3, 2] and got[1].n_shingles > 1_900_000
    out = cotraining.classify(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert out.count() == 5
