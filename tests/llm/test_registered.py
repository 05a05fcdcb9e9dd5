"""The registered queries themselves, on small folders of tables."""

import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import test_pitman_yor
import test_rules
from conftest import make_docs
from tokenizers import Tokenizer

import compare
from logmill.llm import queries, rules
from logmill.llm.tokenize import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_equal_their_sql(spark, capsys, monkeypatch):
    monkeypatch.setattr(compare, "session", lambda: spark)
    assert compare.main(SF, list(queries.ORACLE_SQL)) == 0, capsys.readouterr().out


@pytest.fixture(scope="module")
def rows():
    return make_docs(21, 50)


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "never there")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_scores(spark, folder, rows):
    out = queries.op1_pitman_yor_scores(spark, folder).collect()
    want = test_pitman_yor.plain(rows, 2, 3, 17)[0]
    got, want = test_pitman_yor.in_order([tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in out]), test_pitman_yor.in_order(want)
    assert [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=1e-4)


def test_kept(spark, folder, rows):
    """The statistics by brute force, the verdict by the list that a plain learner finds on the same labelled rows."""
    out = queries.op2_decision_list_rules(spark, folder).collect()
    want = Counter((d, *test_rules.expected(t)) for d, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    marked = rules.labelled_features(rules.with_stats(docs), spark.read.parquet(f"{folder}/labels.parquet"))
    plain = test_rules.plain_list([r.asDict() for r in marked.collect()])
    for r in out:
        n = max(1, r.n_words)
        x = {s: float(r[s]) for s in rules.STATS} | {"chars_per_word": r.word_chars / n, "symbols_per_word": r.n_symbols / n, "dup_lines_per_word": r.n_dup_lines / n, "repeat_share": r.n_repeat_words / n}
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        rejected = any(all((x[f] >= t) == at_least for f, at_least, t in rule) for rule in plain)
        assert (r.base_failed, r.kept) == (failed, not failed and not rejected)


def test_frames_and_packing(spark, folder, rows):
    library = Tokenizer.from_file(tokenizer_path(queries.WORD_BPE))
    encoded = [(d, [*ids_of(library, t), 1]) for d, t in rows]
    out = sorted(queries.op3_token_frames(spark, folder).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == Counter((d, len(i), crc(i)) for d, i in encoded)
    assert out[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(out, out[1:]))
    pieces = queries.op4_best_fit_packing(spark, folder).collect()
    want = Counter((d, k, a, len(i[a : a + 4096]), crc(i[a : a + 4096])) for d, i in encoded for k, a in enumerate(range(0, len(i), 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    bins = defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 4096
    assert len(bins) <= -(-sum(len(i) for _, i in encoded) // 4096) + 1


def test_token_counts(spark, folder, rows):
    library = Tokenizer.from_file(tokenizer_path(queries.BYTE_BPE))
    out = queries.op6_token_counts(spark, folder).collect()
    want = [(d, len((t or "").encode()), len(ids_of(library, t))) for d, t in rows]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == Counter((*w, w[2] > 512) for w in want)


def test_classifier(spark, folder, rows):
    """Its rounds are compared with a plain loop elsewhere; here every row has a verdict."""
    out = queries.op8_cotrained_quality(spark, folder).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, _ in rows)
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in out)
