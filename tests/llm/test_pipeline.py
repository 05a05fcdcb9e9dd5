import random
from collections import Counter

import pytest
import test_decontaminate
import test_lines
import test_near_dup
import test_rules
from conftest import make_docs

import corpus_pipeline
from logmill.llm import rules


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small folder of tables with every kind of planted case."""
    rng, rows = random.Random(2), make_docs(9, 80)
    junk = [(1000 + i, " ".join(f"a{rng.randrange(999)}### $$" for _ in range(80))) for i in range(30)]
    clean = [(2000 + i, " ".join(f"w{rng.randrange(5000)}" for _ in range(100))) for i in range(40)]
    passage = " ".join(f"bench{i}" for i in range(30))
    leaked = [(3000 + i, " ".join(f"x{rng.randrange(5000)}" for _ in range(70)) + " " + passage) for i in range(3)]
    # A short passage in a long document is a leak as well.
    leaked.append((3100, " ".join(f"y{rng.randrange(5000)}" for _ in range(290)) + " " + " ".join(f"bench{i}" for i in range(4, 18))))
    rows = rows + junk + clean + leaked
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0, 0) for i, _ in junk] + [(i, 1, 0) for i, _ in clean + [(3100, "")]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, "nothing here matches at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_brute_force(spark, folder):
    """Every stage on what the one before kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "benchmark decontamination", "best-fit packing"]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, folder)
        if number < 4:
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), docs.schema)
            after = Counter((r.doc_id, r.text) for r in out.collect())
        if name == "quality rules":
            learned = rules.fit(rules.with_stats(docs), spark.read.parquet(f"{folder}/labels.parquet"))
            assert learned.rules
            judged = {r.doc_id for r in out.collect()}
            for d, t in before:
                n, _, symbols, _, repeat = test_rules.expected(t)
                if n < 50 or 100 * repeat > 50 * n or symbols > n:
                    assert (d, t) not in after
                elif d is not None and symbols == 0 and repeat == 0 and 2000 <= d < 3000:
                    assert d in judged
            assert not any(d is not None and 1000 <= d < 2000 for d, _ in after)
        elif name == "line dedup":
            assert after == test_lines.expected(before)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
        elif name == "near dedup":
            want = Counter()
            for (d, _, c), n in test_near_dup.expected(before, 80).items():
                if c is None or d == c:
                    want[d] += n
            assert Counter(d for d, _ in after.elements()) == want
        elif name == "benchmark decontamination":
            bench = [(1, " ".join(f"bench{i}" for i in range(30))), (2, "nothing here matches at all")]
            hits = {d: h for (d, _, h, _) in test_decontaminate.expected(before, bench)}
            assert {d for d, _ in after} == {d for d, _ in before if not hits[d]}
            assert {3000, 3001, 3002, 3100} <= {d for d, _ in before} and not {3000, 3001, 3002, 3100} & {d for d, _ in after}
        else:
            pieces = out.collect()
            assert {r.doc_id for r in pieces} == {d for d, _ in before}
        docs = out


def test_run_and_rerun(spark, folder):
    a, b = (Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()) for _ in range(2))
    assert a == b and a


@pytest.mark.parametrize("emptied", [("documents",), ("labels",), ("benchmark",), ("labels", "benchmark")])
def test_empty_tables(spark, folder, tmp_path, emptied):
    """Without documents nothing comes out; without labels or a benchmark the other stages decide."""
    for name in ("documents", "labels", "benchmark"):
        table = spark.read.parquet(f"{folder}/{name}.parquet")
        (table.where("false") if name in emptied else table).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    full = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    if "documents" in emptied:
        assert not got
    elif "labels" in emptied:
        assert any(1000 <= d < 2000 for d in got if d is not None)
    else:
        assert got == full | {3000, 3001, 3002, 3100}


def test_other_columns_pass_through(spark, folder):
    """Columns named like those that stages use inside keep their values."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'z' as _key", "'z' as _GONE", "'z' as _stats", "'z' as _kept", "'z' as h", "'z' as b")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns[-6:] == ["_key", "_GONE", "_stats", "_kept", "h", "b"]
        assert docs.where("concat(_key, _GONE, _stats, _kept, h, b) <> 'zzzzzz'").count() == 0 and docs.count()
