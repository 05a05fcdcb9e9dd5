from collections import Counter

from pyspark.sql import functions as F

from logmill.llm import lines


def expected(doc_rows, width=3):
    seen, rows = {}, sorted(set(doc_rows), key=lambda r: (r[0] is not None, r[0] or 0))
    # Rows of one id are compared in the order of a hash; the fixture has no shared windows among them.
    texts = {}
    for d, t in rows:
        ls = [(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\v\f\r")]
        cut = set()
        for k in range(len(ls) - width + 1):
            w = tuple(x for _, x in ls[k : k + width])
            if seen.setdefault(w, (d, t, k)) != (d, t, k):
                cut.update(i for i, _ in ls[k : k + width])
        texts[(d, t)] = t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut)
    return Counter((d, texts[(d, t)]) for d, t in doc_rows)


def test_brute_force(docs, doc_rows):
    assert lines.remove_repeated_windows(docs).columns == docs.columns
    got = lines.remove_repeated_windows(docs, counts=("_n_lines", "_n_removed")).collect()
    assert {r._KEY for r in got} == {r._gone for r in got} == {"z"}
    assert Counter((r.doc_id, r.text) for r in got) == expected(doc_rows)
    assert sum(r._n_removed for r in got) > 0


def test_many_batches_per_task(spark, docs, doc_rows):
    """A task meets windows in later batches again, in any order of ids, with room to remember them and without."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        for remember in (lines.REMEMBER, 3):
            for order in ("doc_id", "-doc_id"):
                got = lines.remove_repeated_windows(docs.repartition(2).sortWithinPartitions(F.expr(order)), remember=remember).collect()
                assert Counter((r.doc_id, r.text) for r in got) == expected(doc_rows)
        text = "\n".join(f"line {k}" for k in range(6))
        same = spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string").coalesce(2)
        assert lines.later_windows(same).count() == 299 * 4
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_later_occurrences_go(spark):
    a = "one x\n\ntwo\nthree\nfour"
    rows = [(2, a), (1, a), (3, "zero\n" + a + "\nfive"), (4, "r\nr\nr\nr"), (5, "one x\ntwo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = {r.doc_id: r.text for r in lines.remove_repeated_windows(docs).collect()}
    assert got == {1: a, 2: "", 3: "zero\n\nfive", 4: "r", 5: "one x\ntwo"}


def test_empty(no_docs):
    assert lines.remove_repeated_windows(no_docs).count() == 0
