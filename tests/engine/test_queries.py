"""Every registered query of the engine equals its SQL on the smallest tables."""

import os

import pytest

import compare
from logmill import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_queries_equal_their_sql(spark, capsys, monkeypatch):
    monkeypatch.setattr(compare, "session", lambda: spark)
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert compare.main(SF, list(queries.QUERIES)) == 0, capsys.readouterr().out


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def many_orders(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("many"))
    keys = spark.range(2_400_000).selectExpr("id AS o_orderkey", "substr('FOP', int(id % 3) + 1, 1) AS o_orderstatus", "concat(int(id % 5) + 1, '-X') AS o_orderpriority")
    keys.write.parquet(f"{folder}/orders.parquet")
    return folder


def test_data_source_files_keep_their_size(spark, many_orders, monkeypatch):
    """More orders are more log files, not larger ones: a task sorts no more of a larger table."""
    made, log_files = [], queries._log_files
    monkeypatch.setattr(queries, "_log_files", lambda *a: made.append(log_files(*a)) or made[-1])
    got = {tuple(r) for r in queries.QUERIES["data_source"](spark, many_orders).collect()}
    assert got == {(s, f"{p}-X,x", 160_000) for s in "FOP" for p in range(1, 6)}
    sizes = [r[0] for r in spark.read.text(made[0]).where("value LIKE '%-X,x%'").groupBy("_metadata.file_path").count().select("count").collect()]
    assert sum(sizes) == 2_400_000 and max(sizes) < 700_000


def test_text_files_keep_their_size(spark, many_orders, monkeypatch):
    made, log_files = [], queries._log_files
    monkeypatch.setattr(queries, "_log_files", lambda *a: made.append(log_files(*a)) or made[-1])
    got = {tuple(r) for r in queries.QUERIES["text_files"](spark, many_orders).collect()}
    pairs = ";".join(f"{p}-X,x:160000" for p in range(1, 6))
    assert got == {(s, pairs, sum(range(k, 2_400_000, 3)), 800_000) for k, s in enumerate("FOP")}
    heads = spark.read.text(made[0]).where("value = 'status,priority,order'").groupBy("_metadata.file_path").count().collect()
    assert len(heads) >= 4 and {r["count"] for r in heads} == {1}
