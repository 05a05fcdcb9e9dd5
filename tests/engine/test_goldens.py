"""Small formats with known results."""

import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from logmill.operators.aggregate import register_aggregation
from logmill.operators.summarize import malformed, observed, summarize
from logmill.operators.top import top_keys, totals
from logmill.plans.spec import SpecError, load_format
from logmill.sinks.render import json_lines
from logmill.sources.text import lines_from


def fmt(*fields, **more):
    return load_format({"format_name": "t", "delims": ",", "fields": [{"name": "id", "pos": 0, "type": "string", "key": True}, *fields], **more})


def agg(name, pos, kind, how, **more):
    return {"name": name, "pos": pos, "type": kind, "aggregated": True, "aggregation": how, **more}


def rows(spark, lines, f, **more):
    return {r.id: r for r in summarize(lines_from(spark, lines), f, **more).collect()}


PAIRS = ["1,3", "1,1", "1,5", "1,3", "1,2", "1,2"]


def test_variance_mean_sum(spark):
    for kind in ("int", "float"):
        f = fmt(agg("var", 1, kind, "variance"), agg("mean", 1, kind, "mean"), agg("sum", 1, kind, "sum"), agg("max", 1, kind, "max"), agg("n", 1, kind, "count"))
        r = rows(spark, PAIRS + ["2,7"], f)
        assert r["1"].var == pytest.approx(1.8666666666666671, abs=1e-9) and r["1"].mean == pytest.approx(2.6666666666666665, abs=1e-9)
        assert (r["1"]["sum"], r["1"]["max"], r["1"].n, r["1"].logs) == (16, 5, 6, 6)
        assert (r["2"].var, r["2"].logs) == (0, 1)


def test_created(spark):
    f = fmt(agg("v", 1, "float", "variance"))
    assert rows(spark, [f"1,{v}" for v in (1, 1, 3, 5, 4, 2, 5, 5, 5, 6, 5)], f)["1"].v == pytest.approx(3.1636363636363636, abs=1e-9)


def test_sum(spark):
    f = fmt(agg("v1", 1, "int", "sum"), agg("v2", 2, "float", "sum"))
    r = rows(spark, ["1,3,3.5", "1,1,1.0", "1,5,5.0", "1,3,3.5", "1,2,2.0", "1,2,2.0"], f)["1"]
    assert (r.v1, r.v2) == (16, 17)


def test_ratio(spark):
    f = fmt(
        agg("i1", 1, "int", "sum"), agg("i2", 2, "int", "sum"), agg("f1", 3, "float", "sum"), agg("f2", 4, "float", "sum"),
        agg("iratio", 4, "float", "ratio", numerator="i1", denominator="i2"),
        agg("fratio", 4, "float", "ratio", numerator="f1", denominator="f2"),
        agg("tratio", 4, "float", "ratio", numerator="f1", denominator="logs"),
        agg("none", 4, "float", "ratio", numerator="f1", denominator="nothing"),
    )
    r = rows(spark, ["1,3,5,3,5", "1,1,3,1,3", "1,5,7,5,7", "1,3,2,3,2", "1,2,9,2,9", "1,2,2,2,2"], f)["1"]
    assert (r.iratio, r.fratio, r.tratio, r.none) == (0.5714285969734192, 0.5714285969734192, 2.6666667461395264, 0)


def test_contain(spark):
    f = fmt({"name": "s", "pos": 1, "type": "string"}, *({"name": f"{w}_count", "pos": 1, "type": "int", "filter": w, "filter_type": "contain"} for w in ("denied", "ok")))
    r = rows(spark, ["1,ok", "1,denied", "1,ok", "1,denied", "1,ok"], f)["1"]
    assert (r.denied_count, r.ok_count) == (2, 3)


def match(**m):
    return fmt({"name": "val", "pos": 1, "type": "string"}, {"name": "m", "pos": 1, "type": "string", "match": m})


SUB, EXACT, FILE = ["1,OOKK", "2,OOKK", "3,KO"], ["1,OK", "2,OK", "3,KO", "4,KO2"], ["1,OK", "2,KO", "3,NA", "4,OK"]


@pytest.mark.parametrize(
    ("lines", "m", "ids"),
    [
        (SUB, dict(match_str="OK", logic="and"), "12"),
        (SUB, dict(match_str="KO", logic="and", negative=True), "12"),
        (SUB, dict(match_str="KO", logic="or"), "3"),
        (EXACT, dict(match_str="OK", logic="and", exact=True), "12"),
        (EXACT, dict(match_str="KO", logic="and", exact=True, negative=True), "124"),
        (EXACT, dict(match_str="OK", logic="or", exact=True), "12"),
    ],
)
def test_match(spark, lines, m, ids):
    assert sorted(rows(spark, lines, match(**m))) == list(ids)


@pytest.mark.parametrize("literal", [1000, 1])
def test_match_file(spark, tmp_path, monkeypatch, literal):
    monkeypatch.setattr("logmill.operators.match.LITERAL_WORDS", literal)
    words = tmp_path / "words"
    words.write_text("KO  NA\n")
    for logic in ("and", "or"):
        for exact in (False, True):
            assert sorted(rows(spark, FILE, match(match_file=str(words), logic=logic, negative=True, exact=exact))) == ["1", "4"]
            assert sorted(rows(spark, FILE, match(match_file=str(words), logic=logic, exact=exact))) == ([] if logic == "and" and not exact else ["2", "3"])


def test_registered_aggregation(spark):
    with pytest.raises(SpecError):
        fmt(agg("v", 1, "int", "smallest"))
    register_aggregation("smallest", lambda x, f: F.min(x))
    assert rows(spark, PAIRS, fmt(agg("v", 1, "int", "smallest")))["1"].v == 1


def test_or_group(spark):
    f = fmt(
        {"name": "a", "pos": 1, "type": "string", "match": {"match_str": "x", "logic": "or"}},
        {"name": "b", "pos": 2, "type": "string", "match": {"match_str": "y", "logic": "or"}},
        {"name": "c", "pos": 3, "type": "string", "match": {"match_str": "z", "logic": "and", "negative": True}},
    )
    assert sorted(rows(spark, ["1,x,n,n", "2,n,y,n", "3,n,n,n", "4,x,y,z"], f)) == ["1", "2"]


def test_unions(spark):
    f = fmt(agg("u", 1, "string", "union"), agg("uc", 1, "string", "union_count"), agg("ui", 2, "int", "union"), agg("uc2", 2, "string", "union_count"))
    r = rows(spark, ["1,b,2", "1,a,1", "1,b,2", "2,c,5", "2, ,5"], f)
    assert (r["1"].u, r["1"].uc, r["1"].uc_count, r["1"].ui, r["1"].uc2_count) == (["a", "b"], ["a", "b"], [1, 2], [1, 2, 2], [1, 2])
    assert (r["2"].u, r["2"].uc_count, r["2"].uc2_count) == (["c"], [1], [2])
    lines = [json.loads(x.value) for x in json_lines(summarize(lines_from(spark, ["2,c,5"]), f)).collect()]
    assert lines == [{"id": "2", "u": "c", "uc": "c", "uc_count": 1, "ui": 5, "uc2": "5", "uc2_count": 1, "logs": 1, "format_name": "t", "std_date_dt": "0000-00-00T00:00:00Z"}]


def test_malformed_first_appname_content(spark):
    f = fmt({"name": "s", "pos": 2, "type": "string"}, appname="app")
    source = lines_from(spark, ["1,a,first", "1,short", "1,b,second", "#c,x,y", "", "  ", "\t", " \x0b\t"], comment="#")
    r = summarize(source, f, store_content=True).collect()
    assert [(x._key, x.id, x.s, x.logs, x.appname, x._content) for x in r] == [("1_app", "1", "first", 2, "app", "1,a,first\n1,b,second\n")]
    assert malformed(source, f).count() == 1
    seen = Observation("lines")
    summarize(observed(source, f, seen), f).collect()
    assert seen.get == {"lines": 3, "malformed": 1}
    second = [json.loads(x.value) for x in json_lines(summarize(source, f, store_content=True)).collect()][1]
    assert second == {"id": "1_app_content", "original_size": 21, "content": {"add": "1,a,first\n1,b,second\n"}}


def test_by_file_and_case(spark):
    f = fmt()
    two = lines_from(spark, ["a,1", "b,1"], "one").unionByName(lines_from(spark, ["a,1", "A,1"], "two"))
    assert sorted((r.id, r.logs) for r in summarize(two, f, by_file=True).collect()) == [("A", 1), ("a", 1), ("a", 1), ("b", 1)]
    assert sorted((r.id, r.logs) for r in summarize(two, f).collect()) == [("A", 1), ("a", 2), ("b", 1)]
    folded = summarize(two, load_format({**f.to_dict(), "fields": [{"name": "id", "pos": 0, "type": "string", "key": True}], "ignore_case": True}))
    assert sorted(r.logs for r in folded.collect()) == [1, 3]
    assert [tuple(r) for r in top_keys(summarize(two, f), 2).collect()] == [("a", 2), ("A", 1)]
    assert tuple(totals(summarize(two, f)).collect()[0]) == (3, 4)


LIBRARY = {
    "format_name": "library", "delims": ",", "quotechar": '"', "commentchar": "%",
    "fields": [
        {"name": "branch", "pos": 0, "type": "string", "key": True},
        {"name": "hour", "pos": 1, "type": "time", "key": True, "processing": "hour", "processing_offset": 12},
        {"name": "title", "pos": 2, "type": "string"},
        {"name": "days", "pos": 3, "type": "int", "aggregated": True, "aggregation": "mean"},
        {"name": "shelves", "pos": "4", "type": "string", "aggregated": "true", "aggregation": "union"},
    ],
}


def test_quoted_fields(spark):
    lines = [
        "% branch, hour, title, days, shelves",
        'east,09:15:00,"Dune, part 2",21,"sci fi"',
        'east,11:59:59,"Emma",10,"novels"',
        'west,12:00:00,Ulysses,7,novels,"more, here"',
        'west,23:00:00,"It",8,"a, b"',
    ]
    r = rows(spark, lines[1:], load_format(LIBRARY))
    assert sorted(r) == ["east_00", "west_12"]
    assert (r["east_00"].days, r["west_12"].days) == (15.5, 7.5)
    assert r["east_00"].title == "Dune, part 2" and r["east_00"].shelves == ["novels", "sci fi"] and r["west_12"].shelves == ["a, b", "novels"]
    assert r["east_00"].std_date_dt == "0000-00-00T00:00:00Z" and r["west_12"].std_date_dt == "0000-00-00T12:00:00Z"
    assert summarize(lines_from(spark, lines, comment="%"), load_format(LIBRARY)).count() == 2
