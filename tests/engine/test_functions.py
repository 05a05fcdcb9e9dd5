import random
import re

import pytest
from pyspark.sql import functions as F

from logmill.functions import text, times
from logmill.functions.exploders import bracketed, dns_labels, key_equals_value
from logmill.functions.urls import fill_url
from logmill.plans.spec import SpecError, load_format


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def simple_tokens(line, delims, quote):
    """One delimiter at a time: a quoted item runs to an item that ends with the quote."""
    items = [x for x in re.split("[" + re.escape(delims) + "]", line) if x]
    out, held = [], None
    for x in items:
        if held is None and quote and x[0] == quote:
            held = []
        if held is None:
            out.append(x)
        else:
            held.append(x)
            if x[-1] == quote:
                out.append(" ".join(held))
                held = None
    if held:
        out.append(" ".join(held))
    return [x.replace('"', "") for x in out]


def test_tokens_match_a_plain_loop(spark):
    rng = random.Random(1)
    lines = []
    for _ in range(600):
        parts = ["".join(rng.choice('ab"') for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 7))]
        lines.append(" ".join(parts))
    assert values(spark, lines, lambda c: text.tokens(c, " ", '"')) == [simple_tokens(x, " ", '"') for x in lines]
    odd = ["a,,b", ",a", "", ",,", "a;b,c"]
    assert values(spark, odd, lambda c: text.tokens(c, ",;")) == [["a", "b"], ["a"], [], [], ["a", "b", "c"]]
    assert values(spark, ["a,,b"], lambda c: text.tokens(c, ",", keep_empty=True)) == [["a", "", "b"]]


def test_numbers_trimming_and_keys(spark):
    raw = ["12abc", " -7", "x", "", "+5.9", "99999999999", ".5e1z", "1e3"]
    assert values(spark, raw, text.to_int) == [12, -7, 0, 0, 5, 99999999999, 0, 1]
    assert values(spark, raw, text.to_float) == [12, -7, 0, 0, 5.9, 99999999999, 5, 1000]
    assert values(spark, [" \t a b\n"], text.chomp) == ["a b"]
    assert values(spark, ["ß don't éa"], text.words) == [["DON", "T", "A"]]
    assert values(spark, ["x"], lambda c: text.fold_key([F.lit(""), F.lit(""), c, F.lit(""), F.lit("z")], "app")) == ["x__z_app"]
    assert values(spark, ["x"], lambda c: text.fold_key([], "app")) == ["_app"]
    assert values(spark, ["Az"], text.shift_letters) == ["F\x7f"]


@pytest.mark.parametrize(
    ("token", "fmt", "how", "width", "want"),
    [
        ("2012-01-05 23:04:09 tail", "%Y-%m-%d %H:%M:%S", "day", 1, "2012-1-5"),
        ("2012-01-05 23:04:09", "%Y-%m-%d %H:%M:%S", "month", 1, "2012-1"),
        ("2012-01-05 23:04:09", "%Y-%m-%d %H:%M:%S", "year", 1, "2012"),
        ("2012-01-05 03:04:09", "%Y-%m-%d %H:%M:%S", "hour", 6, "2012-1-5T3:00:00"),
        ("2012-01-05 03:47:09", "%Y-%m-%d %H:%M:%S", "minute", 10, "2012-1-5T3:40:00"),
        ("2012-01-05 03:07:09", "%Y-%m-%d %T", "second", 1, "2012-1-5T3:7:9"),
        ("5/Jan/2012:03", "%d/%b/%Y:%H", "day", 1, "2012-1-5"),
        ("1/5/2012", "%m/%d/%Y", "day", 1, "2012-1-5"),
        ("86400", "unix", "day", 1, "1970-1-2"),
        ("nonsense", "%Y-%m-%d", "day", 1, "nonsense"),
        ("2012-13-40", "%Y-%m-%d", "day", 1, "2012-13-40"),
        ("2012-01-05T03:00:00+00:00", "%Y-%m-%dT%H:%M:%S+00:00", "day", 1, "2012-1-5"),
        ("2012-01-05", "%Y-%m-%d", "", 1, "2012-01-05"),
    ],
)
def test_dates(spark, token, fmt, how, width, want):
    assert values(spark, [token], lambda c: times.bucket_date(c, how, fmt, width)) == [want]


@pytest.mark.parametrize(
    ("token", "how", "width", "want"),
    [("23:14:09", "hour", 1, "23"), ("05:14:09", "hour", 6, "00"), ("5:14:09", "minute", 10, "5:10"), ("5:14:39", "second", 30, "5:14:30"), ("5:14", "hour", 1, "5:14"), (" 07:01:02 ", "minute", 1, "07:01")],
)
def test_times(spark, token, how, width, want):
    assert values(spark, [token], lambda c: times.bucket_time(c, how, width)) == [want]


def test_unknown_directive():
    with pytest.raises(ValueError):
        times.translate_format("%Y-%Q")


def test_urls(spark):
    urls = ["http://a.b:80/p/q?x=1#f", "https://a.b/p", "no-scheme/x", "http://[::1]/x"]
    assert values(spark, urls, lambda c: fill_url(c, "%scheme://%host%port%path|%query|%fragment")) == ["http://a.b:80/p/q|x=1|f", "https://a.b/p||", "no-scheme/x", "http://[::1]/x"]
    assert values(spark, urls[:2], lambda c: fill_url(c, "%scheme://%host%port")) == ["http://a.b:80", "https://a.b"]


def test_exploders(spark):
    one = lambda f: lambda c: f(c, F.array(c))
    got = values(spark, ["x -> first key = v one second = v two third = last one ", "none", "a -> b = c"], one(key_equals_value))
    assert got == [{"first key": "v one", "second": "v two", "third": "last one"}, {}, {"b": "c"}]
    assert values(spark, ["[k: v] [a b: 1:2] [bad] [k: w]", ""], one(bracketed)) == [{"k": "w", "a b": "12] "}, {}]
    assert values(spark, ["[k: v]"], one(bracketed)) == [{"k": "v"}]
    assert values(spark, ["(3)www(6)google(3)com(0)", "x"], one(dns_labels)) == [{"target": "www.google.com"}, {}]


def test_format_loading(recwarn):
    f = load_format('{"delims": ",", "format_name": "x", "oops": 1, "fields": [{"name": "a", "type": "int", "pos": "4"}, {"name": "b", "type": "string"}, {"name": "c", "type": "string", "key": "true"},]}')
    assert [x.pos for x in f.fields] == [4, 0, 1] and f.fields[2].key is True and f.max_pos == 4
    assert any("oops" in str(w.message) for w in recwarn.list)
    assert load_format(f.to_dict()) == f
    for bad in (
        {"format_name": "x", "fields": []},
        {"delims": ",", "fields": [{"name": "a", "type": "decimal"}]},
        {"delims": ",", "fields": [{"name": "a", "type": "int", "aggregated": True, "aggregation": "median"}]},
        {"delims": ",", "fields": [{"name": "a", "type": "int"}, {"name": "a", "type": "int"}]},
        {"delims": ",", "fields": [{"name": "a", "type": "int", "pos": "x"}]},
    ):
        with pytest.raises(SpecError):
            load_format(bad)
