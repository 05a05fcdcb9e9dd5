"""Registered queries over the driver's tables, each with DuckDB SQL for the same rows.

Most go through the whole engine: a table becomes log lines (or tokens), a format
summarises them. Doubles are rounded, lists are joined text, so that values compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.functions import exploders, text, urls
from logmill.operators import kernels
from logmill.operators.aggregate import register_aggregation
from logmill.operators.match import apply_matches, contains_any
from logmill.operators.order import dealt, numbered
from logmill.operators.summarize import summarize, tokenize
from logmill.operators.top import top_keys, totals
from logmill.plans import job
from logmill.plans.spec import LogFormat, load_format
from logmill.sinks.render import csv_frame, json_lines, text_lines
from logmill.sinks.write import post_lines, print_top
from logmill.sources.binary import grid_points, random_words, read_bitmaps, read_points
from logmill.sources.scratch import file_system, new_folder
from logmill.sources.text import lines_from, lines_of_table, read_lines, tokens_of_table
from logmill.streaming.incremental import start_to_table, summarize_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


def _field(name: str, pos: int, kind: str = "string", how: str = "", **more) -> dict:
    return {"name": name, "pos": pos, "type": kind} | ({"aggregated": True, "aggregation": how} if how else {}) | more


def _key(name: str, pos: int, kind: str = "string", **more) -> dict:
    return _field(name, pos, kind, key=True, **more)


def _format(*fields: dict, **more) -> LogFormat:
    return load_format({"format_name": "table", "delims": "|", "fields": list(fields), **more})


def _joined(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(c.cast("array<string>"), ",")


def _lineitem(spark: SparkSession, sf_dir: str, *columns: str, source: Callable = lines_of_table) -> DataFrame:
    """Lines ``flag|status|columns...``, or the columns as tokens without making and parsing text."""
    order = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return source(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", *columns], order=order)


_FLAGS = (_key("flag", 0), _key("status", 1))
_BY_FLAGS = "l_returnflag || '_' || l_linestatus AS id"


@query(
    "agg_sum",
    f"""SELECT {_BY_FLAGS}, round(sum(l_quantity), 4) AS qty, sum(CAST(l_linenumber AS BIGINT))::BIGINT AS numbers, count(*)::BIGINT AS logs
    FROM lineitem GROUP BY 1""",
)
def agg_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmt = _format(*_FLAGS, _field("qty", 2, "float", "sum"), _field("numbers", 3, "int", "sum"))
    out = summarize(_lineitem(spark, sf_dir, "l_quantity", "l_linenumber", source=tokens_of_table), fmt)
    return out.select("id", F.round("qty", 4).alias("qty"), "numbers", "logs")


@query("agg_mean", f"SELECT {_BY_FLAGS}, round(avg(l_quantity), 6) AS qty, round(avg(l_linenumber), 6) AS number FROM lineitem GROUP BY 1")
def agg_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmt = _format(*_FLAGS, _field("qty", 2, "float", "mean"), _field("number", 3, "int", "mean"))
    out = summarize(_lineitem(spark, sf_dir, "l_quantity", "l_linenumber"), fmt)
    return out.select("id", F.round("qty", 6).alias("qty"), F.round("number", 6).alias("number"))


@query("agg_max", f"SELECT {_BY_FLAGS}, max(l_extendedprice) AS price, max(l_linenumber)::BIGINT AS number FROM lineitem GROUP BY 1")
def agg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmt = _format(*_FLAGS, _field("price", 2, "float", "max"), _field("number", 3, "int", "max"))
    return summarize(_lineitem(spark, sf_dir, "l_extendedprice", "l_linenumber"), fmt).select("id", "price", "number")


@query("agg_variance", "SELECT CAST(l_orderkey AS VARCHAR) AS id, round(coalesce(var_samp(l_quantity), 0), 6) AS qty, count(*)::BIGINT AS logs FROM lineitem GROUP BY 1")
def agg_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tokens_of_table(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_quantity"])
    out = summarize(lines, _format(_key("order", 0), _field("qty", 1, "float", "variance")))
    return out.select("id", F.round("qty", 6).alias("qty"), "logs")


@query("agg_count", "SELECT event_type AS id, count(value)::BIGINT AS n, count(*)::BIGINT AS logs FROM events GROUP BY 1")
def agg_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of_table(table(spark, sf_dir, "events"), ["event_type", "value"])
    return summarize(lines, _format(_key("kind", 0), _field("n", 1, "string", "count"))).select("id", "n", "logs")


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of_table(table(spark, sf_dir, "events"), ["user_id", "event_type"], order=F.col("event_id"))


@query("agg_union", "SELECT CAST(user_id AS VARCHAR) AS id, string_agg(event_type, ',' ORDER BY event_type) AS kinds FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def agg_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summarize(_users(spark, sf_dir), _format(_key("user", 0), _field("kinds", 1, "string", "union")))
    return out.select("id", _joined("kinds").alias("kinds"))


@query(
    "agg_union_count",
    """SELECT CAST(user_id AS VARCHAR) AS id, string_agg(event_type, ',' ORDER BY event_type) AS kinds,
    string_agg(CAST(c AS VARCHAR), ',' ORDER BY event_type) AS counts, sum(c)::BIGINT AS logs
    FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL) GROUP BY 1""",
)
def agg_union_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summarize(_users(spark, sf_dir), _format(_key("user", 0), _field("kinds", 1, "string", "union_count")))
    return out.select("id", _joined("kinds").alias("kinds"), _joined("kinds_count").alias("counts"), "logs")


@query("agg_union_list", "SELECT CAST(o_custkey AS VARCHAR) AS id, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def agg_union_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of_table(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"])
    return summarize(lines, _format(_key("customer", 0), _field("orders", 1, "int", "union"))).select("id", _joined("orders").alias("orders"))


@query(
    "agg_ratio",
    f"""SELECT {_BY_FLAGS}, round(CAST(CAST(sum(CAST(l_quantity AS BIGINT)) AS FLOAT) / CAST(sum(CAST(l_linenumber AS BIGINT)) AS FLOAT) AS DOUBLE), 6) AS per_number,
    round(CAST(CAST(sum(CAST(l_linenumber AS BIGINT)) AS FLOAT) / CAST(count(*) AS FLOAT) AS DOUBLE), 6) AS per_log, CAST(0 AS DOUBLE) AS nothing FROM lineitem GROUP BY 1""",
)
def agg_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmt = _format(
        *_FLAGS,
        _field("qty", 2, "int", "sum"),
        _field("number", 3, "int", "sum"),
        _field("per_number", 3, "float", "ratio", numerator="qty", denominator="number"),
        _field("per_log", 3, "float", "ratio", numerator="number", denominator="logs"),
        _field("nothing", 3, "float", "ratio", numerator="qty", denominator="missing"),
    )
    out = summarize(_lineitem(spark, sf_dir, "l_quantity", "l_linenumber", source=tokens_of_table), fmt)
    return out.select("id", F.round("per_number", 6).alias("per_number"), F.round("per_log", 6).alias("per_log"), "nothing")


@query("agg_first", "SELECT CAST(o_custkey AS VARCHAR) AS id, arg_min(o_orderpriority, o_orderkey) AS priority, arg_min(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1")
def agg_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of_table(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority", "o_totalprice"], order=F.col("o_orderkey"))
    return summarize(lines, _format(_key("customer", 0), _field("priority", 1), _field("price", 2, "float"))).select("id", "priority", "price")


@query(
    "agg_content",
    """SELECT CAST(o_custkey AS VARCHAR) AS id, string_agg(CAST(o_custkey AS VARCHAR) || '|' || CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY o_orderkey) || chr(10) AS content FROM orders GROUP BY 1""",
)
def agg_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of_table(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"], order=F.col("o_orderkey"))
    return summarize(lines, _format(_key("customer", 0)), store_content=True).select("id", F.col("_content").alias("content"))


@query(
    "filter_contain",
    """SELECT CAST(user_id AS VARCHAR) AS id, sum(CAST(contains(event_type, 'c') AS INT))::BIGINT AS with_c, sum(CAST(contains(event_type, 'view') AS INT))::BIGINT AS views FROM events GROUP BY 1""",
)
def filter_contain(spark: SparkSession, sf_dir: str) -> DataFrame:
    contain = lambda name, what: _field(name, 1, "int", filter=what, filter_type="contain")
    out = summarize(_users(spark, sf_dir), _format(_key("user", 0), _field("kind", 1), contain("with_c", "c"), contain("views", "view")))
    return out.select("id", "with_c", "views")


def _parts(spark: SparkSession, sf_dir: str, *matches: dict) -> DataFrame:
    lines = lines_of_table(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_name"])
    extra = [_field(f"m{i}", pos, match=m) for i, (pos, m) in enumerate(matches)]
    return summarize(lines, _format(_key("brand", 0), _field("type", 1), _field("name", 2), *extra)).select("id", "logs")


def _part_sql(where: str) -> str:
    return f"SELECT p_brand AS id, count(*)::BIGINT AS logs FROM part WHERE {where} GROUP BY 1"


@query("match_and", _part_sql("contains(p_type, 'A') AND contains(p_name, 'bolt')"))
def match_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, (1, {"match_str": "A", "logic": "and"}), (2, {"match_str": "bolt", "logic": "and"}))


@query("match_or", _part_sql("contains(p_type, 'AN') OR contains(p_name, 'red')"))
def match_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, (1, {"match_str": "AN", "logic": "or"}), (2, {"match_str": "red", "logic": "or"}))


@query("match_negative", _part_sql("NOT contains(p_name, 'an')"))
def match_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, (2, {"match_str": "an", "logic": "and", "negative": True}))


def _statuses(spark: SparkSession, sf_dir: str, **match) -> DataFrame:
    lines = lines_of_table(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"])
    return summarize(lines, _format(_key("priority", 0), _field("status", 1, match=match))).select("id", "logs")


@query("match_exact", "SELECT o_orderpriority AS id, count(*)::BIGINT AS logs FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir, match_str="O", exact=True, logic="and")


@query("match_exact_negative", "SELECT o_orderpriority AS id, count(*)::BIGINT AS logs FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1")
def match_exact_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir, match_str="O", exact=True, negative=True, logic="and")


def _word_file(spark: SparkSession, words: DataFrame) -> str:
    """Words as a text file below the shared folder."""
    path = new_folder(spark, "words")
    words.select(F.col(words.columns[0]).cast("string").alias("value")).write.text(path)
    return path


def _by_customer(spark: SparkSession, sf_dir: str, negative: bool) -> DataFrame:
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey")
    match = {"match_file": _word_file(spark, rich), "exact": True, "logic": "and", "negative": negative}
    lines = lines_of_table(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_custkey"])
    return summarize(lines, _format(_key("status", 0), _field("customer", 1, match=match))).select("id", "logs")


@query("match_list_semi", "SELECT o_orderstatus AS id, count(*)::BIGINT AS logs FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY 1")
def match_list_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_customer(spark, sf_dir, False)


@query("match_list_anti", "SELECT o_orderstatus AS id, count(*)::BIGINT AS logs FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY 1")
def match_list_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_customer(spark, sf_dir, True)


@query(
    "match_substring_anti",
    """SELECT p_brand AS id, count(*)::BIGINT AS logs FROM part p WHERE NOT EXISTS (SELECT 1 FROM customer WHERE contains(p.p_name, lower(substr(c_mktsegment, 1, 2)))) GROUP BY 1""",
)
def match_substring_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _word_file(spark, table(spark, sf_dir, "customer").select(F.lower(F.substring("c_mktsegment", 1, 2))))
    return _parts(spark, sf_dir, (2, {"match_file": words, "logic": "and", "negative": True}))


@query("match_any_word", "SELECT p_partkey FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'old')")
def match_any_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(contains_any(F.col("p_name"), ["ring", "old"])).select("p_partkey")


@query(
    "tokenize_quoted",
    """SELECT o_orderkey, CAST(4 AS BIGINT) AS n, o_orderpriority || ' x  y' AS quoted, CAST(o_custkey AS VARCHAR) AS last FROM orders""",
)
def tokenize_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    line = F.concat(F.lit("a "), F.col("o_orderkey").cast("string"), F.lit(' "'), "o_orderpriority", F.lit(' x  y" '), F.col("o_custkey").cast("string"))
    found = orders.select("o_orderkey", text.tokens(line, " ", '"').alias("t"))
    return found.select("o_orderkey", F.size("t").cast("bigint").alias("n"), F.get("t", F.lit(2)).alias("quoted"), F.get("t", F.lit(3)).alias("last"))


@query("tokenize_collapse", "SELECT n_nationkey, n_name AS second, CAST(3 AS BIGINT) AS n FROM nation")
def tokenize_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit(",,"), F.col("n_nationkey").cast("string"), F.lit(",,;"), F.col("n_name"), F.lit(";"), F.col("n_regionkey").cast("string"), F.lit(",,"))
    found = table(spark, sf_dir, "nation").select("n_nationkey", text.tokens(line, ",;").alias("t"))
    return found.select("n_nationkey", F.get("t", F.lit(1)).alias("second"), F.size("t").cast("bigint").alias("n"))


@query("key_fold", "SELECT o_orderstatus || '_' || o_orderpriority || '_app' AS id, count(*)::BIGINT AS logs FROM orders GROUP BY 1")
def key_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of_table(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])
    return summarize(lines, _format(_key("s", 0), _key("p", 1), appname="app")).select(F.col("_key").alias("id"), "logs")


@query("malformed_drop", "SELECT count(*)::BIGINT AS logs, min(n_nationkey)::BIGINT AS least FROM nation WHERE n_nationkey % 3 <> 0")
def malformed_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    tail = F.when(F.col("n_nationkey") % 3 == 0, F.lit("")).otherwise(F.lit("x"))
    kept = tokenize(lines_of_table(nation, ["n_nationkey", "n_name", tail]), _format(_key("k", 0), _field("n", 1), _field("t", 2)))
    return kept.agg(F.count(F.lit(1)).alias("logs"), F.min(text.to_int(F.get("tokens", F.lit(0)))).alias("least"))


@query("parse_numbers", "SELECT c_custkey, c_custkey AS as_int, CAST(c_acctbal AS DOUBLE) AS as_float, CAST(0 AS BIGINT) AS none FROM customer")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    as_int = text.to_int(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit("abc")))
    as_float = text.to_float(F.concat(F.col("c_acctbal").cast("string"), F.lit(" eur")))
    return c.select("c_custkey", as_int.alias("as_int"), as_float.alias("as_float"), text.to_int(F.col("c_mktsegment")).alias("none"))


def _event_time(fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format("ts", fmt)


def _dates(name: str, sql: str, how: str, width: int = 1) -> None:
    @query(f"date_{name}", f"SELECT {sql} AS id, count(*)::BIGINT AS logs FROM events GROUP BY 1")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = lines_of_table(table(spark, sf_dir, "events"), [_event_time()])
        fmt = _format(_key("date", 0, "date", date_format="%Y-%m-%d %H:%M:%S", processing=how, processing_offset=width))
        return summarize(lines, fmt).select("id", "logs")


_DAY = "CAST(year(ts) AS VARCHAR) || '-' || CAST(month(ts) AS VARCHAR) || '-' || CAST(day(ts) AS VARCHAR)"
_dates("day", _DAY, "day")
_dates("month", "CAST(year(ts) AS VARCHAR) || '-' || CAST(month(ts) AS VARCHAR)", "month")
_dates("year", "CAST(year(ts) AS VARCHAR)", "year")
_dates("hour", f"{_DAY} || 'T' || CAST(hour(ts) AS VARCHAR) || ':00:00'", "hour")
_dates("minute10", f"{_DAY} || 'T' || CAST(hour(ts) AS VARCHAR) || ':' || lpad(CAST(minute(ts) // 10 * 10 AS VARCHAR), 2, '0') || ':00'", "minute", 10)
_dates("second", f"{_DAY} || 'T' || CAST(hour(ts) AS VARCHAR) || ':' || CAST(minute(ts) AS VARCHAR) || ':' || CAST(second(ts) AS VARCHAR)", "second")


@query("date_unix", f"SELECT {_DAY} AS id, count(*)::BIGINT AS logs FROM events GROUP BY 1")
def date_unix(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    lines = lines_of_table(table(spark, sf_dir, "events"), [seconds])
    return summarize(lines, _format(_key("date", 0, "date", date_format="unix", processing="day"))).select("id", "logs")


def _times(name: str, sql: str, how: str, width: int = 1) -> None:
    @query(f"time_{name}", f"SELECT {sql} AS id, count(*)::BIGINT AS logs FROM events GROUP BY 1")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = lines_of_table(table(spark, sf_dir, "events"), [_event_time("HH:mm:ss")])
        return summarize(lines, _format(_key("time", 0, "time", processing=how, processing_offset=width))).select("id", "logs")


_times("hour6", "lpad(CAST(hour(ts) // 6 * 6 AS VARCHAR), 2, '0')", "hour", 6)
_times("minute", "strftime(ts, '%H') || ':' || lpad(CAST(minute(ts) // 15 * 15 AS VARCHAR), 2, '0')", "minute", 15)
_times("second", "strftime(ts, '%H:%M') || ':' || lpad(CAST(second(ts) // 30 * 30 AS VARCHAR), 2, '0')", "second", 30)


@query(
    "std_date",
    f"""SELECT CAST(event_id AS VARCHAR) AS id, {_DAY} || 'T' || strftime(ts, '%H') || ':00:00Z' AS std_date_dt FROM events""",
)
def std_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of_table(table(spark, sf_dir, "events"), ["event_id", _event_time("yyyy-MM-dd"), _event_time("HH:mm:ss")])
    fmt = _format(_key("event", 0), _field("date", 1, "date", date_format="%Y-%m-%d", processing="day"), _field("time", 2, "time", processing="hour"))
    return summarize(lines, fmt).select("id", "std_date_dt")


@query(
    "url_template",
    r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '|' || regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) || '|' || regexp_extract(url, '^[a-z]+://[^/?#]*?(:[0-9]+)?([/?#]|$)', 1)
    || '|' || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) || '|' || regexp_extract(url, '\?([^#]*)', 1) || '|' || regexp_extract(url, '#(.*)$', 1) AS parts FROM pages""",
)
def url_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.fill_url(F.col("url"), "%scheme|%host|%port|%path|%query|%fragment").alias("parts"))


@query("explode_kv", "SELECT event_id, CAST(user_id AS VARCHAR) AS account, event_type || ' x' AS kind FROM events")
def explode_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("msg -> Account Id = "), F.col("user_id").cast("string"), F.lit(" Kind = "), F.col("event_type"), F.lit(" x "))
    found = table(spark, sf_dir, "events").select("event_id", exploders.key_equals_value(line, F.array(line)).alias("m"))
    return found.select("event_id", F.col("m")["Account Id"].alias("account"), F.col("m")["Kind"].alias("kind"))


@query("explode_bracket", "SELECT event_id, CAST(user_id AS VARCHAR) AS account, event_type AS kind FROM events")
def explode_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("[user: "), F.col("user_id").cast("string"), F.lit("][kind: "), F.col("event_type"), F.lit("]"))
    found = table(spark, sf_dir, "events").select("event_id", exploders.bracketed(line, F.array(line)).alias("m"))
    return found.select("event_id", F.col("m")["user"].alias("account"), F.col("m")["kind"].alias("kind"))


@query("explode_dns", "SELECT event_id, 'www.' || event_type || '.com' AS target FROM events")
def explode_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("(3)www("), F.length("event_type").cast("string"), F.lit(")"), F.col("event_type"), F.lit("(3)com(0)"))
    return table(spark, sf_dir, "events").select("event_id", exploders.dns_labels(line, F.array(line))["target"].alias("target"))


@query("topn_logs", "SELECT CAST(user_id AS VARCHAR) AS id, count(*)::BIGINT AS logs FROM events GROUP BY 1 ORDER BY logs DESC, id LIMIT 5")
def topn_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_keys(summarize(_users(spark, sf_dir), _format(_key("user", 0))), 5)


@query("totals", "SELECT count(DISTINCT user_id)::BIGINT AS n_keys, count(*)::BIGINT AS n_logs FROM events")
def all_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(summarize(_users(spark, sf_dir), _format(_key("user", 0))))


def _two_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    a = lines_of_table(nation, ["n_regionkey"], file=F.lit("nation"))
    return a.unionByName(lines_of_table(region, ["r_regionkey"], file=F.lit("region")))


_BOTH = "(SELECT 'nation' AS f, n_regionkey AS k FROM nation UNION ALL SELECT 'region', r_regionkey FROM region)"


@query("per_file", f"SELECT f AS file, CAST(k AS VARCHAR) AS id, count(*)::BIGINT AS logs FROM {_BOTH} GROUP BY 1, 2")
def per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(_two_files(spark, sf_dir), _format(_key("k", 0)), by_file=True).select(F.col("_file").alias("file"), "id", "logs")


@query("merged_files", f"SELECT CAST(k AS VARCHAR) AS id, count(*)::BIGINT AS logs FROM {_BOTH} GROUP BY 1")
def merged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(_two_files(spark, sf_dir), _format(_key("k", 0))).select("id", "logs")


@query("ignore_case", "SELECT lower(o_orderstatus) AS id, count(*)::BIGINT AS logs FROM orders GROUP BY 1")
def ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))
    out = summarize(lines_of_table(table(spark, sf_dir, "orders"), [mixed]), _format(_key("s", 0), ignore_case=True))
    return out.select(F.lower("_key").alias("id"), "logs")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of_table(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"])
    return summarize(lines, _format(_key("nation", 0), _field("name", 1), _field("region", 2, "int", "sum")))


@query(
    "json_out",
    """SELECT '{"format_name":"table","id":"' || CAST(n_nationkey AS VARCHAR) || '","logs":1,"name":"' || n_name || '","nation":"' || CAST(n_nationkey AS VARCHAR)
    || '","region":' || CAST(n_regionkey AS VARCHAR) || ',"std_date_dt":"0000-00-00T00:00:00Z"}' AS value FROM nation""",
)
def json_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_lines(_nations(spark, sf_dir))


@query(
    "csv_out",
    """SELECT 'table' AS format_name, CAST(n_nationkey AS VARCHAR) AS id, CAST(1 AS BIGINT) AS logs, n_name AS name, CAST(n_nationkey AS VARCHAR) AS nation, CAST(n_regionkey AS BIGINT) AS region,
    '0000-00-00T00:00:00Z' AS std_date_dt FROM nation""",
)
def csv_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_frame(_nations(spark, sf_dir))


@query("text_out", "SELECT CAST(n_nationkey AS VARCHAR) || ' - 1' AS value FROM nation")
def text_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(_nations(spark, sf_dir))


@query("table_tokens", "SELECT o_orderstatus AS id, sum(CAST(o_totalprice AS BIGINT) * 0 + o_custkey)::BIGINT AS customers FROM orders GROUP BY 1")
def table_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens_of_table(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_custkey"])
    return summarize(rows, _format(_key("s", 0), _field("customers", 1, "int", "sum"))).select("id", "customers")


@query("matched_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND contains(o_orderpriority, '1')")
def matched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens_of_table(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_orderkey"])
    fmt = _format(_field("s", 0, match={"match_str": "F", "exact": True, "logic": "and"}), _field("p", 1, match={"match_str": "1", "logic": "or"}))
    return apply_matches(rows, fmt).select(text.to_int(F.get("tokens", F.lit(2))).alias("o_orderkey"))


_WORDS = "(SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: upper(x))) AS word FROM documents)"


@query("wordcount", f"SELECT word, count(*)::BIGINT AS n FROM {_WORDS} GROUP BY 1")
def wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.word_count(table(spark, sf_dir, "documents"))


@query("top_words", f"SELECT word, count(*)::BIGINT AS n FROM {_WORDS} GROUP BY 1 ORDER BY n DESC, word LIMIT 10")
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.top_words(table(spark, sf_dir, "documents"), 10)


@query(
    "inverted_index",
    """SELECT word, doc, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM (
      SELECT doc_id AS doc, upper(w[i]) AS word, i - 1 AS pos FROM (
        SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents)))
    GROUP BY 1, 2""",
)
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kernels.inverted_index(table(spark, sf_dir, "documents"), "doc_id")
    return out.select("word", "doc", _joined("positions").alias("positions"))


@query("histogram", "SELECT l_returnflag AS channel, CAST(l_quantity AS BIGINT) AS value, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.histogram(table(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_quantity").cast("bigint"))


@query(
    "linreg",
    """SELECT count(*)::BIGINT AS n, round(regr_intercept(l_extendedprice, l_quantity), 4) AS a, round(regr_slope(l_extendedprice, l_quantity), 4) AS b,
    round(avg(l_quantity), 4) AS xbar, round(avg(l_extendedprice), 4) AS ybar, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""",
)
def linreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = kernels.linear_regression(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return r.select("n", *(F.round(c, 4).alias(c) for c in ("a", "b", "xbar", "ybar")), F.round("r2", 6).alias("r2"))


_CELLS = "(SELECT vec_id, unnest(range(0, len(embedding))) AS d, unnest(embedding) AS v FROM embeddings)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("d", "v"))


@query(
    "covariance",
    f"""WITH c AS (SELECT d AS i, vec_id AS j, CAST(round(CAST(v AS DOUBLE) * 1000) AS BIGINT) AS v FROM {_CELLS}),
    m AS (SELECT i, sum(v) / (SELECT max(j) + 1 FROM c) AS m FROM c GROUP BY 1), x AS (SELECT c.i, c.j, c.v - m.m AS e FROM c JOIN m USING (i))
    SELECT a.i::BIGINT AS i, b.i::BIGINT AS j, round(sum(a.e * b.e) / (SELECT max(i) FROM c), 2) AS cov FROM x a JOIN x b ON a.j = b.j AND a.i <= b.i GROUP BY 1, 2""",
)
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.round(F.col("v").cast("double") * 1000).cast("bigint")
    matrix = _cells(spark, sf_dir).select(F.col("d").cast("bigint").alias("i"), F.col("vec_id").alias("j"), whole.alias("v"))
    return kernels.row_covariance(matrix).select("i", "j", F.round("cov", 2).alias("cov"))


@query("column_covariance", "SELECT round(covar_samp(l_quantity, l_quantity), 4) AS qq, round(covar_samp(l_quantity, l_discount), 6) AS qd FROM lineitem")
def column_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = kernels.column_covariance(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return r.select(F.round("cov_l_quantity_l_quantity", 4).alias("qq"), F.round("cov_l_quantity_l_discount", 6).alias("qd"))


@query(
    "matmul",
    f"""WITH c AS (SELECT d, vec_id, CAST(round(CAST(v AS DOUBLE) * 100) AS BIGINT) AS v FROM {_CELLS})
    SELECT a.d::BIGINT AS i, b.d::BIGINT AS j, sum(a.v * b.v)::BIGINT AS v FROM c a JOIN c b ON a.vec_id = b.vec_id GROUP BY 1, 2""",
)
def matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.round(F.col("v").cast("double") * 100).cast("bigint").alias("v")
    cells = _cells(spark, sf_dir)
    left = cells.select(F.col("d").cast("bigint").alias("i"), F.col("vec_id").alias("j"), whole)
    right = cells.select(F.col("vec_id").alias("i"), F.col("d").cast("bigint").alias("j"), whole)
    return kernels.matrix_product(left, right)


_SEEDS = "(SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k, embedding AS m FROM embeddings ORDER BY vec_id LIMIT 4)"


@query(
    "kmeans_step",
    f"""WITH s AS {_SEEDS}, d AS (SELECT p.vec_id, s.k, list_sum(list_transform(range(1, len(p.embedding) + 1), lambda i: (CAST(p.embedding[i] AS DOUBLE) - CAST(s.m[i] AS DOUBLE)) ** 2)) AS dist
      FROM embeddings p, s), a AS (SELECT vec_id, arg_min(k, struct_pack(d := round(dist, 9), k := k)) AS cluster FROM d GROUP BY 1)
    SELECT cluster::BIGINT AS cluster, count(*)::BIGINT AS n, sum(vec_id)::BIGINT AS ids FROM a GROUP BY 1""",
)
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("point"))
    means = [list(r[0]) for r in points.orderBy("vec_id").limit(4).select("point").collect()]
    found = kernels.assign_nearest(points, means)
    return found.groupBy(F.col("cluster").cast("bigint").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"))


@query("random_words_index", "SELECT CAST(20000 AS BIGINT) AS positions, CAST(true AS BOOLEAN) AS all_short")
def random_words_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self-check of the generator and the index: every generated word is found once."""
    found = kernels.word_positions(random_words(spark, 20_000), "doc")
    return found.agg(F.count(F.lit(1)).alias("positions"), (F.max(F.length("word")) == 3).alias("all_short"))


#: Orders of a log file, about.
FILE_ROWS = 500_000


def _log_files(spark: SparkSession, sf_dir: str) -> str:
    """Orders as text files with a header, comments and blank lines, below the shared folder."""
    folder, orders = new_folder(spark, "logs"), table(spark, sf_dir, "orders")
    # As many files as the rows ask for, so that no task sorts or writes more than a file's.
    orders = orders.repartitionByRange(max(2, -(-orders.count() // FILE_ROWS)), "o_orderkey").sortWithinPartitions("o_orderkey")
    row = F.concat_ws(",", F.col("o_orderstatus"), F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit(',x"')), F.col("o_orderkey").cast("string"))
    noise = F.when(F.col("o_orderkey") % 5 == 0, F.lit("# a comment")).when(F.col("o_orderkey") % 7 == 0, F.lit("   ")).when(F.col("o_orderkey") % 11 == 0, F.lit("\t \x0b")).otherwise(F.lit("bad line"))
    lines = orders.select(F.explode(F.array(row, noise)).alias("value"))

    def with_header(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            values = b.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"value": pa.array((["status,priority,order"] if first else []) + values, pa.string())})
            first = False

    lines.mapInArrow(with_header, "value string").write.text(folder)
    return folder


_FILE_FIELDS = (_key("status", 0), _field("priority", 1, "string", "union_count"), _field("orders", 2, "int", "sum"))


@query(
    "text_files",
    """WITH c AS (SELECT o_orderstatus AS id, o_orderpriority || ',x' AS p, count(*) AS c, sum(o_orderkey) AS s FROM orders GROUP BY ALL)
    SELECT id, string_agg(p || ':' || CAST(c AS VARCHAR), ';' ORDER BY p) AS priorities, sum(s)::BIGINT AS orders, sum(c)::BIGINT AS logs FROM c GROUP BY 1""",
)
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through real files: headers, comments, blank and malformed lines are left out, quoted fields stay whole."""
    lines = read_lines(spark, _log_files(spark, sf_dir), header=True, comment="#")
    fmt = load_format({"format_name": "files", "delims": ",", "quotechar": '"', "commentchar": "#", "fields": list(_FILE_FIELDS)})
    out = summarize(lines, fmt)
    pairs = F.array_join(F.zip_with("priority", "priority_count", lambda k, c: F.concat(k, F.lit(":"), c.cast("string"))), ";")
    return out.select("id", pairs.alias("priorities"), "orders", "logs")


@query("data_source", "SELECT o_orderstatus AS status, o_orderpriority || ',x' AS priority, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def data_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files through ``spark.read.format("logmill")``."""
    import json

    from logmill.sources.datasource import LogSource

    spark.dataSource.register(LogSource)
    folder = _log_files(spark, sf_dir)
    files = [r[0] for r in spark.read.format("binaryFile").load(folder).select("path").collect()]
    fmt = {"format_name": "files", "delims": ",", "quotechar": '"', "commentchar": "#", "fields": list(_FILE_FIELDS)}
    df = spark.read.format("logmill").options(format=json.dumps(fmt), header="true").load(",".join(files))
    return df.groupBy("status", "priority").agg(F.count(F.lit(1)).alias("n"))


_PRICES = "(SELECT DISTINCT CAST(CAST(trunc(c_acctbal) AS BIGINT) AS VARCHAR) AS w FROM customer)"


@query("match_long_list", f"SELECT o_orderstatus AS id, count(*)::BIGINT AS logs FROM orders WHERE NOT EXISTS (SELECT 1 FROM {_PRICES} WHERE contains(CAST(o_totalprice AS VARCHAR), w)) GROUP BY 1")
def match_long_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A substring list that becomes a join where it has more than a thousand words."""
    words = _word_file(spark, table(spark, sf_dir, "customer").select(F.col("c_acctbal").cast("bigint")))
    lines = lines_of_table(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_totalprice"])
    match = {"match_file": words, "logic": "and", "negative": True}
    return summarize(lines, _format(_key("status", 0), _field("price", 1, match=match))).select("id", "logs")


@query("registered_aggregation", "SELECT CAST(o_custkey AS VARCHAR) AS id, min(o_totalprice) AS least FROM orders GROUP BY 1")
def registered_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregation of one's own, named by a format."""
    register_aggregation("least", lambda x, f: F.min(x))
    lines = lines_of_table(table(spark, sf_dir, "orders"), ["o_custkey", "o_totalprice"])
    return summarize(lines, _format(_key("customer", 0), _field("least", 1, "float", "least"))).select("id", "least")


@query("registered_exploder", "SELECT CAST(o_custkey AS VARCHAR) AS id, arg_min(o_orderpriority[1:1], o_orderkey) AS level, arg_min(o_orderpriority[3:], o_orderkey) AS name FROM orders GROUP BY 1")
def registered_exploder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping of one's own: a field that unfolds into others."""
    exploders.register_exploder("level", lambda token, tail: F.create_map(F.lit("level"), F.substring_index(token, "-", 1), F.lit("name"), F.regexp_extract(token, "-(.*)", 1)))
    lines = lines_of_table(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], order=F.col("o_orderkey"))
    out = summarize(lines, _format(_key("customer", 0), _field("priority", 1, preprocessing="level")))
    return out.select("id", F.col("extra")["level"].alias("level"), F.col("extra")["name"].alias("name"))


@query("auto_position", f"SELECT {_BY_FLAGS}, sum(CAST(l_quantity AS BIGINT))::BIGINT AS qty FROM lineitem GROUP BY 1")
def auto_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields without positions are numbered as they come."""
    fields = [{"name": "flag", "type": "string", "key": True}, {"name": "status", "type": "string", "key": True}, {"name": "qty", "type": "int", "aggregated": True, "aggregation": "sum"}]
    return summarize(_lineitem(spark, sf_dir, "l_quantity"), _format(*fields)).select("id", "qty")


@query("date_bad", f"SELECT CASE WHEN event_id % 3 = 0 THEN 'no ' || event_type ELSE {_DAY} END AS id, count(*)::BIGINT AS logs FROM events GROUP BY 1")
def date_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that are no dates stay as they are."""
    token = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("no "), "event_type")).otherwise(_event_time())
    fmt = _format(_key("date", 0, "date", date_format="%Y-%m-%d %H:%M:%S", processing="day"))
    return summarize(lines_of_table(table(spark, sf_dir, "events"), [token]), fmt).select("id", "logs")


@query("time_bad", "SELECT CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%H:%M') ELSE strftime(ts, '%H') END AS id, count(*)::BIGINT AS logs FROM events GROUP BY 1")
def time_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens without three parts stay as they are."""
    token = F.when(F.col("event_id") % 3 == 0, _event_time("HH:mm")).otherwise(_event_time("HH:mm:ss"))
    return summarize(lines_of_table(table(spark, sf_dir, "events"), [token]), _format(_key("time", 0, "time", processing="hour"))).select("id", "logs")


@query("trimmed_text", "SELECT n_nationkey, n_name || ' x' AS trimmed FROM nation")
def trimmed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit(" \t\r"), "n_name", F.lit(" x\n \x0b\f"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.chomp(padded).alias("trimmed"))


@query("buffer_lines", "SELECT * FROM (VALUES ('a', CAST(5 AS BIGINT), CAST(2 AS BIGINT)), ('b', CAST(3 AS BIGINT), CAST(1 AS BIGINT))) t(id, total, logs)")
def buffer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in memory: a header, a comment, blank lines and a malformed one among them."""
    source = lines_from(spark, ["key|n", "a|1", "#a|9", "", "\t", "bad", "b|3", "a|4"], header=True, comment="#")
    return summarize(source, _format(_key("k", 0), _field("total", 1, "int", "sum"))).select("id", "total", "logs")


def _file_of_each(spark: SparkSession, sf_dir: str) -> str:
    """Nations and regions as text files in folders of their names."""
    folder = new_folder(spark, "files")
    for name, column in (("nation", "n_regionkey"), ("region", "r_regionkey")):
        table(spark, sf_dir, name).select(F.col(column).cast("string").alias("value")).coalesce(1).write.text(f"{folder}/{name}")
    return folder


@query("per_file_real", f"SELECT f AS file, CAST(k AS VARCHAR) AS id, count(*)::BIGINT AS logs FROM {_BOTH} GROUP BY 1, 2")
def per_file_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results per input file, told apart by the files' own paths."""
    folder = _file_of_each(spark, sf_dir)
    lines = read_lines(spark, [f"{folder}/nation", f"{folder}/region"])
    out = summarize(lines, _format(_key("k", 0)), by_file=True)
    return out.select(F.regexp_extract("_file", "/(nation|region)/[^/]*$", 1).alias("file"), "id", "logs")


_JOB_FORMAT = '{"format_name": "job", "delims": "|", "fields": [{"name": "k", "pos": 0, "type": "string", "key": true}]}'


@query(
    "job_snapshots",
    """SELECT CAST(1 AS BIGINT) AS files, CAST(n_regionkey AS VARCHAR) AS id, count(*)::VARCHAR AS logs FROM nation GROUP BY ALL
    UNION ALL SELECT 2, CAST(k AS VARCHAR), count(*)::VARCHAR FROM (SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) GROUP BY ALL""",
)
def job_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job by its options, with running totals after each file: the snapshot after one and the result after two."""
    folder, out = _file_of_each(spark, sf_dir), new_folder(spark, "snapshots")
    options = ["-fnames", f"{folder}/nation,{folder}/region", "-format_name", _JOB_FORMAT, "-output_format", "csv", "-ofname", f"{out}/all", "-merge_results", "-tmp_save", "-quiet"]
    job.run(spark, job.parse_options(options))
    read = lambda path, n: spark.read.option("header", True).csv(path).select(F.lit(n).cast("bigint").alias("files"), "id", "logs")
    return read(f"{out}/all-00001", 1).unionByName(read(f"{out}/all", 2))


@query("job_json", "SELECT CAST(k AS VARCHAR) AS id, count(*)::BIGINT AS logs FROM (SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) GROUP BY ALL")
def job_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's JSON files, read back."""
    folder, out = _file_of_each(spark, sf_dir), new_folder(spark, "job")
    options = ["-fnames", f"{folder}/nation,{folder}/region", "-format_name", _JOB_FORMAT, "-output_format", "json", "-ofname", out, "-merge_results", "-quiet"]
    job.run(spark, job.parse_options(options))
    return spark.read.schema("id string, logs long").json(out)


@query("top_text", "SELECT 'Number of keys: ' || count(DISTINCT user_id) AS line FROM events UNION ALL SELECT 'Number of logs: ' || count(*) FROM events UNION ALL SELECT lpad(CAST(logs AS VARCHAR), 12, ' ') || ' ' || id FROM (SELECT CAST(user_id AS VARCHAR) AS id, count(*) AS logs FROM events GROUP BY 1 ORDER BY logs DESC, id LIMIT 3)")
def top_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a job prints: totals and the top keys."""
    shown = print_top(summarize(_users(spark, sf_dir), _format(_key("user", 0))), 3)
    return spark.createDataFrame([(x,) for x in shown.splitlines()], "line string")


@query("http_bulk_load", "SELECT CAST(n_nationkey AS VARCHAR) AS id, CAST(0 AS BIGINT) AS failed FROM nation")
def http_bulk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents posted in bulk to an endpoint on the driver's host; what has arrived there."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    arrived: list[str] = []

    class Endpoint(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            arrived.extend(d["id"] for d in json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *args) -> None:
            pass

    host = spark.conf.get("spark.driver.host")
    server = ThreadingHTTPServer((host, 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        failed = post_lines(json_lines(_nations(spark, sf_dir)), f"http://{host}:{server.server_port}", batch=10).collect()[0]["failed"]
    finally:
        server.shutdown()
    return spark.createDataFrame([(i, failed) for i in arrived], "id string, failed long")


@query("words_in_order", f"SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS place FROM (SELECT word, count(*)::BIGINT AS n FROM {_WORDS} GROUP BY 1)")
def words_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole word count by falling number, then word."""
    return numbered(kernels.word_count(table(spark, sf_dir, "documents")), F.desc("n"), "word")


@query("words_by_name", f"SELECT word, n, row_number() OVER (ORDER BY word) - 1 AS place FROM (SELECT word, count(*)::BIGINT AS n FROM {_WORDS} GROUP BY 1)")
def words_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole word count in the order of the words."""
    return numbered(kernels.word_count(table(spark, sf_dir, "documents")), "word")


@query("summary_in_order", "SELECT id, logs, row_number() OVER (ORDER BY id) - 1 AS place FROM (SELECT CAST(o_custkey AS VARCHAR) AS id, count(*)::BIGINT AS logs FROM orders GROUP BY 1)")
def summary_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of_table(table(spark, sf_dir, "orders"), ["o_custkey"])
    return numbered(summarize(lines, _format(_key("customer", 0))).select("id", "logs"), "id")


@query("histogram_in_order", "SELECT channel, value, n, row_number() OVER (ORDER BY channel, value) - 1 AS place FROM (SELECT l_returnflag AS channel, CAST(l_quantity AS BIGINT) AS value, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2)")
def histogram_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kernel's output by key."""
    return numbered(histogram(spark, sf_dir), "channel", "value")


@query("dealt_rows", "SELECT CAST(o_custkey % 5 AS INT) AS part, count(*)::BIGINT AS rows, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def dealt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt to partitions by a rule of one's own; a partition is a group."""
    rows = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 5, F.col("o_custkey"))
    return rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"))


def _write_bytes(rows: DataFrame, folder: str, to_bytes: Callable) -> None:
    """A file per non-empty partition below ``folder``; ``to_bytes`` gets its integer columns as an array."""

    def run(batches):
        import uuid

        import numpy as np
        import pyarrow as pa

        parts = [np.stack([c.to_numpy() for c in b.columns], 1) for b in batches if b.num_rows]
        if parts:
            path = f"{folder}/{uuid.uuid4().hex}"
            fs, local = file_system(path)
            fs.create_dir(local.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(local, compression=None) as out:
                out.write(to_bytes(np.concatenate(parts)))
            yield pa.RecordBatch.from_pydict({"path": [path]})

    rows.mapInArrow(run, "path string").count()


def _bitmap(pixels) -> bytes:
    import struct

    import numpy as np

    head = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + pixels.size, 0, 0, 54, 40, len(pixels), 1, 1, 24, 0, pixels.size, 0, 0, 0, 0)
    return head + pixels.astype(np.uint8).tobytes()


@query(
    "bitmap_histogram",
    """SELECT k::BIGINT AS key, count(*)::BIGINT AS n FROM (SELECT unnest([1000 + p_size, 2000 + p_partkey % 256, 3000 + (p_partkey + p_size) % 256]) AS k FROM part) GROUP BY 1""",
)
def bitmap_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pixels of bitmap files: how often each value of each colour occurs, by numeric key."""
    folder = new_folder(spark, "bitmaps")
    pixels = table(spark, sf_dir, "part").select(F.col("p_size").cast("long"), F.col("p_partkey").cast("long") % 256, (F.col("p_partkey") + F.col("p_size")).cast("long") % 256)
    _write_bytes(pixels.repartition(3), folder, _bitmap)
    counts = read_bitmaps(spark, folder)
    return counts.groupBy(kernels.channel_key(F.col("channel"), F.col("value")).cast("bigint").alias("key")).agg(F.sum("n").alias("n"))


def _signed_bytes(pairs) -> bytes:
    import numpy as np

    return pairs.astype(np.int8).tobytes()


@query(
    "byte_pair_regression",
    """SELECT count(*)::BIGINT AS n, round(regr_intercept(y, x), 6) AS a, round(regr_slope(y, x), 6) AS b, round(regr_r2(y, x), 6) AS r2
    FROM (SELECT CAST(l_quantity AS BIGINT) - 25 AS x, l_linenumber * 3 - CAST(l_quantity AS BIGINT) AS y FROM lineitem)""",
)
def byte_pair_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as files of signed byte pairs, and a line through them."""
    folder = new_folder(spark, "pairs")
    x, y = F.col("l_quantity").cast("long") - 25, F.col("l_linenumber").cast("long") * 3 - F.col("l_quantity").cast("long")
    _write_bytes(table(spark, sf_dir, "lineitem").select(x.alias("x"), y.alias("y")).repartition(3), folder, _signed_bytes)
    r = kernels.linear_regression(read_points(spark, folder))
    return r.select("n", *(F.round(c, 6).alias(c) for c in ("a", "b", "r2")))


@query("grid_points", "SELECT i::BIGINT AS id, j::BIGINT AS j, (i * j % 100 + 1)::BIGINT AS v FROM range(500) a(i), range(3) b(j)")
def generated_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = grid_points(spark, 500, 3, 100).select("id", F.posexplode("point").alias("j", "v"))
    return points.select("id", F.col("j").cast("bigint").alias("j"), F.col("v").cast("bigint").alias("v"))


def kmeans_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows-only: the whole iteration has no SQL."""
    points = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("point"))
    _, assigned = kernels.kmeans(points, 4, order="vec_id")
    return assigned.select("vec_id", "cluster")


QUERIES["kmeans"] = kmeans_full


@query(
    "string_match",
    """SELECT t.target, count(w.word)::BIGINT AS n FROM (VALUES ('the'), ('of'), ('Licensed'), ('nosuchword')) t(target)
    LEFT JOIN (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents) w ON w.word = t.target GROUP BY 1""",
)
def string_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    return kernels.string_match(words, targets=("the", "of", "Licensed", "nosuchword"))


@query("shift_letters", "SELECT n_nationkey, list_reduce(list_transform(string_split(n_name, ''), lambda c: chr(ascii(c) + 5)), lambda a, b: a || b) AS shifted FROM nation")
def shift_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", text.shift_letters(F.col("n_name")).alias("shifted"))


@query(
    "stream_counts",
    """SELECT CAST(user_id AS VARCHAR) AS id, count(*)::BIGINT AS logs, round(sum(value), 4) AS total FROM events GROUP BY 1""",
)
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream of files, summarised by the streaming engine into a table of the driver (one row per user)."""
    import uuid

    folder = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(folder).schema).option("pathGlobFilter", "*.parquet")
    # A single-file table cannot be streamed by its own path: its folder and name do.
    source = events.option("pathGlobFilter", "events*.parquet").parquet(sf_dir) if _is_file(spark, folder) else events.parquet(folder)
    lines = lines_of_table(source, ["user_id", "value"], order=F.col("event_id"))
    name = f"stream_{uuid.uuid4().hex}"
    out = summarize_stream(lines, _format(_key("user", 0), _field("total", 1, "float", "sum"))).select("id", "logs", F.round("total", 4).alias("total"))
    start_to_table(out, name, new_folder(spark, "stream")).awaitTermination()
    return spark.table(name)


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


@query(
    "flagship_events",
    f"""WITH e AS (SELECT {_DAY} || '_' || lpad(CAST(hour(ts) // 6 * 6 AS VARCHAR), 2, '0') AS id, event_type, value FROM events),
    u AS (SELECT id, string_agg(event_type || ':' || CAST(c AS VARCHAR), ',' ORDER BY event_type) AS kinds FROM (SELECT id, event_type, count(*) AS c FROM e GROUP BY ALL) GROUP BY 1)
    SELECT id, count(*)::BIGINT AS logs, round(avg(value), 6) AS mean, round(max(value), 6) AS most, any_value(u.kinds) AS kinds,
    sum(CAST(contains(event_type, 'c') AS INT))::BIGINT AS with_c FROM e JOIN u USING (id) GROUP BY 1""",
)
def flagship_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as text lines, summarised by day and six hours: count, mean, maximum, kinds with counts, a conditional count."""
    lines = lines_of_table(table(spark, sf_dir, "events"), [_event_time("yyyy-MM-dd"), _event_time("HH:mm:ss"), "event_type", "value"], order=F.col("event_id"))
    fmt = _format(
        _key("date", 0, "date", date_format="%Y-%m-%d", processing="day"),
        _key("time", 1, "time", processing="hour", processing_offset=6),
        _field("kinds", 2, "string", "union_count"),
        _field("with_c", 2, "int", filter="c", filter_type="contain"),
        _field("mean", 3, "float", "mean"),
        _field("most", 3, "float", "max"),
    )
    out = summarize(lines, fmt)
    kinds = F.array_join(F.zip_with("kinds", "kinds_count", lambda k, c: F.concat(k, F.lit(":"), c.cast("string"))), ",")
    return out.select("id", "logs", F.round("mean", 6).alias("mean"), F.round("most", 6).alias("most"), kinds.alias("kinds"), "with_c")


