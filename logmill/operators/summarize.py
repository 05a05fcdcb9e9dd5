"""The summarisation query: tokenise, filter, project, group once, derive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from logmill.functions.exploders import EXPLODERS
from logmill.functions.text import chomp, fold_key, to_float, to_int, tokens
from logmill.functions.times import bucket_date, bucket_time
from logmill.functions.urls import fill_url
from logmill.operators.aggregate import AGGREGATORS, single_ratio
from logmill.operators.match import apply_matches
from logmill.plans.spec import FieldSpec, LogFormat, SpecError
from logmill.sources.text import FILE, LINE, ORDER


def tokenize(lines: DataFrame, fmt: LogFormat) -> DataFrame:
    """Add ``tokens`` and drop lines with too few of them (``malformed`` has those).

    Unfolding a list of none or one keeps the check above the tokenising: a filter
    would be pushed below it and tokenise every line once more.
    """
    if "tokens" in lines.columns:
        return lines.where(F.size("tokens") > fmt.max_pos)
    found = F.array(tokens(F.col(LINE), fmt.delims, fmt.quotechar, fmt.keep_empty))
    return lines.withColumn("tokens", F.explode(F.filter(found, lambda t: F.size(t) > fmt.max_pos)))


def observed(lines: DataFrame, fmt: LogFormat, observation: Observation) -> DataFrame:
    """The same lines; ``observation`` then tells ``lines`` and ``malformed`` of the query that reads them."""
    short = F.size(tokens(F.col(LINE), fmt.delims, fmt.quotechar, fmt.keep_empty)) <= fmt.max_pos
    return lines.observe(observation, F.count(F.lit(1)).alias("lines"), F.count_if(short).alias("malformed"))


def malformed(lines: DataFrame, fmt: LogFormat) -> DataFrame:
    """The lines that ``tokenize`` drops."""
    return lines.where(F.size(tokens(F.col(LINE), fmt.delims, fmt.quotechar, fmt.keep_empty)) <= fmt.max_pos)


def processed_token(f: FieldSpec) -> Column:
    """The field's token after date, time and URL processing."""
    token = F.get(F.col("tokens"), F.lit(f.pos))
    if f.type == "date" or f.processing in ("day", "month", "year"):
        token = bucket_date(token, f.processing, f.date_format, f.processing_offset)
    elif f.processing:
        token = bucket_time(token, f.processing, f.processing_offset)
    elif f.type == "url":
        token = fill_url(token, f.url_format)
    return chomp(token) if f.is_text else token


def value_of(f: FieldSpec, token: Column) -> Column:
    """The typed value; empty texts are missing."""
    if f.type == "int":
        return to_int(token)
    if f.type == "float":
        return to_float(token)
    if f.type == "bool":
        return to_int(token) != 0
    return F.nullif(token, F.lit(""))


def _visible(f: FieldSpec) -> bool:
    return not f.preprocessing


def project(rows: DataFrame, fmt: LogFormat) -> DataFrame:
    """``key``, a column ``f<i>`` per field, ``extra`` (exploded fields) and the source's columns."""
    texts = rows.select("*", *(processed_token(f).alias(f"t{i}") for i, f in enumerate(fmt.fields) if not (f.is_ratio and f.type == "")))
    columns, extra = [], []
    for i, f in enumerate(fmt.fields):
        if f.is_contain:
            columns.append(_contain(fmt, f).alias(f"f{i}"))
        else:
            columns.append(value_of(f, F.col(f"t{i}")).alias(f"f{i}"))
        if f.preprocessing:
            if f.preprocessing not in EXPLODERS:
                raise SpecError(f"{f.name}: unknown preprocessing {f.preprocessing!r}")
            tail = F.slice("tokens", f.pos + 1, F.size("tokens"))
            extra.append(EXPLODERS[f.preprocessing](F.col(f"t{i}"), tail))
    key = fold_key([F.coalesce(F.col(f"t{i}"), F.lit("")) for i, f in enumerate(fmt.fields) if f.key and not f.is_contain], fmt.appname)
    if len(extra) > 1:
        names = F.array_distinct(F.flatten(F.array(*(F.map_keys(m) for m in extra))))
        merged = F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.coalesce(*(F.element_at(m, k) for m in reversed(extra))))))
    else:
        merged = extra[0] if extra else F.lit(None).cast("map<string,string>")
    return texts.select(key.alias("key"), *columns, merged.alias("extra"), LINE, FILE, ORDER)


def _contain(fmt: LogFormat, f: FieldSpec) -> Column:
    """1 if the first text field at the same position contains the filter's text, else 0."""
    for j, g in enumerate(fmt.fields):
        if g is not f and g.pos == f.pos and not g.filter:
            if g.type != "string":
                return F.lit(0).cast("bigint")
            return F.coalesce(F.contains(F.nullif(F.col(f"t{j}"), F.lit("")), F.lit(f.filter)).cast("bigint"), F.lit(0).cast("bigint"))
    return F.lit(0).cast("bigint")


def _ratio_inputs(fmt: LogFormat) -> dict[str, int]:
    """Fields whose sum a ratio needs, by name."""
    names = {n for f in fmt.fields if f.is_ratio for n in (f.numerator, f.denominator)} - {"logs"}
    return {f.name: i for i, f in enumerate(fmt.fields) if f.name in names}


def group_columns(fmt: LogFormat, by_file: bool = False) -> list[Column]:
    key = F.col("key")
    return [(F.collate(key, "UTF8_LCASE") if fmt.ignore_case else key).alias("_group"), *([F.col(FILE)] if by_file else [])]


def aggregates(fmt: LogFormat, store_content: bool = False, streaming: bool = False) -> list[Column]:
    """The aggregate columns of one group-by; union counts are apart unless the source is a stream."""
    out = [F.count(F.lit(1)).alias("logs")]
    first = [F.col("key"), F.col("extra")]
    for i, f in enumerate(fmt.fields):
        x = F.col(f"f{i}")
        if f.is_contain:
            out.append(F.sum(x).alias(f"a{i}"))
        elif not f.aggregated or f.key:
            first.append(x)
        elif f.aggregation == "union_count":
            if streaming:
                out.append(F.collect_list(x).alias(f"l{i}"))
        elif f.aggregation != "ratio":
            out.append(AGGREGATORS[f.aggregation](x, f).alias(f"a{i}"))
    out += [F.sum(f"f{i}").alias(f"s{i}") for i in _ratio_inputs(fmt).values() if fmt.fields[i].type in ("int", "float") and not fmt.fields[i].is_ratio]
    # What no aggregation combines is the first row's, by order in the source.
    # A stream has no such order: there it is the least row.
    rank = F.struct(*(c for i, c in enumerate(first) if i != 1)) if streaming else F.col(ORDER)
    out.append(F.min_by(F.struct(*first), rank).alias("_first"))
    if store_content:
        lines = F.transform(F.sort_array(F.collect_list(F.struct(ORDER, LINE))), lambda s: s[LINE])
        out.append(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("content"))
    return out


def union_count_fields(fmt: LogFormat) -> list[int]:
    return [i for i, f in enumerate(fmt.fields) if f.aggregated and f.aggregation == "union_count" and not f.key]


def _group_with_counts(rows: DataFrame, fmt: LogFormat, by_file: bool, plain: list[Column]) -> DataFrame:
    """Group once over the source where values are counted as well.

    Each row unfolds into itself and its values; a first grouping by key and value
    does all plain aggregates and the counts, a second brings a key's rows together.
    So lines are parsed once, and no key gathers more than its distinct values.
    """
    which = union_count_fields(fmt)
    names = ["_group", *([FILE] if by_file else [])]
    slots = [F.struct(F.lit(-1).alias("i"), F.lit(None).cast("string").alias("v")), *(F.struct(F.lit(i).alias("i"), F.col(f"f{i}").cast("string").alias("v")) for i in which)]
    wide = rows.select(*group_columns(fmt, by_file), *(c for c in rows.columns if c != FILE), F.explode(F.array(*slots)).alias("_x")).where("_x.i < 0 or _x.v is not null")
    own = F.col("_x.i") < 0
    # Plain aggregates see the row itself only.
    hidden = wide.select(*names, "_x", *(F.when(own, F.col(c)).alias(c) for c in rows.columns if c != FILE))
    first = hidden.groupBy(*names, F.col("_x.i").alias("i"), F.col("_x.v").alias("v")).agg(*plain)
    pairs = lambda i: F.sort_array(F.collect_list(F.when(F.col("i") == i, F.struct("v", F.col("logs").alias("c"))))).alias(f"l{i}")
    others = [c for c in first.columns if c not in (*names, "i", "v")]
    return first.groupBy(*names).agg(*(F.first(F.when(F.col("i") < 0, F.col(c)), ignorenulls=True).alias(c) for c in others), *(pairs(i) for i in which))


def _pairs_of(values: Column) -> Column:
    """(value, count) pairs of a list of values, from one sort of it."""
    ordered = F.sort_array(values)
    edges = F.filter(F.sequence(F.lit(0), F.size(values)), lambda i: (i == 0) | (i == F.size(values)) | (F.get(ordered, i) != F.get(ordered, i - 1)))
    pairs = F.transform(F.slice(edges, F.lit(1), F.size(edges) - 1), lambda i, k: F.struct(F.get(ordered, i).alias("v"), (F.get(edges, k + 1) - i).cast("bigint").alias("c")))
    return F.when(F.size(values) > 0, pairs).otherwise(F.slice(pairs, F.lit(1), F.lit(0)))


def derive(grouped: DataFrame, fmt: LogFormat, by_file: bool = False, streaming: bool = False) -> DataFrame:
    """Final columns: id, the fields (and counts of union counts), extra, appname, logs, format_name, std_date_dt, _key.

    Of equal names the later one in this order stays, so a field named ``id``
    replaces the key there; ``_key`` always has it.
    """
    value: dict[int, Column] = {}
    # Without folding letter case the group is the key; then nothing need be remembered of first rows.
    key = F.col("_first.key") if fmt.ignore_case else F.col("_group")
    out: dict[str, Column] = {"id": key}
    sums = _ratio_inputs(fmt)

    def operand(name: str) -> Column:
        if name == "logs":
            return F.col("logs")
        i = sums.get(name)
        if i is None or fmt.fields[i].type not in ("int", "float") or fmt.fields[i].is_ratio:
            return F.lit(None).cast("double")
        return F.col(f"s{i}")

    for i, f in enumerate(fmt.fields):
        if f.is_ratio:
            column = single_ratio(operand(f.numerator), operand(f.denominator))
        elif f.is_contain or (f.aggregated and not f.key and f.aggregation != "union_count"):
            column = F.col(f"a{i}")
        elif f.aggregated and not f.key:
            pairs = _pairs_of(F.col(f"l{i}")) if streaming else F.col(f"l{i}")
            column = F.transform(pairs, lambda p: p["v"])
            if _visible(f):
                out[f"{f.name}_count"] = F.transform(pairs, lambda p: p["c"])
        else:
            column = F.col(f"_first.f{i}")
        value[i] = column
        if _visible(f):
            out[f.name] = column
    if any(f.preprocessing for f in fmt.fields):
        out["extra"] = F.col("_first.extra")
    if fmt.appname:
        out["appname"] = F.lit(fmt.appname)
    out |= {"logs": F.col("logs"), "format_name": F.lit(fmt.format_name), "std_date_dt": standard_date(fmt, value), "_key": key}
    out |= {f"_{c}": F.col(c) for c in (FILE, "content") if c in grouped.columns and (c != FILE or by_file)}
    return grouped.select(*(c.alias(n) for n, c in out.items()))


def standard_date(fmt: LogFormat, value: dict[int, Column]) -> Column:
    """Last date and last time of the record; a date with a time of its own stands alone."""

    def one(i: int) -> Column:
        f = fmt.fields[i]
        if f.aggregated and not f.key and f.aggregation in ("union", "union_count"):
            return F.when(F.size(value[i]) == 1, F.get(value[i], F.lit(0)))
        return value[i].cast("string")

    usable = [i for i, f in enumerate(fmt.fields) if _visible(f) and not f.is_contain and not f.is_ratio]
    dates = [one(i) for i in usable if fmt.fields[i].type == "date"]
    tails = {"hour": ":00:00", "minute": ":00"}
    times = [F.concat(one(i), F.lit(tails.get(fmt.fields[i].processing, ""))) for i in usable if fmt.fields[i].type == "time"]
    date = F.coalesce(*reversed(dates), F.lit("0000-00-00"))
    time = F.coalesce(*reversed(times), F.lit("00:00:00"))
    return F.when(F.contains(date, F.lit("T")), F.concat(date, F.lit("Z"))).otherwise(F.concat(date, F.lit("T"), time, F.lit("Z")))


def prepare(lines: DataFrame, fmt: LogFormat) -> DataFrame:
    """Parsed rows of a line source, before grouping."""
    return project(apply_matches(tokenize(lines, fmt), fmt), fmt)


def summarize(lines: DataFrame, fmt: LogFormat, by_file: bool = False, store_content: bool = False) -> DataFrame:
    """The whole query over a batch source, a row per key (and file)."""
    return grouped(prepare(lines, fmt), fmt, by_file, store_content)


def grouped(rows: DataFrame, fmt: LogFormat, by_file: bool = False, store_content: bool = False) -> DataFrame:
    """The summary of rows that ``prepare`` has parsed."""
    plain = aggregates(fmt, store_content)
    if union_count_fields(fmt):
        return derive(_group_with_counts(rows, fmt, by_file, plain), fmt, by_file)
    return derive(rows.groupBy(*group_columns(fmt, by_file)).agg(*plain), fmt, by_file)
