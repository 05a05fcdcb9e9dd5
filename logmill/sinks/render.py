"""Renderings of a summary: JSON records, CSV with a fixed schema, text lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

#: Columns that are not part of a record: the group key, the source file, the stored lines.
APART = ("_key", "_file", "_content")


def _quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def json_value(column: Column) -> Column:
    """JSON text of one value of any type."""
    text = F.to_json(F.array(column))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _member(name: str, column: Column) -> Column:
    head = json_value(F.lit(name))
    return F.when(column.isNotNull(), F.concat(head, F.lit(":"), json_value(column)))


def record_json(df: DataFrame) -> Column:
    """One object per row: names in order, missing values left out, lists of one as their element, ``extra`` unfolded."""
    members = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        if f.name in APART:
            continue
        c = _quoted(f.name)
        if isinstance(f.dataType, ArrayType):
            head = json_value(F.lit(f.name))
            body = F.when(F.size(c) == 1, json_value(F.get(c, F.lit(0)))).when(F.size(c) > 1, F.to_json(c))
            members.append(F.when(body.isNotNull(), F.concat(head, F.lit(":"), body)))
        elif isinstance(f.dataType, MapType):
            inner = F.to_json(c)
            members.append(F.when(F.size(c) > 0, F.substring(inner, F.lit(2), F.length(inner) - 2)))
        else:
            members.append(_member(f.name, c))
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def json_lines(summary: DataFrame) -> DataFrame:
    """``value``: a JSON record per key and, where lines are stored, one with their content."""
    out = summary.select(record_json(summary).alias("value"))
    if "_content" not in summary.columns:
        return out
    parts = F.struct(
        F.concat("_key", F.lit("_content")).alias("id"),
        F.struct(F.col("_content").alias("add")).alias("content"),
        F.octet_length("_content").alias("original_size"),
    )
    return out.unionByName(summary.where(F.col("_content").isNotNull()).select(F.to_json(parts).alias("value")))


def csv_frame(summary: DataFrame) -> DataFrame:
    """Flat columns in alphabetical order; lists become ``[a,b]``, maps and structs JSON."""
    columns: Iterable[Column] = []
    for f in sorted(summary.schema.fields, key=lambda f: f.name):
        if f.name in APART:
            continue
        c = _quoted(f.name)
        if isinstance(f.dataType, ArrayType):
            c = F.when(F.size(c) == 1, F.get(c, F.lit(0)).cast("string")).when(F.size(c) > 1, F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ","), F.lit("]")))
        elif isinstance(f.dataType, (MapType, StructType)):
            c = F.to_json(c)
        columns = [*columns, c.alias(f.name)]
    return summary.select(*columns)


def text_lines(summary: DataFrame) -> DataFrame:
    """``value``: ``key - count``."""
    return summary.select(F.concat("_key", F.lit(" - "), F.col("logs").cast("string")).alias("value"))
