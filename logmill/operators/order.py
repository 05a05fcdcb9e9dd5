"""Whole results in order, and dealing rows out by a rule of one's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.sources.scratch import new_folder


def ordered(df: DataFrame, *keys: str | Column) -> DataFrame:
    """All rows sorted: Spark samples the keys, deals rows to ranges and sorts each (spilling where it must)."""
    return df.orderBy(*keys)


def numbered(df: DataFrame, *keys: str | Column, name: str = "place") -> DataFrame:
    """All rows in order with their place in it, from 0; equal keys are numbered in any order.

    Ranges are sorted and written once; a range's first place is the sum of the sizes
    of those before it, so no task sees more than its range.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, "ordered")
    at = F.monotonically_increasing_id()
    # The id holds the partition in its upper bits and the row's number in the lower 33.
    ordered(df, *keys).select("*", F.shiftright(at, 33).alias("_range"), at.bitwiseAND((1 << 33) - 1).alias("_at")).write.parquet(path)
    rows, first, starts = spark.read.parquet(path), 0, []
    for r in sorted(rows.groupBy("_range").count().collect()):
        starts.append((r[0], first))
        first += r[1]
    table = spark.createDataFrame(starts, "_range long, _first long")
    placed = rows.join(F.broadcast(table), "_range")  # a row per range
    return placed.select(*df.columns, (F.col("_first") + F.col("_at")).alias(name))


def dealt(df: DataFrame, parts: int, rule: Column) -> DataFrame:
    """Rows dealt to ``parts`` partitions by the remainder of ``rule``, an integer expression."""
    return df.repartitionById(parts, F.pmod(rule, F.lit(parts)).cast("int"))
