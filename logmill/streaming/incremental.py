"""The same summaries over streams: Spark keeps the aggregate state between increments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logmill.operators.summarize import aggregates, derive, group_columns, prepare
from logmill.plans.spec import LogFormat
from logmill.sinks.render import csv_frame


def summarize_stream(lines: DataFrame, fmt: LogFormat) -> DataFrame:
    """The summary as a streaming aggregation (``complete`` or ``update`` mode).

    Union counts collect a key's values here, since a stream has one aggregation;
    the first row of a key is the one with the least content, as arrival has no order.
    """
    grouped = prepare(lines, fmt).groupBy(*group_columns(fmt)).agg(*aggregates(fmt, streaming=True))
    return derive(grouped, fmt, streaming=True)


def windowed_counts(events: DataFrame, time: str, window: str, lateness: str, *keys: str) -> DataFrame:
    """Counts per tumbling window and keys; rows later than ``lateness`` are left out and finished windows forgotten."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("logs"))


def start_to_table(summary: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Run over what is there, into an in-memory table of the driver."""
    return summary.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_snapshots(summary: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write the running totals as CSV after every increment, each in a folder of its own."""

    def save(batch: DataFrame, number: int) -> None:
        csv_frame(batch).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(f"{folder}/{number:010d}")

    return summary.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
