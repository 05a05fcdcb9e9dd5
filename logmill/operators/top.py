"""The most frequent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_keys(summary: DataFrame, n: int = 5) -> DataFrame:
    """``id, logs`` of the ``n`` keys with the most logs; ties by id."""
    return summary.select(F.col("_key").alias("id"), "logs").orderBy(F.desc("logs"), "id").limit(n)


def totals(summary: DataFrame) -> DataFrame:
    """One row: number of keys and of logs."""
    return summary.agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum("logs"), F.lit(0)).alias("n_logs"))
