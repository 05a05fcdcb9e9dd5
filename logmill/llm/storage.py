"""Shared scratch storage.

Intermediate tables and files live below the folder that the session names in
``spark.checkpoint.dir``: every executor and the driver can reach it, so a lost
executor costs only the tasks it was running.  When the setting is absent a
temporary folder is used, but only on a local master.  What a step no longer needs
is discarded there; the rest goes when the driver's process ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logmill.sources.scratch import discard, file_system, new_folder, shared_root

__all__ = ["discard", "file_system", "forget", "fresh", "limit_batches", "materialize", "new_folder", "shared_root"]


def limit_batches(spark: SparkSession, size: str = "8m") -> None:
    """Let batches between the JVM and Python workers have ``size`` bytes at most.

    The default of 64 MB counts several times in an executor: on either side, per
    core, with what is made of it.  Workers cut batches further, so results do not
    depend on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared root and read it back.

    This cuts lineage: what follows re-reads files instead of recomputing, also
    after an executor is lost.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these tables; nothing may read them any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()[:1]}:
            discard(path)
