"""A corpus pipeline of the training-data operators; every stage works on what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``docs``; the last
returns a row per packed piece. Stages limit the size of Arrow batches in the session.
``run`` writes each stage's result below the shared folder and reads it back, as a
production job would.

Nulls, ties and odd tables, in every stage: a null text has no words, so the quality
rules reject it; a null ``doc_id`` is an id like any other to rules, decontamination
and packing, sorts first in line dedup, and never names a group in near dedup. Rows
equal in id and text share their outcome; one of equal texts with different ids stays,
that of the least id. An empty table of documents gives no rows, an empty benchmark
removes nothing, and without labels of both kinds only the base rules reject. Other
columns pass through unread, whatever their names. A text of any length is handled
whole by the task that reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.llm import decontaminate, lines, near_dup, packing, rules
from logmill.llm.storage import forget, limit_batches, materialize
from logmill.llm.tokenize import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    limit_batches(spark)
    return rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; ``n_chars`` follows the text."""
    limit_batches(spark)
    kept = lines.remove_repeated_windows(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (similarity 0.8 or more) stays."""
    limit_batches(spark)
    return near_dup.keep_one(docs, threshold=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain any window of a benchmark item go."""
    limit_batches(spark)
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens; a row per piece."""
    limit_batches(spark)
    pieces = packing.token_pieces(docs, tokenizer_path("word_bpe_49k.json"), 4096)
    return packing.pack(pieces, 4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the learned rules, the near-duplicate search and the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name.replace(' ', '-')}")
            if number:
                forget(before)
    return docs
