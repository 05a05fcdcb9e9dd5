"""Sources of log lines: files, streams, tables, and lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.functions.text import chomp

#: Columns of a line source: the line, the file it is from, its order.
LINE, FILE, ORDER = "line", "file", "_order"

#: A separator that no log holds, so that a line is one CSV field.
_NO_SEPARATOR = "\u0001"


def paths_of(names: str | Sequence[str]) -> list[str]:
    """A list of paths, also from one comma-separated string."""
    return [p for p in names.split(",") if p] if isinstance(names, str) else list(names)


def _options(header: bool, comment: str) -> dict[str, str]:
    out = {"header": str(header).lower(), "sep": _NO_SEPARATOR, "quote": "", "escape": "", "enforceSchema": "true", "lineSep": "\n", "maxCharsPerColumn": "-1"}
    return out | ({"comment": comment[0]} if comment else {})


def _clean(lines: DataFrame, *more: Column) -> DataFrame:
    line = F.regexp_replace(LINE, "\r$", "")
    return lines.select(line.alias(LINE), *more).where(chomp(F.col(LINE)) != "")


def read_lines(spark: SparkSession, paths: str | Sequence[str], header: bool = False, comment: str = "") -> DataFrame:
    """Lines of files (``line, file, _order``) without the header of each file, comments and blank lines.

    Without a header the plain text reader is used; files are split either way.
    """
    order = F.monotonically_increasing_id().alias(ORDER)
    file = F.col("_metadata.file_path").alias(FILE)
    if header:
        raw = spark.read.schema(f"{LINE} string").options(**_options(True, comment)).csv(paths_of(paths))
        return _clean(raw, file, order).where(F.col(LINE).isNotNull())
    raw = spark.read.text(paths_of(paths)).select(F.col("value").alias(LINE), "_metadata")
    return _not_comment(_clean(raw, file, order), comment)


def _not_comment(lines: DataFrame, comment: str) -> DataFrame:
    return lines.where(~F.startswith(LINE, F.lit(comment[0]))) if comment else lines


def stream_lines(spark: SparkSession, path: str, header: bool = False, comment: str = "", max_files: int | None = None) -> DataFrame:
    """The same as a stream over the files that arrive in a folder."""
    reader = spark.readStream.schema(f"{LINE} string").options(**_options(header, comment))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _clean(reader.csv(path).where(F.col(LINE).isNotNull()), F.col("_metadata.file_path").alias(FILE), F.lit(0).cast("long").alias(ORDER))


def lines_from(spark: SparkSession, lines: Sequence[str], file: str = "memory", header: bool = False, comment: str = "") -> DataFrame:
    """Lines in memory."""
    rows = [(x, file, i) for i, x in enumerate(lines[1:] if header else lines)]
    return _not_comment(_clean(spark.createDataFrame(rows, f"{LINE} string, {FILE} string, {ORDER} long"), F.col(FILE), F.col(ORDER)), comment)


def lines_of_table(df: DataFrame, columns: Sequence[str | Column], sep: str = "|", order: Column | None = None, file: Column | None = None) -> DataFrame:
    """A table as delimited lines, so that a format can summarise it."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    rank = order.cast("long") if order is not None else F.monotonically_increasing_id()
    return df.select(F.concat_ws(sep, *parts).alias(LINE), (file if file is not None else F.lit("table")).alias(FILE), rank.alias(ORDER))


def tokens_of_table(df: DataFrame, columns: Sequence[str | Column], order: Column | None = None) -> DataFrame:
    """A table whose columns stand for the tokens: no text is built or parsed."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    rank = order.cast("long") if order is not None else F.monotonically_increasing_id()
    return df.select(F.array(*parts).alias("tokens"), F.lit("table").alias(FILE), rank.alias(ORDER), F.lit(None).cast("string").alias(LINE))
