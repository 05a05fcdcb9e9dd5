"""A job: options, the summary they ask for, and its output."""

from __future__ import annotations

import argparse
import string
import subprocess
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.operators.summarize import grouped, prepare, summarize
from logmill.plans.spec import LogFormat, load_format
from logmill.sinks.write import OUTPUT_FORMATS, print_top, write_summary
from logmill.sources.text import FILE, ORDER, paths_of, read_lines


@dataclass(frozen=True)
class JobOptions:
    """What a job can be told. The last group only tunes Spark; results never depend on it."""

    fnames: str = ""
    format_name: str = ""
    ofname: str = ""
    output_format: str = "text"
    appname: str = ""
    ndisp: int = 5
    quiet: bool = False
    store_content: bool = False
    merge_results: bool = False
    skip_header: bool = False
    tmp_save: bool = False
    autosplit: bool = False
    compressed: bool = False
    nprocs: int = 0
    map_tasks: int = 0
    reduce_tasks: int = 0
    memory_factor: int = 10


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="logmill", description="Summarise logs as a format says.")
    for f in fields(JobOptions):
        if f.type == "bool":
            out.add_argument(f"-{f.name}", f"--{f.name}", action="store_true")
        else:
            out.add_argument(f"-{f.name}", f"--{f.name}", type=int if f.type == "int" else str, default=f.default)
    return out


def parse_options(args: Sequence[str] | None = None) -> JobOptions:
    return JobOptions(**vars(parser().parse_args(args)))


def tune(spark: SparkSession, options: JobOptions) -> None:
    """Hints for Spark.

    Reduce tasks are shuffle partitions; map tasks, or else cores, the least number of
    splits. ``autosplit`` lets a split have an executor's memory over ``memory_factor``
    at most. Contents are compressed by Spark's own codecs whatever ``compressed`` says.
    """
    if options.reduce_tasks > 0:
        spark.conf.set("spark.sql.shuffle.partitions", str(options.reduce_tasks))
    if (least := options.map_tasks or options.nprocs) > 0:
        spark.conf.set("spark.sql.files.minPartitionNum", str(least))
    if options.autosplit:
        memory = spark.sparkContext._conf.get("spark.executor.memory", "1g")
        unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}[memory[-1].lower()] if memory[-1].isalpha() else 1 << 20
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(1 << 20, int(memory.rstrip("kmgtKMGT")) * unit // max(1, options.memory_factor))))


def _format_of(options: JobOptions, fmt: LogFormat | None) -> LogFormat:
    fmt = fmt or load_format(options.format_name)
    return fmt.with_appname(options.appname) if options.appname else fmt


def summary_of(spark: SparkSession, options: JobOptions, fmt: LogFormat | None = None) -> DataFrame:
    """The job's result: per file by default, over all files if they are merged; always one Spark query."""
    if not options.fnames:
        raise ValueError("no input files")
    fmt = _format_of(options, fmt)
    lines = read_lines(spark, paths_of(options.fnames), options.skip_header, fmt.commentchar)
    out = summarize(lines, fmt, by_file=not options.merge_results, store_content=options.store_content)
    return out.drop("_file")


def run(spark: SparkSession, options: JobOptions, fmt: LogFormat | None = None) -> DataFrame:
    """Run a job; writes ``ofname`` unless the output is ``mem``, prints the top keys unless quiet, returns the summary."""
    if options.output_format != "mem" and not options.ofname:
        raise ValueError("ofname is needed unless output_format is mem")
    tune(spark, options)
    if options.tmp_save and options.merge_results and options.output_format == "csv":
        out = _save_increments(spark, options, _format_of(options, fmt))
    else:
        out = summary_of(spark, options, fmt)
    if not options.quiet:
        out = out.persist()  # the output, the totals and the top keys then come from one run over the input
    if options.output_format in OUTPUT_FORMATS and options.output_format != "mem":
        write_summary(out, options.ofname, options.output_format, "overwrite")
    if not options.quiet:
        print(print_top(out, options.ndisp))
    return out


def _save_increments(spark: SparkSession, options: JobOptions, fmt: LogFormat) -> DataFrame:
    """Write running totals after each input file but the last, in folders beside the output; returns the total.

    Every file is read and parsed once; a snapshot groups the parsed rows up to its file.
    """
    names = paths_of(options.fnames)
    sources = [read_lines(spark, name, options.skip_header, fmt.commentchar) for name in names]
    marked = [s.withColumn(FILE, F.lit(f"{n:05d}")).withColumn(ORDER, F.lit(n << 52) + F.col(ORDER)) for n, s in enumerate(sources, 1)]
    rows = prepare(reduce(DataFrame.unionByName, marked), fmt).persist()
    for n in range(1, len(names)):
        write_summary(grouped(rows.where(F.col(FILE) <= f"{n:05d}"), fmt), f"{options.ofname}-{n:05d}", "csv", "overwrite")
    return grouped(rows, fmt, store_content=options.store_content)


def launch(template: str, values: Mapping[str, str], timeout: float | None = None) -> int:
    """Fill ``$names`` in a command template, run it without a shell, and return its exit code."""
    import shlex

    command = [string.Template(part).substitute(values) for part in shlex.split(template)]
    return subprocess.run(command, timeout=timeout, check=False).returncode
