"""Command line: ``python -m logmill -fnames a.log,b.log -format_name format.json -output_format json -ofname out``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from logmill.plans.job import parse_options, run


def main(args: list[str] | None = None) -> int:
    options = parse_options(args)
    builder = SparkSession.builder.appName("logmill").config("spark.sql.session.timeZone", "UTC")
    if options.nprocs > 0:
        builder = builder.master(f"local[{options.nprocs}]")
    try:
        run(builder.getOrCreate(), options)
    except ValueError as e:
        print(f"logmill: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
