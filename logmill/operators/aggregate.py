"""Aggregations of a format as built-in aggregate columns. A registry maps their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from logmill.plans.spec import AGGREGATIONS, FieldSpec

Aggregator = Callable[[Column, FieldSpec], Column]


def _sum(x: Column, f: FieldSpec) -> Column:
    return F.sum(x)


def _max(x: Column, f: FieldSpec) -> Column:
    return F.max(x)


def _mean(x: Column, f: FieldSpec) -> Column:
    return F.avg(x)


def _variance(x: Column, f: FieldSpec) -> Column:
    """Sample variance; 0 for one value."""
    return F.when(F.count(x) > 0, F.coalesce(F.var_samp(x), F.lit(0.0)))


def _count(x: Column, f: FieldSpec) -> Column:
    return F.count(x)


def _union(x: Column, f: FieldSpec) -> Column:
    """Distinct texts, or all numbers, in ascending order."""
    return F.sort_array(F.collect_set(x) if f.is_text else F.collect_list(x))


AGGREGATORS: dict[str, Aggregator] = {"sum": _sum, "max": _max, "mean": _mean, "variance": _variance, "count": _count, "union": _union}


def register_aggregation(name: str, aggregator: Aggregator) -> None:
    """Make an aggregation available to formats under ``name``."""
    AGGREGATORS[name] = aggregator
    AGGREGATIONS.add(name)


def single_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient in single precision; 0 where an operand is missing or the denominator is 0."""
    quotient = F.try_divide(numerator.cast("float"), denominator.cast("float")).cast("float").cast("double")
    return F.coalesce(F.when(denominator != 0, quotient), F.lit(0.0))
