"""Exploders: fields that unfold into a map of further fields. A registry, so more can be added.

An exploder takes the field's token and the tokens from its position on, and
returns a map of strings. Of equal names the last wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from logmill.functions.text import chomp, split_simple

Exploder = Callable[[Column, Column], Column]


def _to_map(pairs: Column) -> Column:
    """Map of (name, value) pairs; keeps the last of equal names whatever the session's policy is."""
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def _empty() -> Column:
    return F.create_map().cast("map<string,string>")


def key_equals_value(token: Column, tail: Column) -> Column:
    """``... -> first key = value key = value``: later keys are the last word before ``=``."""
    parts = split_simple(F.regexp_extract(token, "(?s)->(.*)", 1), "=")
    n = F.size(parts)
    last_word = lambda s: F.regexp_extract(F.rtrim(s), "([^ ]*)$", 1)

    def pair(value: Column, i: Column) -> Column:
        name = F.when(i == 0, chomp(F.get(parts, F.lit(0)))).otherwise(last_word(F.get(parts, i)))
        rest = F.when(i == n - 2, chomp(value)).otherwise(chomp(F.regexp_replace(F.rtrim(value), "[^ ]*$", "")))
        return F.struct(name.alias("k"), rest.alias("v"))

    pairs = F.transform(F.slice(parts, F.lit(2), F.greatest(n - 1, F.lit(0))), pair)
    return F.when(n < 2, _empty()).otherwise(_to_map(pairs))


def bracketed(token: Column, tail: Column) -> Column:
    """``[key: value]`` groups; further colons vanish from the value."""
    groups = F.filter(F.transform(split_simple(token, "["), lambda g: split_simple(g, ":")), lambda p: F.size(p) >= 2)

    def pair(p: Column) -> Column:
        value = F.concat(chomp(F.get(p, F.lit(1))), F.array_join(F.slice(p, F.lit(3), F.size(p)), ""))
        return F.struct(chomp(F.get(p, F.lit(0))).alias("k"), F.regexp_replace(value, r"\]$", "").alias("v"))

    return F.when(F.size(groups) == 0, _empty()).otherwise(_to_map(F.transform(groups, pair)))


def dns_labels(token: Column, tail: Column) -> Column:
    """``(3)www(6)google(3)com(0)`` from here on becomes ``target`` = ``www.google.com``."""
    text = chomp(F.array_join(tail, ""))
    labels = F.regexp_replace(F.regexp_extract(text, r"(?s)\(.*$", 0), r"^\([^)]*\)", "")
    name = F.regexp_replace(F.regexp_replace(labels, r"\([^)]*\)", "."), r"(?s).$", "")
    return F.when(F.contains(text, F.lit("(")), F.create_map(F.lit("target"), name)).otherwise(_empty())


EXPLODERS: dict[str, Exploder] = {"evtxcsv": key_equals_value, "evtxcsv2": bracketed, "microsoftdnslogs": dns_labels}


def register_exploder(name: str, exploder: Exploder) -> None:
    """Make an exploder available to formats as ``preprocessing``."""
    EXPLODERS[name] = exploder
