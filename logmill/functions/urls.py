"""URL templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill_url(url: Column, template: str) -> Column:
    """Fill ``%scheme %host %port %path %query %fragment``; text without a scheme stays.

    The port is filled, with its colon, only where the URL names one.
    """
    part = lambda name: F.coalesce(F.try_parse_url(url, F.lit(name)), F.lit(""))
    values = (
        ("%scheme", part("PROTOCOL")),
        ("%host", part("HOST")),
        ("%port", F.regexp_extract(part("AUTHORITY"), r"(:[0-9]+)$", 1)),
        ("%path", part("PATH")),
        ("%query", part("QUERY")),
        ("%fragment", part("REF")),
    )
    out = F.lit(template)
    for name, value in values:
        if name in template:
            out = F.replace(out, F.lit(name), value)
    usable = (~F.contains(url, F.lit("://["))) & (part("PROTOCOL") != "")
    return F.when(usable, out).otherwise(url)
