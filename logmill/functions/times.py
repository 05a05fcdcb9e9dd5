"""Date and time bucketing with the format language's renderings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logmill.functions.text import chomp, to_int

#: Strptime directive -> (Spark pattern, regular expression).
DIRECTIVES = {
    "%Y": ("y", r"[0-9]{1,4}"),
    "%y": ("yy", r"[0-9]{2}"),
    "%m": ("M", r"[0-9]{1,2}"),
    "%d": ("d", r"[0-9]{1,2}"),
    "%e": ("d", r"[0-9]{1,2}"),
    "%b": ("MMM", r"[A-Za-z]{3}"),
    "%H": ("H", r"[0-9]{1,2}"),
    "%I": ("h", r"[0-9]{1,2}"),
    "%p": ("a", r"[AaPp][Mm]"),
    "%M": ("m", r"[0-9]{1,2}"),
    "%S": ("s", r"[0-9]{1,2}"),
}
SHORTHANDS = {"%T": "%H:%M:%S", "%R": "%H:%M", "%D": "%m/%d/%y", "%F": "%Y-%m-%d", "%h": "%b"}


def translate_format(fmt: str) -> tuple[str, str]:
    """``(Spark pattern, regular expression of a matching prefix)`` of a strptime format."""
    for short, full in SHORTHANDS.items():
        fmt = fmt.replace(short, full)
    pattern, regex = "", "^"
    parts = re.findall(r"%.|[^%]+|%", fmt)
    for k, part in enumerate(parts):
        if part in DIRECTIVES:
            letters, digits = DIRECTIVES[part]
            # Numbers with nothing between them have their full width.
            if digits.startswith("[0-9]") and any(DIRECTIVES.get(p, ("", ""))[1].startswith("[0-9]") for p in (*parts[max(0, k - 1) : k], *parts[k + 1 : k + 2])):
                width = 4 if part == "%Y" else 2
                letters, digits = letters[0] * width, f"[0-9]{{{width}}}"
            pattern, regex = pattern + letters, regex + digits
        elif part.startswith("%") and part != "%%":
            raise ValueError(f"date format {fmt!r}: {part} is not supported")
        else:
            text = part.replace("%%", "%")
            pattern += "'" + text.replace("'", "''") + "'"
            regex += re.sub(r"([^A-Za-z0-9 ])", r"\\\1", text)
    return pattern, regex


#: Three parts between runs of colons.
_CLOCK = r"^:*([^:]+):+([^:]+):+([^:]+):*$"


def parse_date(token: Column, fmt: str) -> Column:
    """Timestamp of a token, or null; text after the date is ignored; ``unix`` is seconds since 1970 (UTC)."""
    if fmt == "unix":
        seconds = F.regexp_extract(token, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")
        return F.timestamp_seconds(seconds)
    pattern, regex = translate_format(fmt)
    return F.try_to_timestamp(F.regexp_extract(token, regex, 0), F.lit(pattern))


def _floor(value: Column, width: int) -> Column:
    return F.floor(value / width).cast("int") * width if width > 1 else value.cast("int")


def _two(value: Column) -> Column:
    return F.when(value < 10, F.concat(F.lit("0"), value.cast("string"))).otherwise(value.cast("string"))


def bucket_timestamp(ts: Column, processing: str, width: int = 1) -> Column:
    """Render a timestamp by its bucket: months, days and hours are not padded."""
    if processing == "day":
        return F.date_format(ts, "y-M-d")
    if processing == "month":
        return F.date_format(ts, "y-M")
    if processing == "year":
        return F.date_format(ts, "y")
    if processing == "hour":
        return F.concat(F.date_format(ts, "y-M-d'T'H"), F.lit(":00:00"))
    if processing == "minute":
        return F.concat(F.date_format(ts, "y-M-d'T'H:"), _two(_floor(F.minute(ts), width)), F.lit(":00"))
    return F.date_format(ts, "y-M-d'T'H:m:s")


def bucket_date(token: Column, processing: str, fmt: str, width: int = 1) -> Column:
    """Bucket of a date token; a token that is no date, or without processing, stays."""
    if not processing:
        return token
    return F.coalesce(bucket_timestamp(parse_date(token, fmt), processing, width), token)


def bucket_time(token: Column, processing: str, width: int = 1) -> Column:
    """Bucket of an ``H:M:S`` token; other tokens stay."""
    token = chomp(token)
    part = [F.regexp_extract(token, _CLOCK, k) for k in (1, 2, 3)]  # empty unless there are three parts
    if processing == "hour":
        out = _two(_floor(to_int(part[0]), width))
    elif processing == "minute":
        out = F.concat(part[0], F.lit(":"), _two(_floor(to_int(part[1]), width)))
    else:
        out = F.concat(part[0], F.lit(":"), part[1], F.lit(":"), _two(_floor(to_int(part[2]), width)))
    return F.when(part[0] != "", out).otherwise(token)
