"""Text functions as column expressions: tokenising, trimming, number parsing, key building."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _class(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)


def token_pattern(delims: str, quote: str = "") -> str:
    """Regular expression whose matches are the tokens of a line.

    Runs of delimiters separate once. A token that begins with the quote mark runs
    to a quote mark before a delimiter or the end; without one, to the end.
    """
    d = _class(delims)
    if not quote:
        return f"(?s)[^{d}]+"
    q = _class(quote[0])
    return f"(?s){q}(?=[{d}]|$)|{q}.*?{q}(?=[{d}]|$)|{q}.*|[^{d}]+"


def tokens(line: Column, delims: str, quote: str = "", keep_empty: bool = False) -> Column:
    """Array of a line's tokens, without double quotes."""
    if keep_empty:
        found = F.split(line, f"[{_class(delims)}]", -1)
    else:
        found = F.regexp_extract_all(line, F.lit(token_pattern(delims, quote)), F.lit(0))
    if quote and not keep_empty:  # a quoted field that is never closed ends before trailing delimiters
        found = F.transform(found, lambda t: F.regexp_replace(t, f"[{_class(delims)}]+$", ""))
    return F.transform(found, lambda t: F.replace(t, F.lit('"'), F.lit("")))


def split_simple(text: Column, delims: str) -> Column:
    """Pieces between runs of delimiters."""
    return F.filter(F.split(text, f"[{_class(delims)}]"), lambda x: x != "")


def chomp(text: Column) -> Column:
    """Without (ASCII) white space at the ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def words(text: Column) -> Column:
    """Maximal runs of ASCII letters, upper-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.upper(w))


def to_int(token: Column) -> Column:
    """Leading digits with a sign, else 0."""
    return F.coalesce(F.regexp_extract(token, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def to_float(token: Column) -> Column:
    """Leading number, else 0."""
    number = F.regexp_extract(token, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def fold_key(parts: Sequence[Column], appname: str = "") -> Column:
    """Join key parts with ``_``; while the key is still empty nothing goes before the next part.

    Plain concatenation, so it stays inside generated code: a separator appears once
    any earlier part has text.
    """
    pieces: list[Column] = []
    for k, part in enumerate(parts):
        if k:
            begun = reduce(lambda a, b: a | b, (p != "" for p in parts[:k]))
            pieces.append(F.when(begun, F.lit("_")).otherwise(F.lit("")))
        pieces.append(part)
    if appname:
        pieces.append(F.lit("_" + appname))
    return F.concat(*pieces) if pieces else F.lit("")


def shift_letters(text: Column, by: int = 5) -> Column:
    """Each character up to U+00FF moved ``by`` places on; others stay."""
    plain = [chr(i) for i in range(1, 256)]
    return F.translate(text, "".join(plain), "".join(chr(ord(c) + by) for c in plain))
