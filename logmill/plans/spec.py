"""The format language: what a JSON log format may say, checked and resolved once."""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

TYPES = ("int", "float", "string", "date", "time", "url", "bool")
#: Names that a format may use; registering an aggregation adds one.
AGGREGATIONS = {"sum", "max", "mean", "variance", "count", "union", "union_count", "ratio"}
PROCESSINGS = ("day", "month", "year", "hour", "minute", "second")


class SpecError(ValueError):
    """A format that cannot be run."""


@dataclass(frozen=True)
class MatchSpec:
    """Which rows a field lets through: by one string or the words of a file."""

    match_str: str = ""
    match_file: str = ""
    logic: str = "or"
    negative: bool = False
    exact: bool = False


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str
    pos: int = -1
    key: bool = False
    aggregated: bool = False
    aggregation: str = ""
    processing: str = ""
    processing_offset: int = 1
    date_format: str = "%m/%d/%Y"
    preprocessing: str = ""
    filter: str = ""
    filter_type: str = ""
    url_format: str = "%scheme://%host%port"
    match: MatchSpec | None = None
    numerator: str = ""
    denominator: str = ""

    @property
    def is_contain(self) -> bool:
        return self.filter_type == "contain"

    @property
    def is_ratio(self) -> bool:
        return self.aggregated and self.aggregation == "ratio"

    @property
    def is_text(self) -> bool:
        return self.type in ("string", "date", "time", "url")


@dataclass(frozen=True)
class LogFormat:
    format_name: str
    delims: str
    fields: tuple[FieldSpec, ...] = field(default_factory=tuple)
    appname: str = ""
    quotechar: str = ""
    commentchar: str = ""
    #: Ours: keep empty fields between delimiters instead of collapsing runs of them.
    keep_empty: bool = False
    #: Ours: group keys that differ in letter case only.
    ignore_case: bool = False

    @property
    def max_pos(self) -> int:
        return max((f.pos for f in self.fields), default=-1)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def with_appname(self, appname: str) -> "LogFormat":
        return LogFormat(**{**{f.name: getattr(self, f.name) for f in fields(self)}, "appname": appname})


def _coerce(kind: str, value: Any, where: str) -> Any:
    """JSON values become the declared type, so ``"pos": "8"`` works."""
    try:
        if kind == "int":
            return int(value)
        if kind == "bool":
            return value.strip().lower() in ("true", "1", "yes") if isinstance(value, str) else bool(value)
        return str(value)
    except (TypeError, ValueError) as e:
        raise SpecError(f"{where}: cannot read {value!r} as {kind}") from e


def _build(cls: type, raw: Mapping[str, Any], where: str, special: tuple[str, ...] = ()) -> dict[str, Any]:
    known = {f.name: str(f.type) for f in fields(cls)}
    out = {}
    for k, v in raw.items():
        if k not in known:
            warnings.warn(f"{where}: unknown entry {k!r} is ignored", stacklevel=4)
        elif k not in special:
            out[k] = _coerce(known[k], v, f"{where}.{k}")
    return out


def load_format(source: str | Path | Mapping[str, Any]) -> LogFormat:
    """Read a format from a mapping, a JSON text or the path of a JSON file (a trailing comma is forgiven)."""
    if isinstance(source, Mapping):
        raw: Mapping[str, Any] = source
    else:
        text = source if isinstance(source, str) and source.lstrip().startswith("{") else Path(source).read_text()
        raw = _parse(text)
    if "delims" not in raw or not raw["delims"]:
        raise SpecError("a format needs delims")
    specs = []
    for i, f in enumerate(raw.get("fields", [])):
        where = f"fields[{i}]"
        if "name" not in f or "type" not in f:
            raise SpecError(f"{where}: name and type are required")
        parts = _build(FieldSpec, f, where, ("match",))
        if f.get("match") is not None:
            parts["match"] = MatchSpec(**_build(MatchSpec, f["match"], f"{where}.match"))
        specs.append(FieldSpec(**parts))
    return LogFormat(**_build(LogFormat, raw, "format", ("fields",)), fields=_resolve(specs))


def _parse(text: str) -> Mapping[str, Any]:
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        import re

        return json.loads(re.sub(r",(\s*[}\]])", r"\1", text))


def _resolve(specs: list[FieldSpec]) -> tuple[FieldSpec, ...]:
    """Check fields and number those without a position.

    The counter is its own: only fields without a position advance it, and ratio
    fields with a position set it.
    """
    at, out, mixed = -1, [], {s.pos == -1 for s in specs if not s.is_ratio}
    if len(mixed) > 1:
        warnings.warn("explicit positions do not advance automatic ones", stacklevel=4)
    names: set[str] = set()
    for s in specs:
        if s.type not in TYPES:
            raise SpecError(f"{s.name}: unknown type {s.type!r}")
        if s.aggregated and s.aggregation not in AGGREGATIONS:
            raise SpecError(f"{s.name}: unknown aggregation {s.aggregation!r}")
        if s.processing and s.processing not in PROCESSINGS:
            raise SpecError(f"{s.name}: unknown processing {s.processing!r}")
        if s.processing_offset < 1:
            raise SpecError(f"{s.name}: processing_offset must be 1 or more")
        if s.match and s.match.logic not in ("and", "or"):
            raise SpecError(f"{s.name}: unknown match logic {s.match.logic!r}")
        if s.is_ratio and not (s.numerator and s.denominator):
            raise SpecError(f"{s.name}: a ratio needs numerator and denominator")
        if s.name in names:
            raise SpecError(f"{s.name}: two fields have this name")
        names.add(s.name)
        if s.pos == -1:
            at += 1
            s = FieldSpec(**{**{f.name: getattr(s, f.name) for f in fields(s)}, "pos": at})
        elif s.aggregation == "ratio":
            at = s.pos
        out.append(s)
    return tuple(out)
