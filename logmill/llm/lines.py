"""Line dedup over overlapping windows of three consecutive lines.

Lines that hold a word are numbered; every three in a row form a window, compared
exactly (no trimming) by a 128-bit hash.  Of a window that occurs more than once anywhere,
the first occurrence, by ``doc_id`` and then by position, stays; the lines that
later occurrences cover are merged and removed.  Lines without a word belong to
no window and stay.

A task reports a window with its first place so far; places that come after it in
the comparison are known to go.  So a window that is everywhere has about one row per
task where documents come in order of their ids.  What a task remembers of windows has
a fixed size; what falls out of it costs a row more and changes no result.  Documents
with fewer than three such lines, empty and null texts stay as they are.  Rows
equal in id and text are one document to the comparison and share its outcome;
a null ``doc_id`` sorts first.  An empty table gives no rows.  Columns are returned as
they are, whatever their names.  A very long text is handled whole by its task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logmill.llm.storage import fresh
from logmill.llm.substrings import keyed

WINDOW = 3
#: Windows of which a task remembers the first place, at least; twice as many at most.
REMEMBER = 20_000
_SPACE = b" \t\n\v\f\r"


def _content_lines(text: str) -> list[tuple[int, bytes]]:
    """``(number, line)`` of the lines that hold a word."""
    return [(i, x) for i, x in enumerate(text.encode().split(b"\n")) if x.strip(_SPACE)]


def later_windows(docs: DataFrame, width: int = WINDOW, remember: int = REMEMBER) -> DataFrame:
    """``_key, at``: first lines (among those with a word) of windows that are not their first occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        newer: dict[bytes, tuple[int, int, int]] = {}
        older: dict[bytes, tuple[int, int, int]] = {}
        low = -(1 << 63)
        for batch in batches:
            first: dict[bytes, tuple[int, int, int]] = {}
            gone: list[tuple[int, int]] = []
            for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_key", "text"))):
                if not text or text.count("\n") + 1 < width:
                    continue
                lines = [hashlib.blake2b(x, digest_size=16).digest() for _, x in _content_lines(text)]
                for at in range(len(lines) - width + 1):
                    h = hashlib.blake2b(b"".join(lines[at : at + width]), digest_size=16).digest()
                    place, old = (low if doc_id is None else doc_id, key, at), first.get(h)
                    if old is None:
                        old = newer.get(h) or older.pop(h, None)
                        if old is not None:  # reported by an earlier batch: only an earlier place is news
                            newer[h] = old
                            if place < old:
                                first[h] = place
                            elif place > old:
                                gone.append(place[1:])
                        else:
                            first[h] = place
                    elif place < old:
                        first[h] = place
                        gone.append(old[1:])
                    elif place > old:
                        gone.append(place[1:])
            newer.update(first)
            if len(newer) > remember:
                newer, older = {}, newer
            known = [None] * len(gone)
            yield pa.RecordBatch.from_pydict(
                {
                    "h": pa.array([*first, *known], pa.binary()),
                    "doc": pa.array([*(p[0] for p in first.values()), *known], pa.int64()),
                    "_key": pa.array([*(p[1] for p in first.values()), *(g[0] for g in gone)], pa.int64()),
                    "at": pa.array([*(p[2] for p in first.values()), *(g[1] for g in gone)], pa.int32()),
                }
            )

    found = keyed(docs.select("doc_id", "text")).mapInArrow(run, "h binary, doc long, _key long, at int")
    # Rows without a hash are known to go; a hash of their place spreads them over the tasks.
    spread = F.when(F.col("h").isNull(), F.xxhash64("_key", "at").cast("string").cast("binary")).otherwise(F.col("h"))
    order = Window.partitionBy("s").orderBy("doc", "_key", "at")
    ranked = found.withColumn("s", spread).withColumn("rank", F.dense_rank().over(order))
    return ranked.where("h is null or rank > 1").select("_key", "at")


def remove_repeated_windows(docs: DataFrame, width: int = WINDOW, counts: tuple[str, str] | None = None, remember: int = REMEMBER) -> DataFrame:
    """All columns of ``docs`` with ``text`` rebuilt; ``counts`` names columns to add for its lines and those removed."""
    key, cut = fresh(docs, "_key"), fresh(docs, "_gone")
    gone = later_windows(docs, width, remember).groupBy(F.col("_key").alias(key)).agg(F.collect_set("at").alias(cut))
    rows = keyed(docs, key).join(gone, key, "left").drop(key)
    names, place = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, removed = [], [], []
            for text, at in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist()):
                lost: set[int] = set()
                n = 0 if text is None else text.count("\n") + 1
                if at:
                    numbers = [i for i, _ in _content_lines(text)]
                    lost = {numbers[k] for a in at for k in range(a, a + width)}
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in lost)
                texts.append(text)
                total.append(n)
                removed.append(len(lost))
            columns = batch.columns[: len(names)]
            columns[place] = pa.array(texts, pa.string())
            added = [pa.array(total, pa.int64()), pa.array(removed, pa.int64())] if counts else []
            yield pa.RecordBatch.from_arrays([*columns, *added], [*names, *(counts or ())])

    schema = StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in counts or ())])
    return rows.mapInArrow(run, schema)
