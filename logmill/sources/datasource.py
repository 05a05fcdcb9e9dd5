"""``spark.read.format("logmill")``: parsed logs as a table, through Spark's Python data source interface.

The batch entry for data at rest is ``read_lines``, which stays inside the JVM; this
facade is for SQL users who want tokens as columns of a view.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from logmill.plans.spec import LogFormat, load_format

#: Bytes of a file per task.
SPLIT = 64 << 20
#: Rows of a batch.
BATCH = 8192


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    end: int


def _split_line(line: str, fmt: LogFormat) -> list[str]:
    d = re.escape(fmt.delims)
    if fmt.quotechar:
        q = re.escape(fmt.quotechar[0])
        found = re.findall(rf"{q}(?=[{d}]|$)|{q}.*?{q}(?=[{d}]|$)|{q}.*|[^{d}]+", line)
        found = [x.rstrip(fmt.delims) if x.startswith(fmt.quotechar[0]) else x for x in found]
    else:
        found = re.findall(rf"[^{d}]+", line)
    return [x.replace('"', "") for x in found]


class LogReader(DataSourceReader):
    def __init__(self, paths: list[str], fmt: LogFormat, header: bool, split: int):
        self.paths, self.fmt, self.header, self.split = paths, fmt, header, split

    def partitions(self) -> list[FileRange]:
        from pyarrow import fs

        out = []
        for uri in self.paths:
            store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
            size = store.get_file_info(path).size or 0
            out += [FileRange(uri, a, min(size, a + self.split)) for a in range(0, max(size, 1), self.split)]
        return out

    def read(self, part: FileRange) -> Iterator:
        """Lines that begin inside the range, whole, as Arrow batches."""
        import pyarrow as pa

        wanted = [f for f in self.fmt.fields if not f.is_ratio and not f.is_contain]
        rows, names = self._rows(part, [f.pos for f in wanted]), [f.name for f in wanted]
        while held := list(islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], pa.string()) for k in range(len(names))], names)

    def _rows(self, part: FileRange, places: list[int]) -> Iterator[list[str]]:
        from pyarrow import fs

        uri = part.path
        store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
        with io.BufferedReader(store.open_input_file(path), 1 << 20) as raw:
            at = part.start
            if at:
                raw.seek(at - 1)
                at = at - 1 + len(raw.readline())
            else:
                raw.seek(0)
            first = part.start == 0
            while at < part.end:
                line = raw.readline()
                if not line:
                    break
                at += len(line)
                if first and self.header:
                    first = False
                    continue
                first = False
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                if not text.strip() or (self.fmt.commentchar and text.startswith(self.fmt.commentchar[0])):
                    continue
                tokens = _split_line(text, self.fmt)
                if len(tokens) > self.fmt.max_pos:
                    yield [tokens[k] for k in places]


class LogSource(DataSource):
    """Options: ``path`` (comma-separated files), ``format`` (JSON text or file), ``header``, ``split``."""

    @classmethod
    def name(cls) -> str:
        return "logmill"

    def _format(self) -> LogFormat:
        return load_format(self.options["format"])

    def schema(self) -> str:
        return ", ".join(f"`{f.name}` string" for f in self._format().fields if not f.is_ratio and not f.is_contain)

    def reader(self, schema) -> LogReader:
        header = self.options.get("header", "false").lower() == "true"
        return LogReader(self.options["path"].split(","), self._format(), header, int(self.options.get("split", SPLIT)))
