"""Writing summaries to files, to the console, or to an HTTP endpoint."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.operators.top import top_keys, totals
from logmill.sinks.render import csv_frame, json_lines, text_lines

OUTPUT_FORMATS = ("json", "csv", "text", "mem")


def write_summary(summary: DataFrame, path: str, output_format: str = "text", mode: str = "error") -> None:
    """Write a folder of files; ``mem`` and unknown formats write nothing."""
    if output_format == "json":
        json_lines(summary).write.mode(mode).text(path)
    elif output_format == "csv":
        csv_frame(summary).write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    elif output_format == "text":
        text_lines(summary).write.mode(mode).text(path)


def print_top(summary: DataFrame, n: int = 5) -> str:
    """The most frequent keys and the totals, as text."""
    t = totals(summary).collect()[0]
    lines = [f"{r['logs']:>12} {r['id']}" for r in top_keys(summary, n).collect()]
    return "\n".join([f"Number of keys: {t['n_keys']}", f"Number of logs: {t['n_logs']}", *lines])


def _send(url: str, body: bytes, timeout: float, attempts: int, headers: dict[str, str], method: str) -> tuple[bool, int]:
    status = 0
    for attempt in range(attempts):
        try:
            request = urllib.request.Request(url, data=body, headers=headers, method=method)
            with urllib.request.urlopen(request, timeout=timeout) as answer:  # certificates are verified
                return True, answer.status
        except urllib.error.HTTPError as e:
            status = e.code
            if 400 <= e.code < 500:
                break
        except OSError:
            status = 0
        if attempt + 1 < attempts:
            time.sleep(min(8.0, 0.2 * 2**attempt))
    return False, status


def post_lines(
    lines: DataFrame,
    url: str,
    batch: int = 1000,
    timeout: float = 30.0,
    attempts: int = 3,
    headers: dict[str, str] | None = None,
    method: str = "POST",
    column: str = "value",
) -> DataFrame:
    """Send JSON lines in arrays of up to ``batch`` and return one row: ``succeeded, failed`` (requests).

    Each partition sends its own; a retried task sends again, as the endpoint's
    documents have ids this overwrites them.
    """
    head = {"Content-Type": "application/json"} | (headers or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = bad = 0
        held: list[str] = []

        def flush() -> None:
            nonlocal good, bad
            if held:
                ok, _ = _send(url, ("[" + ",".join(held) + "]").encode(), timeout, attempts, head, method)
                good, bad = good + ok, bad + (not ok)
                held.clear()

        for b in batches:
            for line in b.column(0).to_pylist():
                if line:
                    held.append(line)
                if len(held) >= batch:
                    flush()
        flush()
        yield pa.RecordBatch.from_pydict({"succeeded": pa.array([good], pa.int64()), "failed": pa.array([bad], pa.int64())})

    sent = lines.select(column).mapInArrow(run, "succeeded long, failed long")
    return sent.agg(F.coalesce(F.sum("succeeded"), F.lit(0)).alias("succeeded"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"))


def fetch_all(urls: DataFrame, column: str = "url", timeout: float = 30.0, attempts: int = 1, body_limit: int = 1 << 20, proxy: str | None = None, cookie: str | None = None, method: str = "GET", headers: str | None = None, jar: bool = False) -> DataFrame:
    """``url, status, body`` of each address (status 0: no answer); bodies end after ``body_limit`` bytes.

    ``headers`` names a column with a map of headers of each request; with ``jar`` a task
    keeps the cookies that answers set and sends them on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handlers = [urllib.request.ProxyHandler({"http": proxy, "https": proxy})] if proxy else []
        if jar:
            handlers.append(urllib.request.HTTPCookieProcessor())
        opener = urllib.request.build_opener(*handlers)
        for b in batches:
            found = b.column(0).to_pylist()
            more = b.column(1).to_pylist() if headers else [None] * len(found)
            status, bodies = [], []
            for url, own in zip(found, more):
                code, body = 0, None
                for _ in range(attempts):
                    try:
                        request = urllib.request.Request(url, headers=({"Cookie": cookie} if cookie else {}) | dict(own or {}), method=method)
                        with opener.open(request, timeout=timeout) as answer:
                            code, body = answer.status, answer.read(body_limit).decode("utf-8", "replace")
                        break
                    except urllib.error.HTTPError as e:
                        code = e.code
                        break
                    except (OSError, ValueError):
                        code = 0
                status.append(code)
                bodies.append(body)
            yield pa.RecordBatch.from_pydict({"url": pa.array(found, pa.string()), "status": pa.array(status, pa.int32()), "body": pa.array(bodies, pa.string())})

    return urls.select(column, *([headers] if headers else [])).mapInArrow(run, "url string, status int, body string")
