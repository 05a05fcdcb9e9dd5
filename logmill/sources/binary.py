"""Binary inputs of the kernels, and generators of synthetic ones."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_bitmaps(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file, channel, value, n``: value counts of the B, G, R bytes of 24-bit BMP files.

    A file is one value of Spark's binary reader; only 3 x 256 counts leave its task.
    The rest of the file from the data offset on is pixels, as in the format's simplest form.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if raw[:2] != b"BM":
                    raise ValueError(f"{path}: not a BMP file")
                (start,), (bits,) = struct.unpack_from("<I", raw, 10), struct.unpack_from("<H", raw, 28)
                if bits != 24:
                    raise ValueError(f"{path}: {bits} bits a pixel, not 24")
                pixels = np.frombuffer(raw, np.uint8, offset=start)
                pixels = pixels[: len(pixels) // 3 * 3].reshape(-1, 3)
                for k, channel in enumerate("BGR"):
                    n = np.bincount(pixels[:, k], minlength=256)
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_pydict({"file": [path] * len(at), "channel": [channel] * len(at), "value": pa.array(at, pa.int32()), "n": pa.array(n[at])})

    raw = spark.read.format("binaryFile").load(paths).select("path", "content")
    return raw.mapInArrow(count, "file string, channel string, value int, n long")


def read_points(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``x, y`` of files of signed byte pairs."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                pairs = np.frombuffer(raw, np.int8, len(raw) // 2 * 2).reshape(-1, 2)
                for a in range(0, len(pairs), 1 << 20):
                    part = pairs[a : a + (1 << 20)].astype(np.int32)
                    yield pa.RecordBatch.from_pydict({"x": pa.array(part[:, 0]), "y": pa.array(part[:, 1])})

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(unpack, "x int, y int")


def random_words(spark: SparkSession, n: int, length: int = 3, seed: int = 0) -> DataFrame:
    """``doc, text``: ``n`` words of random upper-case letters, a row each."""
    letter = lambda k: F.char((65 + F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(26))).cast("long"))
    return spark.range(n).select(F.col("id").alias("doc"), F.concat(*(letter(k) for k in range(length))).alias("text"))


def grid_points(spark: SparkSession, n: int, dim: int, grid: int) -> DataFrame:
    """``id, point``: coordinate ``j`` of point ``i`` is ``(i * j) mod grid + 1``."""
    coordinates = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: (F.col("id") * j) % grid + 1)
    return spark.range(n).select("id", coordinates.alias("point"))


def random_matrix(spark: SparkSession, rows: int, cols: int, most: int = 100, seed: int = 0) -> DataFrame:
    """``i, j, v``: a matrix of integers from 0 up to ``most``, in coordinates."""
    cell = spark.range(rows * cols)
    value = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(most))
    return cell.select(F.floor(F.col("id") / cols).alias("i"), (F.col("id") % cols).alias("j"), value.alias("v"))
