"""Choosing a bounded set of frequent keys, and fixed-size Bloom filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequent(counts: DataFrame, column: str, limit: int) -> DataFrame:
    """Rows of ``counts`` with the largest ``column``: all from some value on, ``limit`` at most.

    The cut comes from a histogram over eighths of powers of two (a few hundred
    rows), so no task sorts or gathers the keys.
    """
    bucket = F.floor(F.log2(F.col(column).cast("double")) * 8).cast("int")
    sizes = counts.where(F.col(column) > 0).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    room, cut = limit, None
    for r in sorted(sizes, key=lambda r: -r["b"]):
        if r["n"] > room:
            break
        room, cut = room - r["n"], r["b"]
    if cut is None:
        return counts.where(F.lit(False))
    return counts.where((F.col(column) > 0) & (bucket >= cut))


class Bloom:
    """A Bloom filter of ``2**log2_bits`` bits, built by Spark and broadcast; its size never depends on the data.

    False positives only cost work: each use is followed by an exact join.
    """

    PROBES = 3

    def __init__(self, words: np.ndarray, log2_bits: int):
        self.words, self.log2_bits = words, log2_bits

    @classmethod
    def of(cls, keys: DataFrame, column: Column, log2_bits: int = 26) -> "Bloom":
        """Over the 64-bit integer ``column`` of ``keys``; the driver gets at most ``2**(log2_bits-6)`` words."""
        per = log2_bits
        bits = [F.shiftrightunsigned(column, 64 - per) if k == 0 else F.shiftrightunsigned(F.shiftleft(column, k * 19), 64 - per) for k in range(cls.PROBES)]
        bit = F.explode(F.array(*bits))
        at = keys.select(bit.alias("bit"))
        words = at.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("v"))
        table = words.toArrow()
        out = np.zeros(1 << (per - 6), np.uint64)
        if table.num_rows:
            out[table["w"].to_numpy()] = table["v"].to_numpy().astype(np.int64).view(np.uint64)
        return cls(out, per)

    def __contains__(self, x) -> bool:
        return bool(self.has(np.array([x], np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64, copy=False)
        ok = np.ones(len(keys), bool)
        for k in range(self.PROBES):
            bit = (keys << np.uint64(k * 19)) >> np.uint64(64 - self.log2_bits)
            ok &= (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0
        return ok
