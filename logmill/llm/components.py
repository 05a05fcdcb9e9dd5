"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Each step takes edges to the smallest neighbour of a vertex; no neighbour list is ever
gathered.  Vertices with a thousandth or more of all edges, a thousand at most, meet
their smallest neighbour in a broadcast, so a hub's edges stay where they are; the
others in a shuffle join.  Every step is written to the shared folder, which cuts the
lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.llm.storage import forget, materialize


#: One over the share of all edges from which a vertex is a hub.
HUBS = 1000


def _to_least(edges: DataFrame) -> DataFrame:
    """``(v, m)`` for every ``(u, v)``, with ``m`` the least of ``u`` and its neighbours, plus ``(u, m)``."""
    total = edges.count()
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    hub = (F.col("n") * HUBS >= total) & (F.col("n") > 1)
    hubs = F.broadcast(least.where(hub).select("u", "m"))
    near = edges.join(hubs, "u")
    far = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(~hub).select("u", "m"), "u")
    moved = near.unionByName(far).select("v", "m")
    return moved.unionByName(least.select(F.col("u").alias("v"), "m"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(v, root)`` for the vertices of ``edges`` (u, v): root is the least vertex of the component.

    Self-loops keep single vertices; an empty list gives no rows.
    """
    state = materialize(edges.select("u", "v").distinct(), name)
    before = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_to_least(both).where("v >= m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        small = _to_least(large).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).distinct()
        after = materialize(small, name)
        mark = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).collect()[0]
        forget(state, large)
        state = after
        if mark == before:
            return state.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "v")
        before = mark
