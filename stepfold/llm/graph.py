"""Connected components over an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.llm.common import cut

HUBS = 100_000  #: nodes of many neighbours that are broadcast, at most
DEGREE = 64  #: neighbours that make a hub, at least


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).withColumnRenamed("u", "at")


def _join(edges: DataFrame, end: str, minima: DataFrame, many: int) -> DataFrame:
    """`edges` with the minimum at one end. Hubs, which are few by their degree, are broadcast, so that no task gets all
    edges of one; all other ends have few edges each."""
    hubs, rest = F.broadcast(minima.where(F.col("degree") > many)), minima.where(F.col("degree") <= many)
    dense = edges.join(hubs, edges[end] == hubs["at"])
    light = edges.join(hubs, edges[end] == hubs["at"], "left_anti")
    return dense.union(light.join(rest, light[end] == rest["at"])).select("u", "v", "at", "m")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of `edges` (u, v); root is the smallest node of the component.

    Each round is two grouped minima and joins back to the edges; no component is ever gathered. Self loops, repeated
    edges and edges with a null end are allowed; the latter are ignored. An empty table gives an empty result.
    """
    both = edges.select(F.col("u").alias("u"), F.col("v").alias("v")).where("u is not null and v is not null and u <> v")
    current = cut(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n, seen = current.count(), None
    for _ in range(max_rounds):
        many = max(DEGREE, 2 * n // HUBS)  # 2n ends in all, so at most HUBS nodes have more
        # large star: every neighbour above a node moves to the smallest node around it
        around = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _minima(around).withColumn("m", F.least("at", "m"))
        large = _join(current, "v", least, many).select("u", F.col("m").alias("v"))
        own = least.select(F.col("at").alias("u"), F.col("m").alias("v"))
        large = large.union(own).where("u <> v").distinct()
        # small star: the lower neighbours of a node, and the node itself, move to the smallest of them
        small = _join(large, "u", _minima(large), many)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        current = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        n, total = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select(F.col("v"), F.col("v")).distinct())
        seen = (n, total)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
