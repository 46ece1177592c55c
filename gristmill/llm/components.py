"""Connected components by alternating star contraction; labels stay distributed, lineage is cut every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.session import cut


def _nearest(edges: DataFrame, node: str, other: str) -> DataFrame:
    return edges.groupBy(F.col(node).alias("u")).agg(F.min(other).alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has an edge; component is the least node of its component.

    edges: two long columns. Loops, repeated and reversed edges change nothing; edges with a null end are left out;
    no edges give no rows. Each round first links every greater neighbour to the least neighbour (large star), then
    every lesser one (small star); the number of rounds grows with the logarithm of the nodes, and a node with very
    many neighbours is one row on the small side of a join whose large side is split by the planner.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e)
    before = _state(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _nearest(both, "u", "v").select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _nearest(large, "u", "v")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = cut(small)
        after = _state(e)
        if after == before:
            break
        before = after
    # every edge now runs from a node to the root of its star
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
