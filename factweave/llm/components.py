"""Connected components of an edge table by alternating large-star and small-star rounds; nothing goes to the driver but
a row count and a checksum for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import keep, with_groups


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """id, component (the smallest id reachable) of every node of edges(u, v); nodes are longs.

    Each round aggregates the smallest neighbour of a node and joins it back: no neighbour list is gathered anywhere, and
    the edges of a node that has a thousandth of them all are answered by a broadcast in place. The rounds end when the
    edges stop changing, which takes a number of them that grows with the logarithm of the graph's diameter.

    Cases: loops and edges with a null end are ignored, repeated edges count once, no edges -> no rows; the result has one
    row for each node and does not depend on the order of rows.
    """
    now = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        seen = tuple(state)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("m_u")).agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        large = with_groups(both.where("v > u"), low, {"u": "m_u"}, ["m"], "degree", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy(F.col("u").alias("m_u")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        moved = with_groups(large, small, {"u": "m_u"}, ["m"], "degree", 2 * state[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = keep(moved.unionByName(small.select(F.col("m_u").alias("u"), F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
