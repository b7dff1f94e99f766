"""Connected components of an edge table, by alternating large and small stars.

Both steps are a grouped minimum and a join back on the node, so a hub with any number of
neighbours is pre-aggregated before its shuffle and split by adaptive execution in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(u, v) undirected to (id, comp): comp is the least id reachable, for every id in an edge.
    Loops and nulls are ignored; repeated edges count once."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e)
    mark = _mark(e)
    for _ in range(most):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: edges point from larger to smaller ends
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        x = large.join(low, "u")
        small = x.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    out = e.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return out.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("comp"))).distinct()
