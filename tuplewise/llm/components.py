"""Connected components of an edge table by alternating large-star and small-star steps.

Each step points every node of a neighbourhood at its smallest member; a few rounds turn every component
into a star around its smallest node. Only aggregates and equi-joins are used, so a hub with many edges is
pre-aggregated before the shuffle and its join rows can be split by adaptive execution. The edges of each
round are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, durable_at

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): for every node with an edge, the smallest node it reaches. Loops and nulls are ignored."""
    spark = edges.sparkSession
    start = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct()
    e, path = durable_at(start, "edges")
    seen = _state(e)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_path = durable_at(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.select("u", F.col("m").alias("v")).unionByName(near.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        old = path
        e, path = durable_at(small, "edges")
        drop_path(spark, old)
        drop_path(spark, large_path)
        now = _state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    star = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(e: DataFrame) -> tuple:
    """Edges, and an order-free digest of them: one row for the driver."""
    h = F.xxhash64("u", "v")
    row = e.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.shiftright(h, 24)), F.lit(0))).first()
    return tuple(row)
