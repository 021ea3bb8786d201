"""Connected components by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillmesh.llm.common import drop_staged, stage_table

MAX_ROUNDS = 60


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable, for every node that has a link.

    Links with a null end are ignored, loops and repeats are allowed. Each round is two aggregations over edges,
    written to the shared folder; rounds end when an aggregate of the edges no longer changes. A node's neighbours
    are never gathered: both steps need only the least neighbour, joined back to the edges.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every greater neighbour goes to the least one
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node's lesser neighbours and itself go to the least of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        old, edges = edges, stage_table(moved.select("e.u", "e.v").where("u <> v").distinct(), "components")
        drop_staged(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
