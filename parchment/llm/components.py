"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.store import new_path, removed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger neighbours (large) or smaller ones and itself (small) to its least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = both.join(least, "a").where("b > a").select(F.col("b").alias("x"), "m")
        return linked.where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    linked = edges.join(least, "b")
    own = least.select(F.col("m").alias("a"), "b")
    rest = linked.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return own.unionByName(rest).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is the least node reachable.

    Links with a null end, and of a node with itself, count for nothing. Every round is written to the shared
    folder, which cuts lineage; the table of the round before is deleted. Nothing is collected but a count and
    a checksum of the links.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    path, before = None, None
    for _ in range(most_rounds):
        fresh = new_path(spark, "links")
        (_star(_star(now, True), False) if path else now).write.parquet(fresh)
        now = spark.read.schema(now.schema).parquet(fresh)
        if path:
            removed(spark, path)
        path = fresh
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if not state[0] or state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
