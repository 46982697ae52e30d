"""Connected components by alternating star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattline.llm.common import stored


def _hooked(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: every node's neighbours (larger ones, or else smaller ones and itself) move to its smallest neighbour."""
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    both = stored(both.distinct(), "star-edges")
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-least")
    joined = both.join(least, "u")
    if larger:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge in ``edges`` (u, v); the component is its smallest node.

    Each round is written to the shared folder; nothing but two numbers a round comes to the driver.
    """
    edges = stored(edges.select("u", "v").where("u <> v").distinct(), "component-edges")
    mark = None
    for _ in range(rounds):
        edges = stored(_hooked(stored(_hooked(edges, True), "large-star"), False).distinct(), "small-star")
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component")).distinct()
