"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.staging import drop, staged


def connected_components(edges: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """``id``, ``component`` (the smallest id reachable) of every id that an edge names.

    Each round points every id to its neighbour (or itself) with the least random number, follows
    that once more, and joins ids with what they point to: what is left is the edges between
    different ones, so a round's tables are a fraction of those of the round before, also on
    long chains. At the end the pointers are followed back to the ids. Edges with a null end are
    left out; loops and repeats do no harm; no edges give an empty table.
    """
    spark, scratch, pointers = edges.sparkSession, [], []
    one = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    both = staged(one.union(one.select("b", "a")).distinct(), "edges", scratch)
    kept: list[str] = []
    while not both.isEmpty():
        luck = F.struct(F.xxhash64("b", F.lit(len(pointers))).alias("r"), F.col("b").alias("v"))
        mine = F.struct(F.xxhash64("a", F.lit(len(pointers))).alias("r"), F.col("a").alias("v"))
        near = both.groupBy("a").agg(F.min(luck).alias("near")).select("a", F.least("near", mine)["v"].alias("p"))
        near = staged(near, "near", scratch)
        onward = staged(near.join(near.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", F.col("q").alias("p")), "pointers", kept)
        pointers.append(onward)
        moved = both.join(onward, "a").select("b", F.col("p").alias("x")).join(onward.withColumnRenamed("a", "b"), "b")
        rest = staged(moved.where("x <> p").select(F.col("x").alias("a"), F.col("p").alias("b")).distinct(), "edges", last := [])
        drop(spark, scratch)
        both, scratch = rest, last
    drop(spark, scratch)
    if not pointers:
        return one.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    roots = pointers[-1]
    for earlier in reversed(pointers[:-1]):
        further = roots.select(F.col("a").alias("p"), F.col("p").alias("q"))
        roots = earlier.join(further, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
    least = roots.groupBy("p").agg(F.min("a").alias("component"))
    found = staged(roots.join(least, "p").select(F.col("a").alias("id"), "component"), "components")
    drop(spark, kept)
    return found
