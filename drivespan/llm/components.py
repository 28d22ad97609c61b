"""Connected components as Spark joins: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from drivespan.llm.shared import put, remove, shared_path, shuffles_removed


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each node's greater neighbours, and itself, go to the least of it and its neighbours (lo). Edges hold u > v; some come out more than once."""
    met = edges.select(F.col("v").alias("near"), F.col("u").alias("far")).join(least.hint("merge"), F.col("near") == F.col("u"))
    out = met.select(F.col("far").alias("u"), F.least("u", "lo").alias("v"))
    return out.unionByName(least.filter("lo < u").select("u", F.col("lo").alias("v")))


def _small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each node's lesser neighbours, and itself, go to the least of them (lo)."""
    met = edges.join(least.hint("merge"), "u").filter("v > lo").select(F.col("v").alias("u"), F.col("lo").alias("v"))
    return met.unionByName(least.select("u", F.col("lo").alias("v"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v longs): component is the least node that can be reached.

    Self-loops, repeated and null edges are ignored; no edges give an empty table. What a round makes is written, so that lineage stays short, a lost executor costs one
    step at most, and small tables are read by few tasks; it goes once the next round's edges stand. Each node's least neighbour comes from a grouped min and joins back
    as a table, so that a node with very many edges is split by Spark's skew join. Rounds end when every node has one neighbour or none but greater ones.
    """
    spark = edges.sparkSession
    base = shared_path(spark, "components")
    e = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct()
    with shuffles_removed(spark):
        e = put(e, f"{base}/0/edges")
        for k in range(most_rounds):
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = put(both.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")), f"{base}/{k}/least")
            if not least.filter("lo < u and lo < hi").head(1):
                break
            large = put(_large_star(e, least), f"{base}/{k}/large")
            least = put(large.groupBy("u").agg(F.min("v").alias("lo")), f"{base}/{k}/lesser")
            e = put(_small_star(large, least), f"{base}/{k + 1}/edges")
            remove(spark, f"{base}/{k}")
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
