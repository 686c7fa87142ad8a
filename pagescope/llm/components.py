"""Connected components of a graph of links, by alternating star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """large: each node's larger neighbours move to its smallest neighbour (or itself); else its smaller ones do,
    and the node with them. Neighbours meet their node's minimum in a join, never in one list."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        moved = around.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least.withColumnRenamed("a", "n"), F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of links (a, b), of type long: component is the smallest node reachable.

    Each round's edges are written to the shared folder; rounds end when the edges stay the same, then each node
    points to its component. Links to itself and repeated links don't matter; nulls are left out."""
    a, b = F.greatest("a", "b").cast("long"), F.least("a", "b").cast("long")
    edges = cut(links.where("a is not null and b is not null and a <> b").select(a.alias("a"), b.alias("b")).distinct())
    seen = None
    for _ in range(most_rounds):
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
        edges = cut(_stars(_stars(edges, True), False))
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
