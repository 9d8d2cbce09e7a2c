"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.runtime import written


def _small_star(e: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, point to the least of them."""
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    m = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(m, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(m.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Every node's larger neighbours point to the least of its neighbours and itself."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(m, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node of the component of each node that has an edge.

    Edges are undirected; loops, repeated and null edges count for nothing; no edges give no rows. Rounds grow
    with the logarithm of the longest chain, each cuts its lineage by a written table, and no component is ever
    collected: a hot one only sends every node to its least one, which is a minimum and aggregates on the map side.
    """
    e = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().filter("a != b").distinct(), "edges")
    before = None
    while True:
        e = written(_small_star(_large_star(e)), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
