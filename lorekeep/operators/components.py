"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.sources.tables import free, materialise


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): each node of ``edges`` with the least node id of its component.

    Null ends, loops and repeated edges are ignored; nodes without an edge do not appear. Every round
    is written to the shared folder and the one before it deleted; the rounds end when a round leaves the
    edges as they were. Only two sums per round reach the driver.
    """
    e = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = materialise(e, "cc")
    seen = _mark(e)
    while True:
        last, e = e, materialise(_small_star(_large_star(e)), "cc")
        free(last)
        now = _mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select("lo", "lo")).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    """Join every greater neighbour of a node to the least of the node and its neighbours."""
    both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select("hi", "lo"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    up = e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    return up.join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where(F.col("lo") < F.col("hi")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Join a node and its lesser neighbours to the least of them."""
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = e.join(least, "hi").select(F.col("m").alias("a"), F.col("lo").alias("b"))
    return moved.where(F.col("a") != F.col("b")).union(least.select("m", "hi")).toDF("lo", "hi").distinct()
