"""Retrieval quality per query and on average."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_metrics(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, hit1, hit3, hit5, rr): ranks count distinct documents in order of first appearance.

    ``ranked`` holds (query_id, doc, rank), ``gold`` (query_id, doc); queries without a hit get zeros.
    """
    first = ranked.groupBy("query_id", "doc").agg(F.min("rank").alias("rank"))
    dense = first.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc")))
    best = dense.join(gold, ["query_id", "doc"]).groupBy("query_id").agg(F.min("r").alias("r"))
    q = gold.select("query_id").distinct().join(best, "query_id", "left")
    hit = lambda k: F.when(F.col("r") <= k, 1.0).otherwise(0.0).alias(f"hit{k}")
    return q.select("query_id", hit(1), hit(3), hit(5), F.coalesce(F.round(1 / F.col("r"), 6), F.lit(0.0)).alias("rr"))


def mean_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit1", "hit3", "hit5")], F.round(F.avg("rr"), 6).alias("mrr"))


def nearest_rank(values: DataFrame, by: list[str], value: str, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """(by..., n, p50, p95...): nearest-rank percentiles of whole numbers.

    Equal values are counted first; the window runs over distinct values.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    up = counted.withColumn("cum", F.sum("c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    return up.groupBy(*by).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("cum") >= F.ceil(F.col("n") * p / 100), F.col(value))).alias(f"p{p}") for p in percents])
