"""Fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def dedupe_first(ranked: DataFrame, by: list[str], key: str, pos: str) -> DataFrame:
    """The first row of each key of a list, by position."""
    w = Window.partitionBy(*by, key).orderBy(pos)
    return ranked.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def reciprocal_rank_fusion(arms: list[DataFrame], by: list[str], key: str, k: int = RRF_K) -> DataFrame:
    """(by..., key, score, rank): sum of 1/(k + rank) over lists (by..., key, rank), rank from 1.

    A key counts once per list, at its best rank. Ties go to the key of the earlier list and rank, then
    to the lesser key.
    """
    lists = [a.groupBy(*by, key).agg(F.min("rank").alias("rank")).withColumn("arm", F.lit(i)) for i, a in enumerate(arms)]
    every = reduce(DataFrame.unionByName, lists)
    fused = every.groupBy(*by, key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("arm", "rank")).alias("_first"))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "_first", key)
    return fused.withColumn("rank", F.row_number().over(w)).drop("_first")
