"""Reduction trees over the input partitions, and prefix sums over ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.sources.tables import materialise

#: Partial states of one key that a step of a tree merges at most.
FAN_IN = 16


def tree_depth(rows: DataFrame) -> int:
    """Steps after which the states of all partitions of ``rows`` are merged.

    ``rows`` should be a scan or a narrow step of one, so that its partitions are known without a job.
    """
    parts, depth = rows.rdd.getNumPartitions(), 1
    while FAN_IN**depth < parts:
        depth += 1
    return depth


def parent(part: str = "part") -> Column:
    """The node above a node of the tree; leaves are numbered by partition, the root is 0."""
    return F.floor(F.col(part) / FAN_IN).cast("int").alias(part)


def sums_before(rows: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``by`` that come before in ``order``.

    ``order`` should be unique within ``by``. The rows are cut into ranges, each range is summed up on its own and
    starts from the sums of the ranges before it, so that no group is gathered whole.
    """
    ranged = rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    base = parts.select(*by, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(value).over(inner), F.lit(0))).alias("l")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_part"]]
    joined = local.join(base.alias("b"), on)
    return joined.select(*[f"l.{c}" for c in rows.columns], (F.col("_local") + F.col("_base")).alias(out))
