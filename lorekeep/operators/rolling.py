"""Rolling totals over trailing days from segment-tree nodes.

Calls are reduced to one leaf per entity and day. Each leaf adds to its ancestors in a binary tree
over blocks of 64 aligned days (a time shard); a node is a row (entity, level, idx) that holds the
sums and counts of days idx*2^level ... (idx+1)*2^level-1. A trailing period is answered from at most
two nodes per level, and a late correction touches only the ancestors of its own day.

A stored tree is a folder of Parquet files, split by time shard. Sums are additive, so a correction is
written as one small row for each ancestor of its day and nothing else is read or rewritten; ``read_nodes``
adds the rows of a node up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.time import day_text, utc_day

#: Levels 0 (a day) to 6 (a shard of 64 days).
TOP = 6
SUMS = ["calls", "injected", "n_injected", "baseline", "n_baseline"]
_STORED = "project string, level int, idx int, " + ", ".join(f"{c} bigint" for c in SUMS)


def daily_leaves(events: DataFrame) -> DataFrame:
    """(project, day, calls, injected, n_injected, baseline, n_baseline): one row per active day.

    A row's ``id`` is counted once: of rows with one id the greatest (day, project, tokens) is taken,
    so exact copies change nothing; a null id is a call of its own. Rows with a null project or an
    unreadable ``ts`` are ignored. Null tokens add nothing to sums nor to their counts. Columns beyond
    those read are ignored.
    """
    calls = events.select(
        "id",
        F.when(F.col("id").isNull(), F.monotonically_increasing_id()).alias("_row"),
        utc_day(F.col("ts")).alias("day"),
        "project",
        F.col("tokens_injected").cast("bigint").alias("i"),
        F.col("tokens_baseline").cast("bigint").alias("b"),
    ).where(F.col("project").isNotNull() & F.col("day").isNotNull())
    once = calls.groupBy("id", "_row").agg(F.max(F.struct("day", "project", "i", "b")).alias("c")).select("c.*")
    return once.groupBy("project", "day").agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum("i"), F.lit(0)).alias("injected"),
        F.count("i").alias("n_injected"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("baseline"),
        F.count("b").alias("n_baseline"),
    )


def segment_nodes(leaves: DataFrame) -> DataFrame:
    """All tree nodes (project, level, idx, sums...) above the given leaves."""
    return (
        leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(TOP))))
        .groupBy("project", "level", _up(F.col("day"), F.col("level")).alias("idx"))
        .agg(*[F.sum(c).alias(c) for c in SUMS])
    )


def write_nodes(nodes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store nodes below ``path``, split by time shard (``mode`` as of DataFrameWriter)."""
    rows = nodes.select("*", F.expr(f"shiftright(shiftleft(idx, level), {TOP})").alias("shard"))
    rows.repartition("shard", F.pmod(F.hash("project"), F.lit(8))).write.mode(mode).partitionBy("shard").parquet(path)


def apply_corrections(path: str, corrections: DataFrame) -> None:
    """Add late calls to the stored tree: ``corrections`` are leaves (negative sums take calls away).

    Only the ancestors of the corrected days are written, one row each.
    """
    write_nodes(segment_nodes(corrections), path, "append")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of a stored tree, corrections included."""
    rows = spark.read.schema(_STORED).parquet(path)
    return rows.groupBy("project", "level", "idx").agg(*[F.sum(c).alias(c) for c in SUMS])


def _up(day: Column, level: Column) -> Column:
    return F.floor(day / F.pow(F.lit(2), level)).cast("int")


def _node(level: int, idx: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), idx.alias("idx"))


def range_nodes(low: Column, high: Column) -> Column:
    """The fewest nodes that tile days ``low`` to ``high``, as array<struct<level,idx>>."""
    picks = []
    for level in range(TOP + 1):
        width = 1 << level
        left = F.ceil(low / F.lit(width)).cast("int")
        right = F.floor((high + 1) / F.lit(width)).cast("int")
        some = left < right
        if level == TOP:
            picks.append(F.when(some, F.transform(F.sequence(left, right - 1), lambda i: _node(TOP, i))))
        else:
            picks.append(F.when(some & (left.bitwiseAND(F.lit(1)) == 1), F.array(_node(level, left))))
            picks.append(F.when(some & (right.bitwiseAND(F.lit(1)) == 1), F.array(_node(level, right - 1))))
    return F.flatten(F.filter(F.array(*picks), lambda x: x.isNotNull()))


def rolling_totals(nodes: DataFrame, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Totals and averages over trailing windows for every project and day of its history.

    Days run from a project's first to its last day with calls, days without calls included. Per
    window w: ``calls_{w}d``, ``injected_{w}d``, ``baseline_{w}d`` and the averages per call that has
    the value, ``avg_injected_{w}d`` and ``avg_baseline_{w}d`` (null where no call has it). An empty
    input gives an empty result.
    """
    day = nodes.where((F.col("level") == 0) & (F.col("calls") > 0))
    days = day.groupBy("project").agg(F.min("idx").alias("a"), F.max("idx").alias("b")).select("project", F.explode(F.sequence("a", "b")).alias("day"))
    asked = days.select("project", "day", F.explode(F.array(*[F.lit(w) for w in windows])).alias("w"))
    parts = asked.select("project", "day", "w", F.explode(range_nodes(F.col("day") - F.col("w") + 1, F.col("day"))).alias("n")).select("project", "day", "w", "n.level", "n.idx")
    summed = parts.join(nodes, ["project", "level", "idx"], "left").groupBy("project", "day")
    aggs = [F.coalesce(F.sum(F.when(F.col("w") == w, F.col(c))), F.lit(0)).alias(f"{c}_{w}d") for w in windows for c in SUMS]
    out = summed.agg(*aggs)
    ratio = lambda c, w: F.when(F.col(f"n_{c}_{w}d") > 0, F.round(F.col(f"{c}_{w}d") / F.col(f"n_{c}_{w}d"), 6)).alias(f"avg_{c}_{w}d")
    cols = [x for w in windows for x in (F.col(f"calls_{w}d"), F.col(f"injected_{w}d"), F.col(f"baseline_{w}d"), ratio("injected", w), ratio("baseline", w))]
    return out.select("project", day_text(F.col("day")).alias("day"), *cols)


def silent_days(nodes: DataFrame) -> DataFrame:
    """(project, day): days without any call between a project's first and last day with one.

    The tree is descended from its shards: a node without calls is silent as a whole, of a node with
    calls the children are asked. So a silent stretch costs one row for each node that tiles it.
    """
    live = nodes.where(F.col("calls") > 0).select("project", "level", "idx")
    span = live.where("level = 0").groupBy("project").agg(F.min("idx").alias("a"), F.max("idx").alias("b"))
    tops = F.sequence(F.shiftright("a", TOP), F.shiftright("b", TOP))
    asked = span.select("project", F.lit(TOP).alias("level"), F.explode(tops).alias("idx"))
    halves = F.array(F.col("idx") * 2, F.col("idx") * 2 + 1)
    below = live.where("level > 0").select("project", (F.col("level") - 1).alias("level"), F.explode(halves).alias("idx"))
    silent = asked.union(below).join(live, ["project", "level", "idx"], "left_anti").join(span, "project")
    low = F.greatest("a", F.expr("shiftleft(idx, level)"))
    high = F.least("b", F.expr("shiftleft(idx + 1, level) - 1"))
    inside = silent.select("project", low.alias("low"), high.alias("high")).where("low <= high")
    return inside.select("project", F.explode(F.sequence("low", "high")).alias("day")).select("project", day_text(F.col("day")).alias("day"))
