"""Union and gaps of validity periods: a mergeable list of disjoint intervals.

The aggregate's state is a sorted list of disjoint [start, end] seconds. A list belongs to one key and
one time shard (2^20 seconds, some 12 days, by an interval's start), so it never holds more than half a
million entries, however many rows a key has. Partial lists are made inside each input batch and merged
by a reduction tree over the input partitions, at most FAN_IN partitions a step; at its root only each
shard's greatest end passes on to the key's later shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.time import seconds_text, utc_seconds
from lorekeep.operators.reduction import parent, tree_depth

#: First and last second that can be written as a date; they stand for an open bound.
FIRST, LAST = -62135596800, 253402300799
SHARD_BITS = 20
SPAN = 1 << 39
LISTS = "starts array<bigint>, ends array<bigint>"


def union_runs(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint intervals of each group, sorted; touching seconds join. Groups are small ints from 0."""
    if not len(start):
        return group, start, end
    # partial lists are sorted runs, which a stable sort merges in linear time
    order = np.argsort(group * SPAN + (start - FIRST), kind="stable")
    g, s, e = group[order], start[order], end[order]
    reach = np.maximum.accumulate(g * SPAN + (e - FIRST))  # greatest end so far within the group
    head = np.ones(len(g), bool)
    head[1:] = g[1:] * SPAN + (s[1:] - FIRST) > reach[:-1] + 1
    head[1:] |= g[1:] != g[:-1]
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(g)) - 1
    return g[first], s[first], reach[last] - g[first] * SPAN + FIRST


def validity_rows(relations: DataFrame) -> DataFrame:
    """(from_entity, relation_type, s, e) in epoch seconds from ``qualifiers``.

    A missing, null or blank bound is open. Rows without both bounds, with an unreadable bound, or
    ending before they start are ignored; so are rows with a null map.
    """
    raw = lambda k: F.nullif(F.trim(F.try_element_at(F.col("qualifiers"), F.lit(k))), F.lit(""))
    q = relations.select("from_entity", "relation_type", raw("valid_from").alias("f"), raw("valid_to").alias("t"))
    q = q.where(F.col("f").isNotNull() | F.col("t").isNotNull())
    q = q.withColumn("s", F.when(F.col("f").isNull(), F.lit(FIRST)).otherwise(utc_seconds(F.col("f"))))
    q = q.withColumn("e", F.when(F.col("t").isNull(), F.lit(LAST)).otherwise(utc_seconds(F.col("t"), end_of_day=True)))
    return q.where(F.col("s").isNotNull() & F.col("e").isNotNull() & (F.col("s") <= F.col("e"))).select("from_entity", "relation_type", "s", "e")


def _lists(keys: pd.DataFrame, g: np.ndarray, s: np.ndarray, e: np.ndarray) -> pd.DataFrame:
    cut = np.flatnonzero(np.diff(g)) + 1
    out = keys.iloc[g[np.concatenate(([0], cut))]].reset_index(drop=True)
    return out.assign(starts=np.split(s, cut), ends=np.split(e, cut))


@F.pandas_udf(T.StructType([T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType()))]))
def merge_lists(starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """Merge the concatenated partial lists of each row into one disjoint list."""
    if not len(starts):
        return pd.DataFrame({"starts": [], "ends": []})
    n = starts.map(len).to_numpy()
    rows = pd.DataFrame(index=range(len(n)))
    g, s, e = union_runs(np.repeat(np.arange(len(n)), n), np.concatenate(starts.to_list()).astype("int64"), np.concatenate(ends.to_list()).astype("int64"))
    return _lists(rows, g, s, e)[["starts", "ends"]]


def disjoint_lists(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., shard, starts, ends): the merged list of each key and time shard.

    ``rows`` holds the keys and bigint ``s <= e`` within FIRST..LAST. Null keys form a group of
    their own. Rows repeated or nested change nothing.
    """
    at = [*keys, "shard"]
    by = [*at, "part"]

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                codes = b.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
                firsts = b[by].iloc[np.unique(codes, return_index=True)[1]].reset_index(drop=True)
                yield _lists(firsts, *union_runs(codes, b["s"].to_numpy(), b["e"].to_numpy()))

    shard = F.shiftright("s", SHARD_BITS).cast("int").alias("shard")
    cut = rows.select(*keys, shard, F.spark_partition_id().alias("part"), "s", "e")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name in by)
    state = cut.mapInPandas(combine, f"{schema}, {LISTS}")
    for _ in range(tree_depth(rows)):
        both = state.groupBy(*at, parent()).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")])
        state = both.select(*by, merge_lists("starts", "ends").alias("m")).select(*by, "m.*")
    return state.drop("part")


_MARKS = T.StructType([T.StructField(n, T.ArrayType(T.LongType())) for n in ("gap_from", "gap_to", "begun", "closed")])


@F.pandas_udf(_MARKS)
def _marks(carry: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """Gaps before and between a shard's intervals, given the greatest end of earlier shards.

    ``begun`` are the starts of continuous periods in this shard, ``closed`` the ends of all but the
    last of them.
    """
    out = []
    for c, s, e in zip(carry, starts, ends):
        s, e = np.asarray(s, "int64"), np.asarray(e, "int64")
        first = c is None or c != c
        before = np.concatenate(([FIRST - 2 if first else int(c)], e[:-1]))
        before = np.maximum.accumulate(before)
        gap = s > before + 1
        gap[0] &= not first
        lo, hi = before[gap] + 1, s[gap] - 1
        begun = np.concatenate((s[:1], hi + 1)) if first else hi + 1
        out.append((lo, hi, begun, (lo if first else lo[1:]) - 1))
    return pd.DataFrame(out, columns=[f.name for f in _MARKS])


def _same(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cols]
    return a.alias("a").join(b.alias("b"), on, "left")


def shard_marks(lists: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps and period starts of each (key, shard), with what came before it taken into account."""
    at = [*keys, "shard"]
    tops = lists.select(*at, F.element_at("ends", -1).alias("top"))
    earlier = Window.partitionBy(*keys).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(*at, F.max("top").over(earlier).alias("carry"))
    both = _same(lists, carry, at).select(*[F.col(f"a.{c}").alias(c) for c in at], "b.carry", "a.starts", "a.ends")
    return both.select(*at, F.greatest(F.coalesce("carry", F.lit(FIRST)), F.element_at("ends", -1)).alias("top"), _marks("carry", "starts", "ends").alias("m")).select(*at, "top", "m.*")


def gaps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., gap_from, gap_to): longest uncovered runs between covered seconds, as UTC texts."""
    marks = shard_marks(disjoint_lists(rows, keys), keys)
    each = marks.select(*keys, F.explode(F.arrays_zip("gap_from", "gap_to")).alias("g"))
    return each.select(*keys, seconds_text(F.col("g.gap_from")).alias("gap_from"), seconds_text(F.col("g.gap_to")).alias("gap_to"))


def periods(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., period_from, period_to): the continuous periods; null means open on that side."""
    at = [*keys, "shard"]
    marks = shard_marks(disjoint_lists(rows, keys), keys)
    # from the last shard backwards, so that the next gap and the greatest end are running values
    later = Window.partitionBy(*keys).orderBy(F.desc("shard")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(F.desc("shard")).rowsBetween(Window.unboundedPreceding, 0)
    first = marks.select(*at, F.get("gap_from", F.lit(0)).alias("g"), "top")
    ends = first.select(*at, F.coalesce(F.min("g").over(later) - 1, F.max("top").over(upto)).alias("final"))
    both = _same(marks.where(F.size("begun") > 0), ends, at)
    closed = F.concat("a.closed", F.array("b.final")).alias("closed")
    both = both.select(*[F.col(f"a.{c}").alias(c) for c in keys], "a.begun", closed)
    each = both.select(*keys, F.explode(F.arrays_zip("begun", "closed")).alias("p"))
    return each.select(
        *keys,
        F.when(F.col("p.begun") > FIRST, seconds_text(F.col("p.begun"))).alias("period_from"),
        F.when(F.col("p.closed") < LAST, seconds_text(F.col("p.closed"))).alias("period_to"),
    )
