"""Percentiles per group from merging centroid digests, with rank errors certified by counting.

A digest is a list of centroids (mean, weight) with least and greatest value. Sorted weighted values
are clustered by the unit intervals of k(q) = delta/(2 pi) * asin(2q - 1), so clusters are small at both
ends of the distribution; merging digests is clustering their centroids once more. Digests of separate
days or files combine in any order; here they are built from each input batch's own values and merged by a
reduction tree over the input partitions. A second pass counts all values around each estimate: groups whose
rank error exceeds the bound get finer digests until it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.operators.reduction import FAN_IN, parent, tree_depth
from lorekeep.sources.tables import materialise

DELTA = 1000
#: Greatest rank error of an estimate.
BOUND = 0.001
QUANTILES = (0.5, 0.9, 0.95, 0.99)
_STATE = "means array<double>, weights array<bigint>, low double, high double"
_DIGEST = T.StructType([T.StructField("means", T.ArrayType(T.DoubleType())), T.StructField("weights", T.ArrayType(T.LongType())), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])


def cluster(group: np.ndarray, value: np.ndarray, weight: np.ndarray, delta: int = DELTA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids (group, mean, weight) of weighted values of many groups; groups are small ints."""
    order = np.lexsort((value, group))
    g, v, w = group[order], value[order], weight[order].astype("int64")
    if not len(g):
        return g, v, w
    head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    n = np.diff(np.append(head, len(g)))
    total = np.repeat(np.add.reduceat(w, head), n)
    cum = np.cumsum(w)
    mid = cum - np.repeat(cum[head] - w[head], n) - w / 2
    k = np.floor(delta / (2 * np.pi) * np.arcsin(np.clip(2 * mid / total - 1, -1, 1))).astype("int64")
    first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (k[1:] != k[:-1]))))
    size = np.add.reduceat(w, first)
    return g[first], np.add.reduceat(v * w, first) / size, size


def _digests(keys: pd.DataFrame, codes: np.ndarray, value: np.ndarray, n: np.ndarray, bounds, delta: int) -> pd.DataFrame:
    low = pd.Series(value).groupby(codes).min() if bounds is None else bounds[0]
    high = pd.Series(value).groupby(codes).max() if bounds is None else bounds[1]
    g, mean, weight = cluster(codes, value, n, delta)
    cut = np.flatnonzero(np.diff(g)) + 1
    return keys.assign(means=np.split(mean, cut), weights=np.split(weight, cut), low=low.to_numpy(), high=high.to_numpy())


def _recluster(delta: int) -> Callable:
    @F.pandas_udf(_DIGEST)
    def recluster(means: pd.Series, weights: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        if not len(means):
            return pd.DataFrame({"means": [], "weights": [], "low": [], "high": []})
        codes = np.repeat(np.arange(len(means)), means.map(len).to_numpy())
        value, weight = (np.concatenate(x.to_list()) for x in (means, weights))
        ends = low.reset_index(drop=True), high.reset_index(drop=True)
        return _digests(pd.DataFrame(index=range(len(means))), codes, value, weight, ends, delta)

    return recluster


def merge_digests(digests: DataFrame, keys: Sequence[str], depth: int = 1, delta: int = DELTA) -> DataFrame:
    """One digest (keys..., means, weights, low, high) per group.

    ``digests`` may hold ``part``, the input partition; then they are merged in ``depth`` steps of bounded fan-in.
    """
    state = digests if "part" in digests.columns else digests.withColumn("part", F.lit(0))
    udf = _recluster(delta)
    for _ in range(depth):
        lists = [F.flatten(F.collect_list(c)).alias(a) for c, a in (("means", "m"), ("weights", "w"))]
        many = state.groupBy(*keys, parent()).agg(*lists, F.min("low").alias("a"), F.max("high").alias("b"))
        state = many.select(*keys, "part", udf("m", "w", "a", "b").alias("d")).select(*keys, "part", "d.*")
    return state.drop("part")


def build_digests(values: DataFrame, keys: list[str], delta: int = DELTA) -> DataFrame:
    """Partial digests (keys..., part, means, weights, low, high) of rows (keys..., value), one per group and
    input batch."""
    by = [*keys, "part"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                codes = b.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
                first = b[by].iloc[np.unique(codes, return_index=True)[1]].reset_index(drop=True)
                yield _digests(first, codes, b["value"].to_numpy("float64"), np.ones(len(b), "int64"), None, delta)

    rows = values.select(*keys, F.spark_partition_id().alias("part"), F.col("value").cast("double"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in by)
    return rows.mapInPandas(fold, f"{schema}, {_STATE}")


def _estimates(quantiles: Sequence[float]) -> Callable:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def estimates(means: pd.Series, weights: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        out = []
        for m, w, a, b in zip(means, weights, low, high):
            # the rank asked for, at the middle of its own unit; a centroid stands at the middle of its weight
            cum = np.cumsum(w)
            rank = np.maximum(np.ceil(np.asarray(quantiles) * cum[-1] - 1e-9), 1) - 0.5
            est = np.interp(rank, np.concatenate(([0.0], cum - np.asarray(w) / 2, [cum[-1]])), np.concatenate(([a], m, [b])))
            own = np.searchsorted(cum, rank)
            out.append(np.clip(np.where(np.asarray(w)[own] == 1, np.asarray(m)[own], est), a, b))
        return pd.Series(out)

    return estimates


def measured(events: DataFrame) -> DataFrame:
    """(tool_name, project, value): measured latencies of the distinct calls.

    Rows of one id are one call; a null id is a call of its own. Null and negative latencies were not
    measured and are left out. A null project or tool is a group of its own.
    """
    own = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
    calls = events.where(F.col("latency_ms") >= 0)
    calls = calls.select("id", own.alias("_row"), "tool_name", "project", F.col("latency_ms").alias("value")).distinct()
    return calls.select("tool_name", "project", "value")


def _members(by: Sequence[str]) -> tuple[list[str], Column]:
    """Keys of all levels, and the array of a row's groups: every single column of ``by`` and all together."""
    levels = [[c] for c in by] + [list(by)] * (len(by) > 1)
    null = F.lit(None).cast("string")
    groups = [
        F.struct(F.lit("+".join(x)).alias("level"), *[(F.col(c) if c in x else null).alias(c) for c in by]) for x in levels
    ]
    return ["level", *by], F.explode(F.array(*groups))


def percentiles(
    values: DataFrame, by: Sequence[str], quantiles: Sequence[float] = QUANTILES, bound: float = BOUND, delta: int = DELTA
) -> DataFrame:
    """(by..., level, n, quantile, value, rank_error): percentiles of each group of each level.

    ``values`` holds the columns ``by`` and ``value``. Levels are every single column of ``by`` and all together;
    a column outside a level is null, and ``level`` names its columns. rank_error is exact: the share of the
    group's values between the asked rank and the ranks the returned value has, found by counting all values a
    second time. It never exceeds ``bound``: groups beyond it are estimated again from finer digests.
    """
    values = materialise(values.select(*by, "value"), "values")
    keys, done, wanted = ["level", *by], None, None
    while True:
        result = _attempt(values, by, quantiles, delta, tree_depth(values))
        if wanted is not None:
            result = result.join(wanted, _equal(result, wanted, keys), "left_semi")
        result = materialise(result, "percentiles")
        missed = materialise(result.where(F.col("rank_error") > bound).select(*keys).distinct(), "missed")
        kept = result.join(missed, _equal(result, missed, keys), "left_anti")
        done = kept if done is None else done.unionByName(kept)
        if missed.isEmpty():
            return done
        wanted, delta = missed, delta * 8


def _equal(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> list:
    return [a[c].eqNullSafe(b[c]) for c in cols]


def _attempt(values: DataFrame, by: Sequence[str], quantiles: Sequence[float], delta: int, depth: int) -> DataFrame:
    keys, member = _members(by)
    # the finest groups are built from the values; the others merge from them
    fine = merge_digests(build_digests(values, list(by), delta), by, depth, delta)
    state = ["part", "means", "weights", "low", "high"]
    part = F.pmod(F.hash(*by), F.lit(FAN_IN**2)).alias("part")
    spread = fine.select(member.alias("k"), part, *state[1:]).select("k.*", *state)
    groups = merge_digests(spread, keys, 2, delta)
    asked = groups.select(*keys, _estimates(quantiles)("means", "weights", "low", "high").alias("est"))
    # second pass: how many values lie below and at each estimate, equal values of a finest group counted first
    counted = values.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.select(member.alias("k"), "value", "n").groupBy("k", "value").agg(F.sum("n").alias("n"))
    rows = rows.select("k.*", F.col("value").cast("double"), "n")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    sums = []
    for i in range(len(quantiles)):
        est, n = F.get("a.est", F.lit(i)), F.col("r.n")
        sums.append(F.sum(F.when(F.col("r.value") < est, n).otherwise(0)).alias(f"b{i}"))
        sums.append(F.sum(F.when(F.col("r.value") <= est, n).otherwise(0)).alias(f"u{i}"))
    both = rows.alias("r").join(asked.alias("a"), on)
    count = both.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.est").alias("est"))
    count = count.agg(F.sum("r.n").alias("n"), *sums)
    each = [
        F.struct(
            F.lit(float(q)).alias("quantile"),
            F.get("est", F.lit(i)).alias("value"),
            (F.col(f"b{i}") / F.col("n")).alias("lo"),
            (F.col(f"u{i}") / F.col("n")).alias("hi"),
        )
        for i, q in enumerate(quantiles)
    ]
    flat = count.select(*keys, "n", F.explode(F.array(*each)).alias("e")).select(*keys, "n", "e.*")
    error = F.greatest(F.col("lo") - F.col("quantile"), F.col("quantile") - F.col("hi"), F.lit(0.0))
    return flat.select(*keys, "n", "quantile", "value", F.round(error, 9).alias("rank_error"))
