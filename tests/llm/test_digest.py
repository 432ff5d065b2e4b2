import random

import numpy as np
from pyspark.sql import functions as F

from lorekeep.llm import digest

EVENT = "id bigint, tool_name string, project string, latency_ms int, n int, level string, value int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 8) for r in rows], EVENT)


def test_ranks_are_certified(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice("ab"), rnd.choice("pqr"), int(rnd.lognormvariate(4, 1.5))) for i in range(20000)]
    got = digest.percentiles(digest.measured(table(spark, rows + rows[:500])), ["tool_name", "project"]).collect()
    assert len(got) == 4 * (2 + 3 + 6) and max(r.rank_error for r in got) < 0.005
    for r in got:
        own = np.sort([x[3] for x in rows if r.tool_name in (None, x[1]) and r.project in (None, x[2])])
        assert r.n == len(own)
        low, high = np.searchsorted(own, r.value) / len(own), np.searchsorted(own, r.value, "right") / len(own)
        assert abs(max(low - r.quantile, r.quantile - high, 0) - r.rank_error) < 1e-6


def test_bound_is_kept_by_finer_digests(spark):
    rnd = random.Random(4)
    rows = [(i, "a" if i % 3 else "b", "p", int(rnd.lognormvariate(12, 2))) for i in range(6000)]
    values = digest.measured(table(spark, rows))
    got = digest.percentiles(values, ["tool_name", "project"], (0.25, 0.5, 0.9), bound=0.0005, delta=8).collect()
    assert len(got) == 3 * (2 + 1 + 2) and max(r.rank_error for r in got) <= 0.0005
    for r in got:
        assert r.n == sum(r.tool_name in (None, x[1]) for x in rows)


def test_parts_combine_in_any_order(spark):
    rnd = random.Random(2)
    rows = spark.createDataFrame([("g", i % 5, float(int(rnd.gauss(500, 90))), 1) for i in range(5000)], "k string, day int, value double, n int")
    days = [digest.merge_digests(digest.build_digests(rows.where(F.col("day") == d), ["k"]), ["k"]) for d in range(5)]
    for order in ([0, 1, 2, 3, 4], [4, 2, 0, 3, 1]):
        both = days[order[0]]
        for d in order[1:]:
            both = both.unionByName(days[d])
        r = digest.merge_digests(both, ["k"]).first()
        assert sum(r.weights) == 5000 and len(r.means) < digest.DELTA
        at = np.interp(2500, np.cumsum(r.weights) - np.array(r.weights) / 2, r.means)
        values = np.sort([x.value for x in rows.select("value").collect()])
        assert abs(np.searchsorted(values, at) / 5000 - 0.5) < 0.01


def test_edges(spark):
    rows = [(1, "t", "p", 5), (1, "t", "p", 5), (2, "t", None, None), (3, "t", None, -1), (None, "t", None, 7), (None, "t", None, 7), (4, None, "p", 2**31 - 1), (5, "t", "p", 0)]
    got = {(r.level, r.tool_name, r.project): (r.n, r.value, r.rank_error) for r in digest.percentiles(digest.measured(table(spark, rows)), ["tool_name", "project"], (0.5,)).collect()}
    assert got[("tool_name", "t", None)] == (4, 5.0, 0) and got[("tool_name", None, None)] == (1, 2.0**31 - 1, 0) and got[("project", None, None)][:2] == (2, 7.0)
    assert digest.percentiles(digest.measured(table(spark, [])), ["tool_name", "project"]).count() == 0
