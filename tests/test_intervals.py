import random

import numpy as np
import pytest

from lorekeep.operators import intervals

ROWS = "from_entity string, relation_type string, qualifiers map<string,string>, shard int, salt int, s string"


def table(spark, rows):
    return spark.createDataFrame([(a, t, q, 1, 2, "x") for a, t, q in rows], ROWS)


def gaps(df):
    return sorted((tuple(r) for r in intervals.gaps(intervals.validity_rows(df), ["from_entity", "relation_type"]).collect()), key=repr)


def q(f=None, t=None):
    return {k: v for k, v in (("valid_from", f), ("valid_to", t)) if v is not None}


def test_bounds(spark):
    rows = [
        ("a", "x", q("2026-01-01", "2026-01-02")),
        ("a", "x", q("2026-01-02T12:00:00Z", "2026-01-03")),  # overlaps
        ("a", "x", q("2026-01-04", "2026-01-04")),  # touches
        ("a", "x", q("2026-01-06 00:00:01", "")),  # gap before, open end
        ("a", "x", q("2027-01-01", "2027-01-02")),  # inside the open one
        ("a", "x", q("", " ")),
        ("a", "x", q("soon", "2030-01-01")),
        ("a", "x", q("2026-01-05", "2026-01-04")),  # ends before it starts
        ("a", "x", None),
    ]
    assert gaps(table(spark, rows)) == [("a", "x", "2026-01-05T00:00:00Z", "2026-01-06T00:00:00Z")]
    p = intervals.periods(intervals.validity_rows(table(spark, rows)), ["from_entity", "relation_type"]).collect()
    assert sorted((r.period_from, r.period_to) for r in p if r.period_to) == [("2026-01-01T00:00:00Z", "2026-01-04T23:59:59Z")]
    assert [r.period_from for r in p if r.period_to is None] == ["2026-01-06T00:00:01Z"]


def test_offsets_copies_null_keys(spark):
    rows = [(None, "x", q("2026-01-01T01:00:00+02:00", "2026-01-01T01:00:00+02:00")), (None, "x", q("2026-01-01 00:00:00", "2026-01-02"))] * 3
    assert gaps(table(spark, rows)) == [(None, "x", "2025-12-31T23:00:01Z", "2025-12-31T23:59:59Z")]


def test_empty(spark):
    assert gaps(table(spark, [])) == []


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    """Many shards and long intervals over them, against a sweep."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(600):
        s = rnd.randrange(0, 60 << 20)
        rows.append((rnd.choice("ab"), s, s + rnd.choice([0, 1, 1000, 1 << 18, 1 << 20, 5 << 20])))
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint").repartition(5)
    got = {(r.k, r.period_from, r.period_to) for r in intervals.periods(df, ["k"]).collect()}
    holes = {(r.k, r.gap_from, r.gap_to) for r in intervals.gaps(df, ["k"]).collect()}
    stamp = lambda x: str(np.datetime64(x, "s")) + "Z"
    exp, empty = set(), set()
    for k in "ab":
        at = None
        for s, e in sorted((s, e) for c, s, e in rows if c == k):
            if at is None:
                at = [s, e]
            elif s <= at[1] + 1:
                at[1] = max(at[1], e)
            else:
                exp.add((k, stamp(at[0]), stamp(at[1])))
                empty.add((k, stamp(at[1] + 1), stamp(s - 1)))
                at = [s, e]
        exp.add((k, stamp(at[0]), stamp(at[1])))
    assert got == exp and holes == empty


def test_merge_is_associative():
    rnd = np.random.default_rng(1)
    s = rnd.integers(0, 1000, 200)
    e = s + rnd.integers(0, 9, 200)
    zero = np.zeros(200, "int64")
    whole = intervals.union_runs(zero, s, e)
    a, b = intervals.union_runs(zero[:90], s[:90], e[:90]), intervals.union_runs(zero[90:], s[90:], e[90:])
    both = intervals.union_runs(*(np.concatenate(x) for x in zip(a, b)))
    assert all((x == y).all() for x, y in zip(whole, both))
