import datetime as dt
import random

from pyspark.sql import functions as F

from lorekeep.operators import rolling

SCHEMA = "id bigint, ts string, project string, tokens_injected int, tokens_baseline int, day string, calls int, level int"


def table(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)


def nodes(df):
    return rolling.segment_nodes(rolling.daily_leaves(df))


def test_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        day = dt.datetime(2025, 12, 20, tzinfo=dt.UTC) + dt.timedelta(days=rnd.choice([0, 1, 2, 40, 63, 64, 65, 130]), seconds=rnd.randrange(86400))
        rows.append((i, day.isoformat(), rnd.choice(["a", "b"]), rnd.choice([None, 5, 7]), rnd.choice([None, 11])))
    rows += rows[:50]  # copies
    got = {(r.project, r.day): r for r in rolling.rolling_totals(nodes(table(spark, rows)), (7, 30, 200)).collect()}
    once = {r[0]: r for r in rows}.values()
    days = {}
    for _, ts, p, i, b in once:
        days.setdefault(p, {}).setdefault(dt.date.fromisoformat(ts[:10]), []).append((i, b))
    for p, own in days.items():
        d = min(own)
        while d <= max(own):
            r = got.pop((p, d.isoformat()))
            for w in (7, 30, 200):
                calls = [c for k in range(w) for c in own.get(d - dt.timedelta(days=k), [])]
                i = [c[0] for c in calls if c[0] is not None]
                assert r[f"calls_{w}d"] == len(calls) and r[f"injected_{w}d"] == sum(i)
                assert r[f"avg_injected_{w}d"] == (round(sum(i) / len(i), 6) if i else None)
            d += dt.timedelta(days=1)
    assert not got


def test_corrections_write_ancestors_only_and_equal_a_rebuild(spark, tmp_path):
    early = [(i, f"2026-01-{1 + i % 9:02d}T10:00:00Z", "a", i, 1) for i in range(20)]
    late = [(100 + i, f"2026-01-{1 + i:02d}T10:00:00Z", "a", 3, None) for i in range(2)]
    path = str(tmp_path / "tree")
    rolling.write_nodes(nodes(table(spark, early)), path)
    stored = spark.read.parquet(path).count()
    rolling.apply_corrections(path, rolling.daily_leaves(table(spark, late)))
    day = dt.date(2026, 1, 1).toordinal() - dt.date(1970, 1, 1).toordinal()
    ancestors = {(level, (day + k) >> level) for k in range(2) for level in range(rolling.TOP + 1)}
    assert spark.read.parquet(path).count() - stored == len(ancestors)
    whole = nodes(table(spark, early + late))
    key = ["project", "level", "idx", *rolling.SUMS]
    fixed = rolling.read_nodes(spark, path)
    assert sorted(map(tuple, fixed.select(key).collect())) == sorted(map(tuple, whole.select(key).collect()))
    # calls taken away leave silent days behind
    rolling.apply_corrections(path, rolling.daily_leaves(table(spark, early)).where("day % 3 = 0").select("project", "day", *[(-F.col(c)).alias(c) for c in rolling.SUMS]))
    again = rolling.read_nodes(spark, path)
    silent = {r.day for r in rolling.silent_days(again).collect()}
    live = {(dt.date(1970, 1, 1) + dt.timedelta(days=r.idx)).isoformat() for r in again.where("level = 0 and calls > 0").collect()}
    span = [dt.date.fromisoformat(min(live)) + dt.timedelta(days=i) for i in range(9)]
    assert silent == {d.isoformat() for d in span if d.isoformat() < max(live)} - live and silent


def test_nulls_and_unreadable(spark):
    rows = [(None, "2026-01-01", "a", 1, 1), (None, "2026-01-01 10:00:00", "a", 1, 1), (1, "n/a", "a", 1, 1), (2, None, "a", 1, 1), (3, "2026-01-03T00:30:00+01:00", "a", None, None), (4, "2026-01-02", None, 1, 1)]
    got = {r.day: r for r in rolling.rolling_totals(nodes(table(spark, rows)), (7,)).collect()}
    assert list(sorted(got)) == ["2026-01-01", "2026-01-02"] and got["2026-01-01"].calls_7d == 2 and got["2026-01-02"].calls_7d == 3
    assert rolling.silent_days(nodes(table(spark, rows))).count() == 0


def test_empty(spark):
    assert rolling.rolling_totals(nodes(table(spark, [])), (7,)).count() == 0
    assert rolling.silent_days(nodes(table(spark, []))).count() == 0


def test_day_is_utc_in_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = [(1, "2026-01-01 00:10:00", "a", 1, 1), (2, "2026-01-03T23:50:00-05:00", "a", 1, 1)]
        assert [r.day for r in rolling.silent_days(nodes(table(spark, rows))).orderBy("day").collect()] == ["2026-01-02", "2026-01-03"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_range_nodes_tile_the_range(spark):
    df = spark.range(60).select((F.col("id") - 20).cast("int").alias("lo"), (F.col("id") * 3).cast("int").alias("hi")).where("lo <= hi")
    for r in df.select("lo", "hi", rolling.range_nodes(F.col("lo"), F.col("hi")).alias("n")).collect():
        covered = sorted(d for x in r.n for d in range(x.idx << x.level, (x.idx + 1) << x.level))
        assert covered == list(range(r.lo, r.hi + 1))
