"""Queries of the core problems 2 (rolling totals) and 5 (time intervals)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import intervals, rolling
from lorekeep.sources.tables import scratch_path, table


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return rolling.segment_nodes(rolling.daily_leaves(table(spark, d, "telemetry_events")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rolling.silent_days(_nodes(spark, d))


def p2_rolling(spark: SparkSession, d: str) -> DataFrame:
    return rolling.rolling_totals(_nodes(spark, d), (7, 30))


def p2_corrected(spark: SparkSession, d: str) -> DataFrame:
    """``p2_rolling`` of a stored tree: the last tenth of the ids arrives after the tree was written, late calls
    among them, and is added as corrections."""
    events = table(spark, d, "telemetry_events")
    cut = events.agg((F.max("id") * 0.9).alias("cut"))
    dated = events.crossJoin(F.broadcast(cut)).withColumn("last", F.coalesce(F.col("id") > F.col("cut"), F.lit(False)))
    path = scratch_path(spark, "nodes")
    rolling.write_nodes(rolling.segment_nodes(rolling.daily_leaves(dated.where("not last"))), path)
    rolling.apply_corrections(path, rolling.daily_leaves(dated.where("last")))
    return rolling.rolling_totals(rolling.read_nodes(spark, path), (7, 30))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.gaps(intervals.validity_rows(table(spark, d, "relations")), ["from_entity", "relation_type"])


def p5_periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods(intervals.validity_rows(table(spark, d, "relations")), ["from_entity", "relation_type"])


# DuckDB's own reading of the spellings: an instant without an offset is UTC.
_SECONDS = """
CASE WHEN regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN epoch(try_cast({x} || 'T00:00:00Z' AS TIMESTAMPTZ)) + {late}
     WHEN regexp_matches({x}, '[T ][0-9:.]+(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') THEN floor(epoch(try_cast({x} AS TIMESTAMPTZ)))
     WHEN regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9:.]+$') THEN floor(epoch(try_cast({x} || 'Z' AS TIMESTAMPTZ))) END"""


def _sec(x: str, late: int = 0) -> str:
    return _SECONDS.format(x=x, late=late)


_DAYS = f"""
WITH calls AS (SELECT DISTINCT id, project, CAST(floor(({_sec("ts")}) / 86400) AS BIGINT) AS day, tokens_injected AS i, tokens_baseline AS b FROM telemetry_events),
day AS (SELECT project, day, count(*) AS calls, coalesce(sum(i), 0) AS si, count(i) AS ni, coalesce(sum(b), 0) AS sb, count(b) AS nb
        FROM calls WHERE project IS NOT NULL AND day IS NOT NULL GROUP BY ALL),
cal AS (SELECT project, unnest(range(min(day), max(day) + 1)) AS day FROM day GROUP BY project)"""

_WINDOW = """
    CAST(sum(calls) OVER w{n} AS BIGINT) AS calls_{n}d, CAST(sum(si) OVER w{n} AS BIGINT) AS injected_{n}d, CAST(sum(sb) OVER w{n} AS BIGINT) AS baseline_{n}d,
    round(CASE WHEN sum(ni) OVER w{n} > 0 THEN sum(si) OVER w{n} / sum(ni) OVER w{n} END, 6) AS avg_injected_{n}d,
    round(CASE WHEN sum(nb) OVER w{n} > 0 THEN sum(sb) OVER w{n} / sum(nb) OVER w{n} END, 6) AS avg_baseline_{n}d"""

_ROWS = f"""
WITH r AS (SELECT from_entity, relation_type, nullif(trim(qualifiers['valid_from']), '') AS f, nullif(trim(qualifiers['valid_to']), '') AS t FROM relations),
v AS (SELECT from_entity, relation_type,
        CASE WHEN f IS NULL THEN -62135596800 ELSE CAST({_sec("f")} AS BIGINT) END AS s,
        CASE WHEN t IS NULL THEN 253402300799 ELSE CAST({_sec("t", 86399)} AS BIGINT) END AS e
      FROM r WHERE f IS NOT NULL OR t IS NOT NULL),
o AS (SELECT *, max(e) OVER (PARTITION BY from_entity, relation_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c
      FROM v WHERE s <= e)"""

_STAMP = "strftime(make_timestamp(({x}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"

QUERIES = {"p2_found": p2_found, "p2_rolling": p2_rolling, "p2_corrected": p2_corrected, "p5_found": p5_found, "p5_periods": p5_periods}

SQL = {
    "p2_found": f"""{_DAYS}
SELECT project, strftime(DATE '1970-01-01' + CAST(cal.day AS INTEGER), '%Y-%m-%d') AS day FROM cal ANTI JOIN day USING (project, day)""",
    "p2_rolling": f"""{_DAYS}, f AS (SELECT * FROM cal LEFT JOIN day USING (project, day))
SELECT project, strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS day,{_WINDOW.format(n=7)},{_WINDOW.format(n=30)}
FROM (SELECT project, day, coalesce(calls, 0) AS calls, coalesce(si, 0) AS si, coalesce(ni, 0) AS ni, coalesce(sb, 0) AS sb, coalesce(nb, 0) AS nb FROM f)
WINDOW w7 AS (PARTITION BY project ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY project ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    "p5_found": f"""{_ROWS}
SELECT from_entity, relation_type, {_STAMP.format(x="c + 1")} AS gap_from, {_STAMP.format(x="s - 1")} AS gap_to FROM o WHERE s > c + 1""",
    "p5_periods": f"""{_ROWS}, g AS (SELECT *, sum(CASE WHEN c IS NULL OR s > c + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY from_entity, relation_type ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM o),
p AS (SELECT from_entity, relation_type, n, min(s) AS s, max(e) AS e FROM g GROUP BY ALL)
SELECT from_entity, relation_type, CASE WHEN s > -62135596800 THEN {_STAMP.format(x="s")} END AS period_from,
  CASE WHEN e < 253402300799 THEN {_STAMP.format(x="e")} END AS period_to FROM p""",
}
SQL["p2_corrected"] = SQL["p2_rolling"]  # as if all calls had been there from the start
