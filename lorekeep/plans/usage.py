"""Telemetry and session queries over the tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import evaluate, learn, sessions, telemetry, verify
from lorekeep.plans.problems import _sec
from lorekeep.sources.tables import table

AS_OF = "2026-07-04T00:00:00Z"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.distinct_calls(table(spark, d, "telemetry_events"))


def usage_stats(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.savings(telemetry.usage_stats(_calls(spark, d)))


def usage_last_30_days(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.savings(telemetry.usage_stats(telemetry.since(_calls(spark, d), AS_OF, 30), ["project"]))


def usage_by_project(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.savings(telemetry.usage_stats(_calls(spark, d), ["project"]))


def savings_by_tool(spark: SparkSession, d: str) -> DataFrame:
    s = telemetry.savings(telemetry.usage_stats(_calls(spark, d), ["tool_name"]))
    return s.select("tool_name", "calls", "injected", "baseline", "saved", "saved_pct", telemetry.short_number(F.col("saved")).alias("saved_short"))


def raw_events_latest(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.latest_calls(_calls(spark, d))


def entity_reuse(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.entity_reuse(_calls(spark, d), AS_OF)


def consolidate_reuse(spark: SparkSession, d: str) -> DataFrame:
    ends = table(spark, d, "relations").select(F.explode(F.array("from_entity", "to_entity")).alias("entity_id"))
    return telemetry.consolidate(entity_reuse(spark, d), ends.groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree")))


def distinct_projects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "telemetry_events").where("project is not null").select("project").distinct()


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.nearest_rank(_calls(spark, d).where("latency_ms >= 0"), ["tool_name"], "latency_ms")


def vog_auc(spark: SparkSession, d: str) -> DataFrame:
    return learn.auc(_calls(spark, d), "vog_score", "was_hallucination_blocked", ["tool_name"])


def _entries(spark: SparkSession, d: str) -> DataFrame:
    c = _calls(spark, d).where("session_id is not null and session_id <> '' and sec is not null")
    summary = F.concat_ws(" ", "tool_name", "llm_preset")
    return c.select("project", "session_id", F.col("id").alias("pos"), F.date_format(F.timestamp_seconds("sec"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "tool_name", summary.alias("summary"), F.lit(1).alias("repeat_count"))


_BY = ["project", "session_id"]


def session_entries(spark: SparkSession, d: str) -> DataFrame:
    return sessions.normalise_entries(_entries(spark, d), _BY)


def session_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two replicas of the log: the even and the odd calls, and the latest third on both."""
    e = _entries(spark, d)
    return sessions.merge_sessions([e.where("pos % 2 = 0 or pos % 3 = 0"), e.where("pos % 2 = 1")], _BY).select(*_BY, "fingerprint", "repeat_count", "ts", "pos")


def session_prep(spark: SparkSession, d: str) -> DataFrame:
    p = sessions.prepare_sessions(session_entries(spark, d), _BY)
    return p.select(*_BY, "kept", "total_repeats", "max_repeat", F.array_join("summaries", " | ").alias("summaries"))


def session_text(spark: SparkSession, d: str) -> DataFrame:
    return sessions.session_text(session_entries(spark, d), _BY)


def last_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = session_entries(spark, d).groupBy(*_BY).agg(F.max("last_seen_at").alias("updated_at"), F.sum("repeat_count").alias("calls"))
    return sessions.newest_sessions(s.where("project is not null"), 20)


def inference_inputs(spark: SparkSession, d: str) -> DataFrame:
    texts = session_text(spark, d).where("project is not null")
    return verify.inference_inputs(texts, table(spark, d, "entities").select("project", "name"))


def shadow_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Words of each project's 20 most similar chunks: what a plain top-k retrieval would inject."""
    from lorekeep.operators.lexical import top_k

    c = table(spark, d, "chunks").where("similarity is not null and text is not null").groupBy("project", "id").agg(F.max("similarity").alias("similarity"), F.min("text").alias("text"))
    best = top_k(c, 20, ["project"], "similarity", "id")
    words = F.size(F.regexp_extract_all("text", F.lit("[^ \\t\\r\\n]+"), F.lit(0)))
    return best.groupBy("project").agg(F.count(F.lit(1)).alias("chunks"), F.sum(words).alias("tokens"))


QUERIES = {
    f.__name__: f
    for f in (usage_stats, usage_last_30_days, usage_by_project, savings_by_tool, raw_events_latest, entity_reuse, consolidate_reuse, distinct_projects, latency_percentiles, vog_auc, session_entries, session_merge, session_prep, session_text, last_sessions, inference_inputs, shadow_baseline)
}

_CALLS = f"c AS (SELECT *, CAST({_sec('ts')} AS BIGINT) AS sec FROM (SELECT DISTINCT ON (id) * FROM telemetry_events))"
_AT = "1783123200"


def _stats(by: str = "", where: str = "", more: str = "") -> str:
    key = f"{by}, " if by else ""
    return f"""WITH {_CALLS}, s AS (SELECT {key}count(*) AS calls, CAST(coalesce(sum(tokens_injected), 0) AS BIGINT) AS injected, CAST(coalesce(sum(tokens_baseline), 0) AS BIGINT) AS baseline,
  CAST(coalesce(sum(chunks_total), 0) AS BIGINT) AS chunks, CAST(coalesce(sum(chunks_rejected_srmkg), 0) + coalesce(sum(chunks_rejected_vog), 0) AS BIGINT) AS rejected,
  CAST(coalesce(sum(cross_project_hit), 0) AS BIGINT) AS cross_project, CAST(coalesce(sum(was_hallucination_blocked), 0) AS BIGINT) AS blocked, round(avg(vog_score), 6) AS avg_vog,
  coalesce(string_agg(DISTINCT llm_preset, ',' ORDER BY llm_preset), '') AS presets, min(sec) AS first_sec, max(sec) AS last_sec FROM c {where} {"GROUP BY " + by if by else ""})
SELECT *, greatest(baseline - injected, 0) AS saved, CASE WHEN baseline > 0 THEN round(100 * greatest(baseline - injected, 0) / baseline, 1) ELSE 0 END AS saved_pct FROM s"""


_REUSE = f"""{_CALLS},
ent AS (SELECT project, coalesce(session_id, '') AS session, sec, unnest(CAST(json_extract_string(try_cast(metadata_json AS JSON), '$.entities[*]') AS VARCHAR[])) AS entity_id FROM c),
reuse AS (SELECT project, entity_id, count(DISTINCT session) AS sessions, count(*) AS touches, round(({_AT} - max(sec)) / 86400, 4) AS days_since FROM ent WHERE entity_id IS NOT NULL GROUP BY ALL)"""
_ENTRIES = f"""{_CALLS},
e AS (SELECT project, session_id, id AS pos, strftime(make_timestamp(sec * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS ts, tool_name, concat_ws(' ', tool_name, llm_preset) AS summary, 1 AS repeat_count
      FROM c WHERE session_id IS NOT NULL AND session_id <> '' AND sec IS NOT NULL)"""
_NORM = """SELECT project, session_id, sha256(summary)[1:16] AS fingerprint, arg_max(tool_name, pos) AS tool_name, min(summary) AS summary, CAST(sum(repeat_count) AS BIGINT) AS repeat_count, max(ts) AS ts,
  arg_max(ts, pos) AS last_seen_at, min(pos) AS pos FROM {src} WHERE summary <> '' GROUP BY project, session_id, sha256(summary)[1:16]"""

SQL = {
    "usage_stats": _stats(),
    "usage_last_30_days": _stats("project", f"WHERE sec > {_AT} - 30 * 86400 AND sec <= {_AT}"),
    "usage_by_project": _stats("project"),
    "savings_by_tool": f"""SELECT tool_name, calls, injected, baseline, saved, saved_pct,
CASE WHEN saved >= 1000000 THEN printf('%.2fM', saved / 1000000) WHEN saved >= 1000 THEN printf('%.1fK', saved / 1000) ELSE CAST(saved AS VARCHAR) END AS saved_short FROM ({_stats("tool_name")})""",
    "raw_events_latest": f"WITH {_CALLS} SELECT id, ts, project, tool_name, session_id, tokens_injected, tokens_baseline, vog_score, latency_ms FROM c WHERE sec IS NOT NULL ORDER BY sec DESC, id DESC LIMIT 500",
    "entity_reuse": f"WITH {_REUSE} SELECT * FROM reuse",
    "consolidate_reuse": f"""WITH {_REUSE}, deg AS (SELECT entity_id, count(*) AS degree FROM (SELECT from_entity AS entity_id FROM relations UNION ALL SELECT to_entity FROM relations) GROUP BY 1),
r AS (SELECT reuse.*, greatest(coalesce(degree, 1), 1) AS degree, CASE WHEN sessions >= 2 THEN 'boost' WHEN sessions = 1 AND days_since > 14 THEN 'decay' ELSE 'none' END AS action FROM reuse LEFT JOIN deg USING (entity_id))
SELECT project, entity_id, action, round(CASE action WHEN 'boost' THEN tanh(sessions / 5) * 0.02 / sqrt(degree) WHEN 'decay' THEN -0.05 * (1 - exp(-(days_since - 14) / 14)) ELSE 0 END, 6) AS delta FROM r""",
    "distinct_projects": "SELECT DISTINCT project FROM telemetry_events WHERE project IS NOT NULL",
    "latency_percentiles": f"""WITH {_CALLS}, r AS (SELECT tool_name, latency_ms, row_number() OVER (PARTITION BY tool_name ORDER BY latency_ms) AS i, count(*) OVER (PARTITION BY tool_name) AS n FROM c WHERE latency_ms >= 0)
SELECT tool_name, max(n) AS n, min(latency_ms) FILTER (i >= ceil(n * 50 / 100)) AS p50, min(latency_ms) FILTER (i >= ceil(n * 95 / 100)) AS p95 FROM r GROUP BY tool_name""",
    "vog_auc": f"""WITH {_CALLS}, s AS (SELECT tool_name, vog_score AS x, was_hallucination_blocked = 1 AS pos, rank() OVER (PARTITION BY tool_name ORDER BY vog_score) + (count(*) OVER (PARTITION BY tool_name, vog_score) - 1) / 2 AS r
FROM c WHERE vog_score IS NOT NULL AND was_hallucination_blocked IS NOT NULL), t AS (SELECT tool_name, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg, sum(r) FILTER (pos) AS u FROM s GROUP BY tool_name)
SELECT tool_name, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN round((u - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) END AS auc FROM t""",
    "session_entries": f"WITH {_ENTRIES} {_NORM.format(src='e')}",
    "session_merge": f"""WITH {_ENTRIES}, m AS (SELECT * FROM e WHERE pos % 2 = 0 OR pos % 3 = 0 UNION ALL SELECT * FROM e WHERE pos % 2 = 1), n AS ({_NORM.format(src="m")})
SELECT project, session_id, fingerprint, repeat_count, ts, pos FROM n QUALIFY row_number() OVER (PARTITION BY project, session_id ORDER BY pos DESC, fingerprint DESC) <= 50""",
    "session_prep": f"""WITH {_ENTRIES}, n AS ({_NORM.format(src="e")})
SELECT project, session_id, count(*) AS kept, CAST(sum(repeat_count) AS BIGINT) AS total_repeats, max(repeat_count) AS max_repeat, string_agg(summary, ' | ' ORDER BY repeat_count DESC, fingerprint) AS summaries
FROM n WHERE repeat_count >= 2 GROUP BY project, session_id""",
    "session_text": f"""WITH {_ENTRIES}, n AS ({_NORM.format(src="e")}), l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY project, session_id ORDER BY pos DESC, fingerprint DESC) <= 12)
SELECT project, session_id, string_agg('[' || ts || '] ' || tool_name || CASE WHEN repeat_count > 1 THEN ' x' || repeat_count ELSE '' END || chr(10) || summary, chr(10) || chr(10) ORDER BY pos, fingerprint) AS text FROM l GROUP BY project, session_id""",
    "last_sessions": f"""WITH {_ENTRIES}, n AS ({_NORM.format(src="e")})
SELECT project, session_id, max(last_seen_at) AS updated_at, CAST(sum(repeat_count) AS BIGINT) AS calls FROM n WHERE project IS NOT NULL GROUP BY project, session_id ORDER BY updated_at DESC, session_id LIMIT 20""",
    "shadow_baseline": r"""WITH c AS (SELECT project, id, max(similarity) AS s, min(text) AS text FROM chunks WHERE similarity IS NOT NULL AND text IS NOT NULL GROUP BY project, id),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY project ORDER BY s DESC, id) <= 20)
SELECT project, count(*) AS chunks, CAST(sum(len(regexp_extract_all(text, '[^ \t\r\n]+'))) AS BIGINT) AS tokens FROM b GROUP BY project""",
}
SQL["inference_inputs"] = f"""WITH t AS ({SQL["session_text"]}), n AS (SELECT project, name, row_number() OVER (PARTITION BY project ORDER BY name) AS i FROM (SELECT DISTINCT project, name FROM entities WHERE name IS NOT NULL)),
l AS (SELECT project, string_agg(name, ', ' ORDER BY name) AS names FROM n WHERE i <= 30 GROUP BY project)
SELECT t.project, session_id, substring(text, 1, 2000) AS text, coalesce(names, '') AS names FROM t LEFT JOIN l ON l.project = t.project WHERE t.project IS NOT NULL"""
