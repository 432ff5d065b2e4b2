"""Usage statistics over tool calls, entity reuse and confidence consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.time import utc_seconds

DAY = 86400


def distinct_calls(events: DataFrame) -> DataFrame:
    """Calls by id, copies removed, with ``sec``, the epoch second of ts (null if unreadable).

    Of rows of one id that differ the least counts; a null id is a call of its own.
    """
    rest = [c for c in events.columns if c != "id"]
    own = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
    once = events.withColumn("_own", own).groupBy("id", "_own").agg(F.min(F.struct(*rest)).alias("_c"))
    return once.select("id", *[F.col(f"_c.{c}").alias(c) for c in rest]).withColumn("sec", utc_seconds(F.col("ts")))


def since(calls: DataFrame, as_of: str, days: int) -> DataFrame:
    """Calls of the ``days`` before an instant; unreadable times are left out."""
    at = utc_seconds(F.lit(as_of))
    return calls.where((F.col("sec") > at - days * DAY) & (F.col("sec") <= at))


def _sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def usage_stats(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls, token sums, rejections, blocked calls, mean score, tools and time range, per group."""
    return calls.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("calls"),
        _sum("tokens_injected").alias("injected"),
        _sum("tokens_baseline").alias("baseline"),
        _sum("chunks_total").alias("chunks"),
        (_sum("chunks_rejected_srmkg") + _sum("chunks_rejected_vog")).alias("rejected"),
        _sum("cross_project_hit").alias("cross_project"),
        _sum("was_hallucination_blocked").alias("blocked"),
        F.round(F.avg("vog_score"), 6).alias("avg_vog"),
        F.array_join(F.array_sort(F.collect_set("llm_preset")), ",").alias("presets"),
        F.min("sec").alias("first_sec"),
        F.max("sec").alias("last_sec"),
    )


def savings(stats: DataFrame) -> DataFrame:
    """Adds the tokens saved against the baseline and their share in percent."""
    saved = F.greatest(F.col("baseline") - F.col("injected"), F.lit(0))
    return stats.withColumn("saved", saved).withColumn("saved_pct", F.when(F.col("baseline") > 0, F.round(100 * saved / F.col("baseline"), 1)).otherwise(F.lit(0.0)))


def short_number(n: Column) -> Column:
    """1.2K or 3.4M, as reports print token counts."""
    return F.when(n >= 1_000_000, F.format_string("%.2fM", n / 1_000_000)).when(n >= 1_000, F.format_string("%.1fK", n / 1_000)).otherwise(n.cast("string"))


def entity_reuse(calls: DataFrame, as_of: str, window_days: int | None = None) -> DataFrame:
    """(project, entity_id, sessions, touches, days_since) from the entities named in metadata_json.

    Sessions are counted distinct, a null session as one; unreadable JSON names no entity.
    """
    rows = calls if window_days is None else since(calls, as_of, window_days)
    names = F.from_json("metadata_json", "struct<entities:array<string>>").getField("entities")
    each = rows.select("project", F.coalesce("session_id", F.lit("")).alias("session"), "sec", F.explode(names).alias("entity_id")).where("entity_id is not null")
    # per session first, so that a hot entity is spread before its sessions are counted
    part = each.groupBy("project", "entity_id", "session").agg(F.count(F.lit(1)).alias("n"), F.max("sec").alias("last"))
    return part.groupBy("project", "entity_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("touches"), F.round((utc_seconds(F.lit(as_of)) - F.max("last")) / DAY, 4).alias("days_since"))


def consolidate(reuse: DataFrame, degrees: DataFrame) -> DataFrame:
    """(project, entity_id, action, delta): boost and protect entities used in several sessions, let those
    of one old session decay.

    ``degrees`` holds (entity_id, degree); the boost is damped by the root of the degree.
    """
    d = reuse.join(degrees, "entity_id", "left").withColumn("degree", F.greatest(F.coalesce("degree", F.lit(1)), F.lit(1)))
    boost = F.tanh(F.col("sessions") / 5) * 0.02 / F.sqrt("degree")
    decay = 0.05 * (1 - F.exp(-(F.col("days_since") - 14) / 14))
    old = (F.col("sessions") == 1) & (F.col("days_since") > 14)
    out = d.withColumn("action", F.when(F.col("sessions") >= 2, "boost").when(old, "decay").otherwise("none"))
    return out.select("project", "entity_id", "action", F.round(F.when(F.col("action") == "boost", boost).when(F.col("action") == "decay", -decay).otherwise(0.0), 6).alias("delta"))


def latest_calls(calls: DataFrame, k: int = 500) -> DataFrame:
    """The k latest calls, as the raw listing shows them."""
    cols = ["id", "ts", "project", "tool_name", "session_id", "tokens_injected", "tokens_baseline", "vog_score", "latency_ms"]
    return calls.where("sec is not null").orderBy(F.desc("sec"), F.desc("id")).limit(k).select(*cols)
