"""Session logs: entry normalisation, merging, preparation and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import fingerprint, strip

KEPT_ENTRIES, KEPT_SESSIONS, TEXT_ENTRIES = 50, 200, 12


def normalise_entries(entries: DataFrame, by: list[str]) -> DataFrame:
    """(by..., fingerprint, tool_name, summary, repeat_count, ts, last_seen_at, pos): one row per distinct
    summary of a session.

    ``entries`` holds by, pos, ts, tool_name, summary and repeat_count (null counts once). Blank
    summaries are dropped; repeats are summed; last_seen_at is that of the last entry, ts the greatest,
    pos the first.
    """
    some = entries.withColumn("summary", strip(F.col("summary"))).where(F.coalesce("summary", F.lit("")) != "")
    keyed = some.withColumn("fingerprint", fingerprint(F.col("summary")))
    return keyed.groupBy(*by, "fingerprint").agg(
        F.max_by("tool_name", "pos").alias("tool_name"),
        F.min("summary").alias("summary"),
        F.sum(F.coalesce("repeat_count", F.lit(1))).alias("repeat_count"),
        F.max("ts").alias("ts"),
        F.max_by("ts", "pos").alias("last_seen_at"),
        F.min("pos").alias("pos"),
    )


def merge_sessions(replicas: list[DataFrame], by: list[str]) -> DataFrame:
    """Entries of several copies of the session log as one: equal entries add up their repeats, and the
    last 50 entries of a session are kept (a feature of the log)."""
    every = replicas[0]
    for r in replicas[1:]:
        every = every.unionByName(r)
    merged = normalise_entries(every, by)
    w = Window.partitionBy(*by).orderBy(F.desc("pos"), F.desc("fingerprint"))
    return merged.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= KEPT_ENTRIES).drop("_n")


def newest_sessions(sessions: DataFrame, k: int = KEPT_SESSIONS) -> DataFrame:
    """The k sessions that were updated last; ties go to the lesser session."""
    return sessions.orderBy(F.desc("updated_at"), "session_id").limit(k)


def prepare_sessions(entries: DataFrame, by: list[str], min_repeat: int = 2) -> DataFrame:
    """(by..., kept, total_repeats, max_repeat, summaries): entries repeated often enough, most repeated
    first; sessions without such entries are dropped."""
    kept = entries.where(F.col("repeat_count") >= min_repeat)
    order = F.struct((-F.col("repeat_count")).alias("r"), F.col("fingerprint").alias("f"), F.col("summary").alias("s"))
    return kept.groupBy(*by).agg(
        F.count(F.lit(1)).alias("kept"),
        F.sum("repeat_count").alias("total_repeats"),
        F.max("repeat_count").alias("max_repeat"),
        F.transform(F.array_sort(F.collect_list(order)), lambda x: x.s).alias("summaries"),
    )


def session_text(entries: DataFrame, by: list[str]) -> DataFrame:
    """(by..., text): the last 12 entries as "[ts] tool xN" over their summary."""
    w = Window.partitionBy(*by).orderBy(F.desc("pos"), F.desc("fingerprint"))
    last = entries.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= TEXT_ENTRIES)
    line = F.concat(F.lit("["), F.coalesce("ts", F.lit("")), F.lit("] "), F.coalesce("tool_name", F.lit("")), F.when(F.col("repeat_count") > 1, F.concat(F.lit(" x"), "repeat_count")).otherwise(F.lit("")), F.lit("\n"), "summary")
    rows = last.withColumn("line", line)
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fingerprint", "line"))), lambda x: x.line), "\n\n").alias("text"))
