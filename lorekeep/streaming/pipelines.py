"""Structured Streaming forms of ingest, telemetry and sessions (an extension: the batch operators' own
tables, kept up to date)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorekeep.functions.time import utc_seconds
from lorekeep.operators import rolling
from lorekeep.operators.chunking import chunk_documents

EVENTS = "id bigint, ts string, project string, tool_name string, session_id string, llm_preset string, tokens_injected int, tokens_baseline int, vog_score double, chunks_total int, chunks_rejected_srmkg int, chunks_rejected_vog int, cross_project_hit int, latency_ms int, was_hallucination_blocked int, metadata_json string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """New telemetry files as a stream, with the event time ``at``."""
    raw = spark.readStream.schema(EVENTS).parquet(path)
    return raw.withColumn("at", F.timestamp_seconds(utc_seconds(F.col("ts"))))


def windowed_usage(events: DataFrame, width: str = "1 hour", late: str = "10 days") -> DataFrame:
    """Calls and tokens per project and window of event time; each id counts once within the watermark."""
    once = events.where("at is not null").withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])
    return once.groupBy(F.window("at", width), "project").agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("tokens_injected"), F.lit(0)).alias("injected"), F.coalesce(F.sum("tokens_baseline"), F.lit(0)).alias("baseline"))


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "10 days") -> DataFrame:
    """Bursts of activity per project and session, closed after a pause."""
    known = events.where("at is not null and session_id is not null").withWatermark("at", late)
    return known.groupBy(F.session_window("at", gap), "project", "session_id").agg(F.count(F.lit(1)).alias("calls"))


def ingest_notes(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Chunk new text files as they arrive; the stream's checkpoint remembers which were done."""
    raw = spark.readStream.schema("doc_id string, text string").json(path)
    chunks = chunk_documents(raw)
    return chunks.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()


def keep_rolling_nodes(events: DataFrame, nodes_path: str, checkpoint: str) -> StreamingQuery:
    """Keep a stored segment tree current: each micro-batch writes only the ancestors of its days.

    A batch's rows go to a folder of its own number, so a batch that runs twice writes the same; ids
    are made distinct within the stream's watermark of 10 days. ``rolling_nodes`` reads the tree.
    """
    once = events.where("at is not null").withWatermark("at", "10 days").dropDuplicatesWithinWatermark(["id"])

    def add(batch: DataFrame, number: int) -> None:
        rolling.write_nodes(rolling.segment_nodes(rolling.daily_leaves(batch)), f"{nodes_path}/batch={number}", "overwrite")

    return once.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_nodes(spark: SparkSession, nodes_path: str) -> DataFrame:
    """The nodes of the tree that ``keep_rolling_nodes`` stores."""
    return rolling.read_nodes(spark, nodes_path)


def log_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append new calls to the telemetry table, split by day of the call; the checkpoint keeps each batch single."""
    dated = events.withColumn("day", F.coalesce(F.date_format("at", "yyyy-MM-dd"), F.lit("unreadable"))).drop("at")
    sink = dated.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path)
    return sink.partitionBy("day").trigger(availableNow=True).start()
