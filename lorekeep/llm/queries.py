"""Queries of the llm problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import digest, encode, names, near_dup, packing, pii, split
from lorekeep.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.similar_pairs(table(spark, d, "chunks"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.groups(table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split.oversized(table(spark, d, "chunks"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_chunks(table(spark, d, "chunks"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return digest.percentiles(digest.measured(table(spark, d, "telemetry_events")), ["tool_name", "project"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(table(spark, d, "entities"), table(spark, d, "given_names"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return names.name_groups(table(spark, d, "entities"), table(spark, d, "given_names"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "documents"), table(spark, d, "given_names"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"), table(spark, d, "given_names"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p3_found, p3_pieces, p4_percentiles, p6_found, p6_groups, p7_ids, p8_containers, p9_found, p9_redacted)}

SQL = {
    # every blank sign counts here only at the ends of a text
    "p3_found": r"SELECT DISTINCT id FROM chunks WHERE id IS NOT NULL AND length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) > 1600",
}
