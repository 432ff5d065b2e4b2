"""Retrieval over the knowledge graph: from the terms of a question to entities, neighbours and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import query_terms
from lorekeep.operators.graph import k_hop, lookup_entities

#: Terms that a question gives to each call (fixed values), and the chunks kept when none is verified.
PRIMING_TERMS, SEARCH_TERMS, GRAPH_TERMS, UNVERIFIED = 3, 5, 8, 3


def question_terms(questions: DataFrame, most: int) -> DataFrame:
    """(query_id, project, pos, term): the first ``most`` distinct terms of each question, in order."""
    terms = F.slice(query_terms(F.col("query")), 1, most)
    return questions.select("query_id", "project", F.posexplode(terms).alias("pos", "term"))


def seed_entities(questions: DataFrame, index: DataFrame, most: int) -> DataFrame:
    """(query_id, id): the entities that a question's terms name, in the question's project."""
    terms = question_terms(questions, most).select("query_id", "project", "term")
    return lookup_entities(index, terms).select("query_id", "id").distinct()


def neighbourhood(seeds: DataFrame, steps: DataFrame, hops: int) -> DataFrame:
    """(query_id, node, hop): the seeds at 0 and their neighbours within ``hops``, at their least distance."""
    start = seeds.select("query_id", F.col("id").alias("node"), F.lit(0).alias("hop"))
    if hops < 1:
        return start
    reached = k_hop(steps, seeds.select(F.col("id").alias("seed")).distinct(), hops)
    near = seeds.join(reached, seeds.id == reached.seed).select("query_id", "node", "hop")
    return start.union(near).groupBy("query_id", "node").agg(F.min("hop").alias("hop"))


def near_chunks(nodes: DataFrame, mentions: DataFrame, by: str = "hop") -> DataFrame:
    """(query_id, chunk_id, {by}): chunks that mention the nodes, each with the least ``by`` of its nodes."""
    hit = nodes.join(mentions, nodes.node == mentions.entity_id).select("query_id", "chunk_id", by)
    return hit.groupBy("query_id", "chunk_id").agg(F.min(by).alias(by))


def ranked(rows: DataFrame, order: list, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first ``k`` rows of each question with their ``rank`` from 1."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", n).where(F.col("rank") <= k)


def priming(dense: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, rank): a question's dense chunks (query_id, chunk_id, rank), then the chunks of its
    entities (query_id, chunk_id), each chunk once; the first k + 2 are kept."""
    first = dense.select("query_id", "chunk_id", F.lit(0).alias("arm"), "rank")
    rest = near.select("query_id", "chunk_id", F.lit(1).alias("arm"), F.lit(0).alias("rank"))
    once = first.union(rest).groupBy("query_id", "chunk_id").agg(F.min(F.struct("arm", "rank")).alias("at"))
    return ranked(once, ["at", "chunk_id"], k + 2).select("query_id", "chunk_id", "rank")


def verified_or_first(judged: DataFrame, least: int = UNVERIFIED) -> DataFrame:
    """Rows (query_id, rank, accepted, ...) that were accepted; of questions without any the first ``least``."""
    some = F.max(F.col("accepted").cast("int")).over(Window.partitionBy("query_id"))
    marked = judged.withColumn("_some", some)
    return marked.where(F.col("accepted") | ((F.col("_some") == 0) & (F.col("rank") <= least))).drop("_some")


def distinct_first(found: DataFrame, unit: str, k: int) -> DataFrame:
    """(query_id, {unit}, rank): the first k different units (documents, sessions) of each question, by rank."""
    first = found.groupBy("query_id", unit).agg(F.min("rank").alias("at"))
    return ranked(first, ["at", unit], k).select("query_id", unit, "rank")
