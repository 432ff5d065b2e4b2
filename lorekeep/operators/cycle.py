"""One maintenance cycle: infer relations from sessions, verify and merge them, prune, and log the run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import canonical_key
from lorekeep.operators import edges, graph, verify
from lorekeep.sources.tables import materialise

LOG = "started string, candidates bigint, asked bigint, accepted bigint, relations bigint, pruned bigint"


def inferred_relations(texts: DataFrame, entities: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """(project, from_entity, to_entity, relation_type, confidence, session_id) that a model reads from session texts.

    ``texts`` holds (project, session_id, text). A relation counts where both its names are entities of the project;
    several entities of one canonical name stand as the least of them. Relations said twice count once, at their best.
    """
    inputs = verify.inference_inputs(texts, entities.select("project", "name"))
    prompt = F.concat(F.lit("Names: "), "names", F.lit("\n\n"), F.coalesce("text", F.lit("")))
    said = verify.ask_model(inputs.select("project", "session_id", prompt.alias("prompt")), "prompt", model)
    lines = verify.parse_relation_lines(said, ["project", "session_id"])
    known = entities.where("name is not null").select("project", canonical_key(F.col("name")).alias("key"), "id")
    known = known.where("key <> ''").groupBy("project", "key").agg(F.min("id").alias("id"))
    for side, end in (("source", "from_entity"), ("target", "to_entity")):
        own = known.withColumnRenamed("id", end)
        lines = lines.withColumn("key", canonical_key(F.col(side))).join(own, ["project", "key"]).drop("key")
    best = lines.where("from_entity <> to_entity").groupBy("project", "from_entity", "to_entity", "relation_type")
    return best.agg(F.max("confidence").alias("confidence"), F.max("session_id").alias("session_id"))


def verified_relations(candidates: DataFrame, relations: DataFrame, model: Callable[[str], str], cap: int = verify.CALL_CAP) -> DataFrame:
    """Candidates with level, ask, answer and accepted: the score decides, the model on borderline ones up to ``cap`` a
    project; what is beyond the cap is accepted."""
    pairs = edges.undirected(relations, "from_entity", "to_entity")
    ends = candidates.withColumn("a", F.least("from_entity", "to_entity")).withColumn("b", F.greatest("from_entity", "to_entity"))
    t = edges.topology(pairs.union(ends.select("a", "b")).distinct()).select(F.col("a").alias("_a"), F.col("b").alias("_b"), "n_common", "deg_a", "deg_b")
    joined = ends.join(t, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
    first = F.col("from_entity") == F.col("a")
    degrees = [F.when(first, F.col("deg_a")).otherwise(F.col("deg_b")), F.when(first, F.col("deg_b")).otherwise(F.col("deg_a"))]
    named = joined.select(*candidates.columns, F.col("n_common").alias("common_neighbors"), *[x.alias(n) for x, n in zip(degrees, ("degree_from", "degree_to"))])
    scored = verify.components(named).withColumn("score", verify.heuristic_score())
    scored = scored.withColumn("level", verify.decision(F.col("score")))
    capped = materialise(verify.cap_calls(scored, ["project"], ["score", "from_entity", "relation_type", "to_entity"], cap), "capped")
    prompt = F.concat_ws(" ", F.lit("Verify:"), "from_entity", "relation_type", "to_entity")
    asked = verify.ask_model(capped.where("ask").withColumn("prompt", prompt), "prompt", model).drop("prompt")
    both = asked.unionByName(capped.where("not ask").withColumn("answer", F.lit(None).cast("string")))
    said = F.when(F.col("ask"), verify.parse_verdict(F.col("answer")).accepted)
    return both.withColumn("accepted", F.coalesce(said, F.col("level").isin("srmkg_high", "srmkg_cap")))


def run_cycle(
    spark: SparkSession, texts: DataFrame, entities: DataFrame, relations: DataFrame, mentions: DataFrame,
    model: Callable[[str], str], log_path: str, now: str,
) -> tuple[DataFrame, DataFrame]:
    """(relations, entities) after one cycle; a row of the run is appended to the log below ``log_path``.

    ``relations`` holds the columns of ``graph.merge_relations``; an entity without relations and mentions goes.
    """
    candidates = materialise(inferred_relations(texts, entities, model), "candidates")
    judged = materialise(verified_relations(candidates, relations, model), "judged")
    fresh = judged.select(
        *graph.EDGE, "confidence", F.lit(False).alias("verified"), "session_id", F.lit("cycle").alias("origin_tool"),
        F.lit(now).alias("created_at"), F.create_map().cast("map<string,string>").alias("qualifiers"), "accepted",
    )
    observed = relations.select(*[c for c in fresh.columns if c != "accepted"]).unionByName(verify.stamped(fresh, "cycle"))
    merged = materialise(graph.merge_relations(observed), "merged")
    gone = edges.isolated_entities(entities, merged, mentions).select("id")
    kept = materialise(entities.join(gone, "id", "left_anti"), "kept")
    n = judged.agg(F.count(F.lit(1)).alias("candidates"), F.count_if("ask").alias("asked"), F.count_if("accepted").alias("accepted")).first()
    row = (now, n.candidates, n.asked, n.accepted, merged.count(), entities.count() - kept.count())
    spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(log_path)
    return merged, kept


def run_metrics(spark: SparkSession, log_path: str) -> DataFrame:
    """(runs, last, candidates, asked, accepted, pruned): all runs of a log together."""
    log = spark.read.schema(LOG).parquet(log_path)
    sums = [F.sum(c).alias(c) for c in ("candidates", "asked", "accepted", "pruned")]
    return log.agg(F.count(F.lit(1)).alias("runs"), F.max("started").alias("last"), *sums)
