"""Review of suspicious edges: the queue's rows, labels, statistics, and pruning with a second opinion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.edges import FEATURES, SPURIOUS
from lorekeep.operators.verify import LOW

#: Labels from which an edge scorer may be trained.
TRAIN_FROM = 20
KEY = ["project", "a", "b"]


def feature_rows(scored: DataFrame, entities: DataFrame) -> DataFrame:
    """Scored edges (project, a, b, features..., spuriousness) with the names of both ends, as the queue holds them."""
    name = entities.groupBy("id").agg(F.max("name").alias("name"))
    out = scored
    for end in ("a", "b"):
        out = out.join(name.select(F.col("id").alias(end), F.col("name").alias(f"name_{end}")), end, "left")
    return out.select(*KEY, "name_a", "name_b", *FEATURES, "spuriousness")


def capture(queue: DataFrame, rows: DataFrame) -> DataFrame:
    """The queue with those rows whose edge it does not hold yet, pending and unlabelled."""
    fresh = rows.join(queue.select(*KEY), KEY, "left_anti")
    new = fresh.withColumn("status", F.lit("pending")).withColumn("label", F.lit(None).cast("string"))
    return queue.unionByName(new.select(*queue.columns))


def label(queue: DataFrame, labels: DataFrame) -> DataFrame:
    """The queue after review: ``labels`` holds (project, a, b, label), label being keep or prune."""
    said = labels.where(F.col("label").isin("keep", "prune")).groupBy(*KEY).agg(F.max("label").alias("_said"))
    out = queue.join(said, KEY, "left")
    status = F.when(F.col("_said").isNotNull(), "labelled").otherwise(F.col("status"))
    return out.withColumn("status", status).withColumn("label", F.coalesce("_said", "label")).select(*queue.columns)


def pending(queue: DataFrame, n: int = 20) -> DataFrame:
    """The n pending rows nearest to the limit (a report)."""
    near = queue.where("status = 'pending'").withColumn("distance", F.round(F.abs(F.col("spuriousness") - SPURIOUS), 6))
    return near.orderBy("distance", *KEY).limit(n)


def statistics(queue: DataFrame) -> DataFrame:
    """(project, total, pending, labelled, keep, prune, trainable): counts of each project's queue."""
    return queue.groupBy("project").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") == "labelled").alias("labelled"),
        F.count_if(F.col("label") == "keep").alias("keep"),
        F.count_if(F.col("label") == "prune").alias("prune"),
        (F.count_if(F.col("label").isNotNull()) >= TRAIN_FROM).alias("trainable"),
    )


def apply_pruning(relations: DataFrame, suggested: DataFrame, scores: DataFrame, dry_run: bool = True) -> DataFrame:
    """Relations of suggested edges (a, b) whose own score is low as well; without ``dry_run`` the relations left.

    ``scores`` holds the relations' keys and ``score``; a relation with several observations goes by its best one.
    """
    edge = ["project", "from_entity", "relation_type", "to_entity"]
    best = scores.groupBy(*edge).agg(F.max("score").alias("score"))
    ends = best.withColumn("a", F.least("from_entity", "to_entity")).withColumn("b", F.greatest("from_entity", "to_entity"))
    gone = ends.join(suggested.select("a", "b").distinct(), ["a", "b"], "left_semi").where(F.col("score") < LOW).select(*edge, "score")
    if dry_run:
        return gone
    on = [relations[c].eqNullSafe(gone[c]) for c in edge]
    return relations.join(gone, on, "left_anti")


def export_labels(queue: DataFrame, path: str) -> None:
    """Labelled rows as JSON lines."""
    queue.where("label is not null").write.mode("overwrite").json(path)
