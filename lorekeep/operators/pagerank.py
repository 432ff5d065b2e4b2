"""Personalised PageRank on a sparse, symmetric edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.sources.tables import free, materialise

ALPHA, TOLERANCE, MAX_ROUNDS = 0.5, 1e-4, 50


def transition(relations: DataFrame) -> DataFrame:
    """(u, v, p): step probabilities of the symmetric graph, weighted by confidence.

    Of several edges between two nodes the greatest confidence counts, null as 1; loops are dropped.
    """
    out = relations.select(F.col("from_entity").alias("u"), F.col("to_entity").alias("v"), F.coalesce("confidence", F.lit(1.0)).alias("w"))
    both = out.union(out.select("v", "u", "w")).where("u != v").groupBy("u", "v").agg(F.max("w").alias("w")).where("w > 0")
    total = both.groupBy("u").agg(F.sum("w").alias("t"))
    return both.join(total, "u").select("u", "v", (F.col("w") / F.col("t")).alias("p"))


def personalised_pagerank(steps: DataFrame, nodes: DataFrame, seeds: DataFrame, rounds: int | None = None, alpha: float = ALPHA, cut_every: int = 5) -> DataFrame:
    """(node, score > 0) after power iteration r' = (1 - alpha) P^T r + alpha s.

    ``nodes`` and ``seeds`` have a column node; seeds that are no nodes are ignored, and without any
    seed the result is empty. A node without steps passes its score to all nodes alike, kept as one
    number instead of a dense row. With ``rounds`` exactly so many rounds run; without, they end when
    the scores move by less than TOLERANCE in total.
    """
    nodes = nodes.select("node").distinct()
    start = seeds.select("node").distinct().join(nodes, "node", "left_semi")
    n, k = nodes.count(), start.count()
    if not k:
        return nodes.where(F.lit(False)).withColumn("score", F.lit(0.0))
    steps = materialise(steps, "steps")
    has = steps.select(F.col("u").alias("node")).distinct().withColumn("live", F.lit(True))
    base = materialise(nodes.join(start.withColumn("s", F.lit(1.0 / k)), "node", "left").join(has, "node", "left").select("node", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("live", F.lit(False)).alias("live")), "nodes")
    r = base.select("node", F.col("s").alias("score"))
    for i in range(rounds if rounds is not None else MAX_ROUNDS):
        flow = steps.join(r, steps.u == r.node).groupBy(F.col("v").alias("node")).agg(F.sum(F.col("p") * F.col("score")).alias("f"))
        dangling = r.join(base.where("not live"), "node", "left_semi").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        moved = base.join(flow, "node", "left").crossJoin(F.broadcast(dangling))
        new = moved.select("node", ((1 - alpha) * (F.coalesce("f", F.lit(0.0)) + F.col("lost") / n) + alpha * F.col("s")).alias("score"))
        if rounds is None:
            new = materialise(new, "ppr")
            gone = new.join(r.withColumnRenamed("score", "old"), "node").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
            free(r)
            r = new
            if (gone or 0.0) < TOLERANCE:
                break
        else:
            r = materialise(new, "ppr") if (i + 1) % cut_every == 0 and i + 1 < rounds else new
    return r.where("score > 0")


def top_nodes(scores: DataFrame, k: int = 30) -> DataFrame:
    """The k best nodes with their rank; ties go to the lesser node."""
    best = scores.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "node").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "node")))
