"""Topology features of edges, spurious-edge scores and isolated entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HUB_DEGREE, SPURIOUS = 20, 0.65
FEATURES = ["heuristic", "jaccard", "common", "deg_u", "deg_v", "hub"]


def undirected(edges: DataFrame, u: str, v: str) -> DataFrame:
    """Distinct (a, b) with a < b."""
    return edges.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).where("a < b").distinct()


def topology(pairs: DataFrame) -> DataFrame:
    """(a, b, n_common, deg_a, deg_b) of each undirected edge.

    Common neighbours come from wedges through the smaller end: an edge is expanded by the neighbours of
    its end of lower degree only and looked up at the other, so that a hub's neighbours are never paired
    with each other.
    """
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a"))
    deg = both.groupBy("x").agg(F.count(F.lit(1)).alias("d"))
    sized = pairs.join(deg.select(F.col("x").alias("a"), F.col("d").alias("deg_a")), "a").join(deg.select(F.col("x").alias("b"), F.col("d").alias("deg_b")), "b")
    small = F.when(F.col("deg_a") <= F.col("deg_b"), F.col("a")).otherwise(F.col("b"))
    large = F.when(F.col("deg_a") <= F.col("deg_b"), F.col("b")).otherwise(F.col("a"))
    wedge = sized.select("a", "b", small.alias("x"), large.alias("other")).join(both, "x").select("a", "b", F.col("other").alias("x"), "y")
    common = wedge.join(both, ["x", "y"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_common"))
    return sized.join(common, ["a", "b"], "left").select("a", "b", F.coalesce("n_common", F.lit(0)).alias("n_common"), "deg_a", "deg_b")


def edge_features(pairs: DataFrame) -> DataFrame:
    """(a, b, heuristic, jaccard, common, deg_u, deg_v, hub), degrees as shares of the greatest one."""
    t = topology(pairs)
    top = t.agg(F.max(F.greatest("deg_a", "deg_b")).alias("top"))
    e = t.crossJoin(F.broadcast(top))
    most = F.greatest("deg_a", "deg_b", F.lit(1))
    hub = F.when(F.greatest("deg_a", "deg_b") > HUB_DEGREE, 1.0).otherwise(0.0)
    union = F.greatest(F.col("deg_a") + F.col("deg_b") - F.col("n_common"), F.lit(1))
    share = F.col("n_common") / most
    return e.select(
        "a",
        "b",
        F.least(F.lit(1.0), F.round(1 - share + 0.15 * hub, 4)).alias("heuristic"),
        F.round(F.col("n_common") / union, 4).alias("jaccard"),
        F.round(share, 4).alias("common"),
        F.round(F.col("deg_a") / F.col("top"), 4).alias("deg_u"),
        F.round(F.col("deg_b") / F.col("top"), 4).alias("deg_v"),
        hub.alias("hub"),
    )


def logistic(weights: dict[str, float | Column], intercept: float | Column) -> Column:
    """Logistic score of feature columns, its argument clamped to +-60, to four places."""
    z = F.lit(intercept)
    for name, w in weights.items():
        z = z + F.col(name) * w
    return F.round(1 / (1 + F.exp(-F.least(F.lit(60.0), F.greatest(F.lit(-60.0), z)))), 4)


def spurious(features: DataFrame, weights: dict[str, float] | None = None, intercept: float = 0.0, limit: float = SPURIOUS) -> DataFrame:
    """Edges with their spuriousness and whether they are suggested for removal; learned weights, if
    given, take the place of the heuristic."""
    score = logistic(weights, intercept) if weights else F.col("heuristic")
    return features.withColumn("spuriousness", score).withColumn("suggested", F.col("spuriousness") >= limit)


def isolated_entities(entities: DataFrame, relations: DataFrame, mentions: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Entities without relations and without mentions, apart from protected ones (id)."""
    ends = relations.select(F.explode(F.array("from_entity", "to_entity")).alias("id"))
    out = entities.join(ends.distinct(), "id", "left_anti").join(mentions.select(F.col("entity_id").alias("id")).distinct(), "id", "left_anti")
    return out if protected is None else out.join(protected.select("id"), "id", "left_anti")


def review_candidates(scored: DataFrame, keys: list[str], known: DataFrame | None = None, band: float = 0.25, rate: float = 0.2, cap: int = 50) -> DataFrame:
    """Edges close to the limit for review: within ``band``, a hash-drawn share, nearest first, at most
    ``cap``; those already in ``known`` (keys) are left out."""
    near = F.round(F.abs(F.col("spuriousness") - SPURIOUS), 6)
    some = scored.withColumn("distance", near).where(F.col("distance") <= band)
    drawn = some.where(F.conv(F.substring(F.md5(F.concat_ws(":", *keys)), 1, 4), 16, 10).cast("int") < int(rate * 65536))
    fresh = drawn if known is None else drawn.join(known.select(*keys), keys, "left_anti")
    return fresh.orderBy("distance", *keys).limit(cap)
