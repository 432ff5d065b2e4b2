"""Logistic calibration by gradient descent, over all rows or per group, and rank AUC."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.edges import logistic
from lorekeep.operators.reduction import sums_before
from lorekeep.sources.tables import materialise

#: Distinct rows (features, label) of a group up to which one task fits it.
TASK_ROWS = 50_000


def calibrate(rows: DataFrame, features: list[str], label: str, rounds: int = 100, rate: float = 0.1, l2: float = 1.0, least: int = 50) -> dict | None:
    """{"weights": {...}, "intercept": b, "n": n, "loss": l} of an L2 logistic regression, or None.

    None stands for fewer than ``least`` rows or one class only. Each round is one aggregate over the
    rows: the gradient's sums are made per partition; only its few numbers reach the driver. The loss is
    that of the last round, before its step.
    """
    data = rows.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("y")).dropna().cache()
    try:
        n, ones = data.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
        if n < least or ones in (0, n):
            return None
        w, b, loss = dict.fromkeys(features, 0.0), 0.0, None
        for _ in range(rounds):
            z = F.lit(b)
            for f in features:
                z = z + F.col(f) * F.lit(w[f])
            p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(60.0)), F.lit(-60.0))))
            miss = p - F.col("y")
            lost = -F.log(F.when(F.col("y") == 1, p).otherwise(1 - p) + 1e-12)
            g = data.agg(F.avg(miss).alias("_b"), F.avg(lost).alias("_l"), *[F.avg(miss * F.col(f)).alias(f) for f in features]).first()
            loss = g["_l"] + 0.5 * l2 * sum(x * x for x in w.values()) / n
            w = {f: w[f] - rate * (g[f] + l2 * w[f] / n) for f in features}
            b -= rate * g["_b"]
        return {"weights": w, "intercept": b, "n": n, "loss": loss}
    finally:
        data.unpersist()


def descend(x: np.ndarray, y: np.ndarray, count: np.ndarray, rounds: int, rate: float, l2: float) -> tuple[np.ndarray, float, float]:
    """(weights, intercept, loss) of ``calibrate`` over rows that stand for ``count`` equal ones."""
    w, b, loss, n = np.zeros(x.shape[1]), 0.0, 0.0, count.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -60, 60)))
        loss = float(-(count * np.log(np.where(y == 1, p, 1 - p) + 1e-12)).sum() / n + 0.5 * l2 * (w @ w) / n)
        miss = count * (p - y)
        w, b = w - rate * (x.T @ miss / n + l2 * w / n), b - rate * float(miss.sum() / n)
    return w, b, loss


def calibrate_groups(rows: DataFrame, by: str, features: list[str], label: str, drawn: Column, rounds: int = 500, rate: float = 0.1, l2: float = 1.0, least: int = 50, task_rows: int = TASK_ROWS) -> DataFrame:
    """(by, n_train, n_test, weights, intercept, loss, auc): a fit of each group without its rows ``drawn``.

    The drawn rows are the test; auc is theirs. Groups of fewer than ``least`` rows, or of one class among
    the training rows, keep null for a fit. Equal rows are counted first: a group of up to ``task_rows``
    distinct ones is fitted in one task, a larger one by ``calibrate``, whose rounds are aggregates over
    all tasks.
    """
    data = materialise(rows.select(by, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features], F.col(label).cast("double").alias("y"), drawn.alias("test")).where("y is not null"), "labelled")
    train = data.where("not test")
    counted = materialise(train.groupBy(by, *features, "y").agg(F.count(F.lit(1)).alias("count")), "counted")
    size = data.groupBy(by).agg(F.count_if(~F.col("test")).alias("n_train"), F.count_if("test").alias("n_test"), F.coalesce(F.sum(F.when(~F.col("test"), F.col("y"))), F.lit(0.0)).alias("ones"))
    size = materialise(size.join(counted.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("kinds")), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by"), "groups")
    fits = size.where((F.col("n_train") + F.col("n_test") >= least) & (F.col("ones") > 0) & (F.col("ones") < F.col("n_train")))

    def fit(g):
        w, b, loss = descend(g[features].to_numpy(float), g["y"].to_numpy(float), g["count"].to_numpy(float), rounds, rate, l2)
        return g[[by]].head(1).assign(weights=[w.tolist()], intercept=b, loss=loss)

    kind = f"{by} {rows.schema[by].dataType.simpleString()}, weights array<double>, intercept double, loss double"
    small = fits.where(F.col("kinds") <= task_rows).select(F.col(by).alias("_by"))
    models = counted.join(small, F.col(by).eqNullSafe(F.col("_by")), "left_semi").groupBy(by).applyInPandas(fit, kind)
    large = []
    for (g,) in fits.where(F.col("kinds") > task_rows).select(by).collect():
        m = calibrate(train.where(F.col(by).eqNullSafe(F.lit(g))), features, "y", rounds, rate, l2, 0)
        large.append((g, [m["weights"][f] for f in features], m["intercept"], m["loss"]))
    if large:
        models = models.union(rows.sparkSession.createDataFrame(large, kind))
    models = materialise(models.withColumnRenamed(by, "_by"), "models")
    z = F.col("intercept")
    for i, f in enumerate(features):
        z = z + F.col(f) * F.col("weights")[i]
    tested = data.where("test").join(models, F.col(by).eqNullSafe(F.col("_by"))).select(by, z.alias("z"), "y")
    areas = auc(tested, "z", "y", [by]).select(F.col(by).alias("_g"), "auc")
    out = size.join(models, F.col(by).eqNullSafe(F.col("_by")), "left").join(areas, F.col(by).eqNullSafe(F.col("_g")), "left")
    return out.select(by, "n_train", "n_test", "weights", "intercept", "loss", "auc")


def auc(scored: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """(by..., n_pos, n_neg, auc): area under the ROC curve, ties counted half.

    Scores are first counted per distinct value; ranks come from prefix sums over ranges of scores, so that a
    hot group is spread. Without both classes auc is null.
    """
    by = by or []
    values = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("q"))
    ranked = sums_before(values, by, [score], "q", "below")
    total = ranked.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"))
    return total.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.round(F.col("u") / (F.col("n_pos") * F.col("n_neg")), 6)).alias("auc"))


def save_weights(models: DataFrame, path: str) -> None:
    """Store fits of ``calibrate_groups`` as one small table, in place of those stored before."""
    materialise(models, "weights").write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def learned_score(rows: DataFrame, models: DataFrame, by: str, features: list[str], otherwise: Column) -> DataFrame:
    """Adds ``learned_score``: the logistic score by the weights of a row's group, ``otherwise`` where it has none."""
    fits = models.select(F.col(by).alias("_by"), "weights", "intercept")
    joined = rows.join(fits, F.col(by).eqNullSafe(F.col("_by")), "left")
    score = logistic({f: F.col("weights")[i] for i, f in enumerate(features)}, F.col("intercept"))
    return joined.withColumn("learned_score", F.when(F.col("weights").isNotNull(), score).otherwise(otherwise)).drop("_by", "weights", "intercept")
