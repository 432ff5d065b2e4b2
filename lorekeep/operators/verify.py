"""Relation verification: topology score, decision, model calls with a cap, and answer parsers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIGH, LOW = 0.7, 0.3
CALL_CAP = 30
#: Weights of the heuristic score (fixed values).
W_BASE, W_JACCARD, W_TYPE, W_ISOLATED = 0.4, 0.4, 0.05, 0.3
VAGUE_TYPES = ("related_to", "unknown")


def components(rows: DataFrame) -> DataFrame:
    """Adds base, jaccard, type_boost and isolated from confidence, relation_type, common_neighbors,
    degree_from and degree_to (null counts are 0)."""
    c, df, dt = (F.coalesce(F.col(x), F.lit(0)) for x in ("common_neighbors", "degree_from", "degree_to"))
    return (
        rows.withColumn("base", F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(0.5)))
        .withColumn("jaccard", c / F.greatest(df + dt - c, F.lit(1)))
        .withColumn("type_boost", F.when(F.coalesce("relation_type", F.lit("unknown")).isin(*VAGUE_TYPES), 0.0).otherwise(1.0))
        .withColumn("isolated", F.when((df == 0) & (dt == 0), 1.0).otherwise(0.0))
    )


def heuristic_score() -> Column:
    raw = W_BASE * F.col("base") + W_JACCARD * F.col("jaccard") + W_TYPE * F.col("type_boost") - W_ISOLATED * F.col("isolated")
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 4)


def decision(score: Column) -> Column:
    return F.when(score >= HIGH, "srmkg_high").when(score < LOW, "srmkg_low").otherwise("borderline")


def cap_calls(scored: DataFrame, by: list[str], order: list[str], cap: int = CALL_CAP) -> DataFrame:
    """Adds ``level`` and ``ask``: the first ``cap`` borderline rows of a group go to the model, the rest
    are accepted as srmkg_cap.

    Only the first rows of each group are ranked, which every task does for its own rows first; the last of them
    is then the limit for all rows. Equal rows beyond the cap are told apart by number.
    """
    line = scored.where("level = 'borderline'").withColumn("_o", F.struct(*order))
    first = line.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_o"))).where(F.col("_n") <= cap)
    last = first.groupBy(*by).agg(F.max("_o").alias("_last"), F.collect_list("_o").alias("_all"))  # at most cap rows
    last = last.select(*[F.col(c).alias(f"_{c}") for c in by], "_last", F.size(F.filter("_all", lambda x: x == F.col("_last"))).alias("_ties"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    tie = F.row_number().over(Window.partitionBy(*by, *order).orderBy(F.lit(1)))
    at = line.withColumn("_tie", tie).join(last, on)
    ask = (F.col("_o") < F.col("_last")) | ((F.col("_o") == F.col("_last")) & (F.col("_tie") <= F.col("_ties")))
    marked = at.withColumn("ask", ask).withColumn("level", F.when(F.col("ask"), F.col("level")).otherwise("srmkg_cap"))
    return marked.select(*scored.columns, "ask").unionByName(scored.where("level <> 'borderline'").withColumn("ask", F.lit(False)))


def said_confidence(upper: Column) -> Column:
    """The number behind CONFIDENCE: in an upper-case answer; null without a readable one."""
    return F.regexp_extract(upper, r"CONFIDENCE:\s*([0-9.]+)", 1).try_cast("double")


def parse_verdict(answer: Column) -> Column:
    """struct<verdict, confidence, accepted> of a model's answer; an empty answer is a rejection.

    GROUNDED wins over PARTIAL; a partial verdict has its confidence reduced to 60 percent.
    """
    up = F.upper(F.coalesce(answer, F.lit("")))
    verdict = F.when(up.contains("GROUNDED"), "GROUNDED").when(up.contains("PARTIAL"), "PARTIAL").otherwise("REJECTED")
    conf = F.coalesce(said_confidence(up), F.lit(0.6))
    conf = F.when(up == "", 0.0).when(verdict == "PARTIAL", conf * 0.6).otherwise(conf)
    return F.struct(verdict.alias("verdict"), F.round(conf, 4).alias("confidence"), (verdict != "REJECTED").alias("accepted"))


def parse_conflict(answer: Column) -> Column:
    """struct<conflict, confidence>; without an answer there is no conflict, at 0.5."""
    up = F.upper(F.coalesce(answer, F.lit("")))
    conf = F.when(up == "", 0.5).otherwise(F.coalesce(said_confidence(up), F.lit(0.7)))
    return F.struct((up.contains("CONFLICT") & ~up.contains("NO CONFLICT")).alias("conflict"), conf.alias("confidence"))


#: A relation in a line of an answer (fixed format).
LINE = r"(?i)^\s*(?:(?:[-*]|\d+[.)])\s+)?(.+?)\s*[-–—]+\[(.+?)\][-–—]+[>→]\s*(.+?)\s*\|?\s*CONFIDENCE:\s*([0-9.]+)"


def parse_relation_lines(answers: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """(keys..., line, source, relation_type, target, confidence) of lines "A -[TYPE]-> B CONFIDENCE: x".

    Other lines are noise; an unreadable confidence is 0.5.
    """
    each = answers.select(*keys, F.posexplode(F.split(F.col(answer), r"\r?\n")).alias("line", "t")).where(F.col("t").rlike(LINE))
    g = lambda i: F.trim(F.regexp_extract("t", LINE, i))
    return each.select(*keys, "line", g(1).alias("source"), F.lower(g(2)).alias("relation_type"), g(3).alias("target"), F.round(F.coalesce(g(4).try_cast("double"), F.lit(0.5)), 4).alias("confidence"))


def ask_model(rows: DataFrame, prompt: str, model: Callable[[str], str], out: str = "answer") -> DataFrame:
    """Adds a model's answer to every row; a failing call gives an empty answer. ``model`` runs in the
    tasks and must be picklable."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers = []
            for p in b[prompt]:
                try:
                    answers.append(model(p) or "")
                except Exception:
                    answers.append("")
            yield b.assign(**{out: answers})

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])
    return rows.mapInPandas(ask, schema)


def bucket_chunks(ranked: DataFrame, similarity: str = "similarity") -> DataFrame:
    """Adds ``bucket``: accept from 0.7, reject below 0.3 or without a similarity, else ask the model."""
    s = F.col(similarity)
    return ranked.withColumn("bucket", F.when(s >= HIGH, "accept").when(s.isNull() | (s < LOW), "reject").otherwise("ask"))


#: Answers of a judge on whether a context answers a question (fixed values), in the order in which they are sought.
JUDGEMENTS = ("PARTIAL", "ANSWERED", "NO")


def parse_judgement(answer: Column) -> Column:
    """ANSWERED, PARTIAL, NO, or UNAVAILABLE for an empty or unreadable answer."""
    up = F.upper(F.coalesce(answer, F.lit("")))
    out = F.lit("UNAVAILABLE")
    for word in reversed(JUDGEMENTS):
        out = F.when(up.rlike(rf"\b{word}\b"), word).otherwise(out)
    return out


#: What an inference prompt holds at most (fixed values): signs of the session's text, and names.
PROMPT_TEXT, PROMPT_NAMES = 2000, 30


def inference_inputs(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(project, session_id, text, names): what a model is asked to infer relations from.

    ``texts`` holds (project, session_id, text), ``names`` (project, name); a project's least names are taken.
    """
    w = Window.partitionBy("project").orderBy("name")
    few = names.where("name is not null").distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= PROMPT_NAMES)
    lists = few.groupBy("project").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    joined = texts.join(lists, "project", "left")
    return joined.select("project", "session_id", F.substring("text", 1, PROMPT_TEXT).alias("text"), F.coalesce("names", F.lit("")).alias("names"))


def stamped(relations: DataFrame, verifier: str, accepted: str = "accepted") -> DataFrame:
    """The accepted relations as verified observations whose qualifiers name the verifier."""
    own = F.map_filter(F.coalesce("qualifiers", F.create_map().cast("map<string,string>")), lambda k, _: k != "verifier")
    marked = relations.where(F.col(accepted)).withColumn("verified", F.lit(True))
    return marked.withColumn("qualifiers", F.map_concat(own, F.create_map(F.lit("verifier"), F.lit(verifier)))).drop(accepted)
