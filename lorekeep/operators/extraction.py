"""Heuristic entity extraction and resolution by canonical key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import canonical_key, entity_id

# Words that no capitalised phrase may contain.
STOP_WORDS = "the a an in on at to for of and or is are was were it this that with from".split()
# Fixed patterns of names.
PHRASE = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b"
CAMEL = r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b"
BACKTICK = r"`([^`]{2,40})`"
#: From the most specific type to the least (fixed values).
TYPE_ORDER = ("code", "identifier", "person", "org", "tool", "concept")


def _typed(names: Column, kind: str) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type")))


def capitalised(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return _typed(F.filter(found, lambda p: ~F.arrays_overlap(F.split(F.lower(p), r"\s+"), stop)), "concept")


def camel_case(text: Column) -> Column:
    return _typed(F.regexp_extract_all(text, F.lit(CAMEL), F.lit(0)), "identifier")


def backticks(text: Column) -> Column:
    return _typed(F.regexp_extract_all(text, F.lit(BACKTICK), F.lit(1)), "code")


def heuristic(text: Column) -> Column:
    """array<struct<name,type>>: capitalised phrases, CamelCase words, back-tick spans, in that order."""
    return F.concat(capitalised(text), camel_case(text), backticks(text))


EXTRACTORS: dict[str, Callable[[Column], Column]] = {"heuristic": heuristic}


def extractor(name: str) -> Callable[[Column], Column]:
    if name not in EXTRACTORS:
        raise ValueError(f"unknown extractor {name!r}; known: {sorted(EXTRACTORS)}")
    return EXTRACTORS[name]


def surface_forms(docs: DataFrame, keys: list[str], text: str = "text", kind: str = "heuristic") -> DataFrame:
    """(keys..., pos, name, type): extracted names of every text; names without a canonical key are dropped."""
    each = docs.select(*keys, F.posexplode(extractor(kind)(F.col(text))).alias("pos", "e")).select(*keys, "pos", "e.name", "e.type")
    return each.where(canonical_key(F.col("name")) != "")


def type_rank(kind: Column) -> Column:
    rank = F.lit(len(TYPE_ORDER))
    for i, t in reversed(list(enumerate(TYPE_ORDER))):
        rank = F.when(kind == t, F.lit(i)).otherwise(rank)
    return rank


def upper_count(name: Column) -> Column:
    return F.length(F.regexp_replace(name, r"\P{Lu}", ""))


def registry(names: DataFrame, by: list[str]) -> DataFrame:
    """(by..., key, name, type, aliases, merged): one row per canonical key.

    The display name has the most upper-case letters, then is the shortest, then the least; the type is
    the most specific. ``aliases`` are the sorted spellings, ``merged`` is one less than their number.
    """
    keyed = names.withColumn("key", canonical_key(F.col("name"))).where("key != ''")
    n = F.col("name")
    grouped = keyed.groupBy(*by, "key").agg(
        F.min_by(n, F.struct(-upper_count(n), F.length(n), n)).alias("name"),
        F.min_by("type", F.struct(type_rank(F.col("type")), F.col("type"))).alias("type"),
        F.sort_array(F.collect_set("name")).alias("aliases"),
    )
    return grouped.withColumn("merged", F.size("aliases") - 1)


def mentions(docs: DataFrame, keys: list[str], project: str = "project") -> DataFrame:
    """(keys..., entity_id): which text mentions which canonical entity."""
    forms = surface_forms(docs, [*keys, project])
    return forms.select(*keys, entity_id(F.col(project), F.col("name")).alias("entity_id")).distinct()


def first_by_key(forms: DataFrame, keys: list[str]) -> DataFrame:
    """The first form of each canonical key of a text."""
    w = Window.partitionBy(*keys, canonical_key(F.col("name"))).orderBy("pos")
    return forms.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
