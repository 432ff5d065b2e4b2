"""Property-graph operators over entity, relation and mention tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import tokens
from lorekeep.functions.time import DAY, seconds_text, utc_seconds
from lorekeep.sources.tables import materialise

EDGE = ["project", "from_entity", "relation_type", "to_entity"]


def merge_relations(observed: DataFrame, seq: str = "created_at") -> DataFrame:
    """One row per (project, from, type, to): greatest confidence, verified if any was, session, tool
    and time of the newest observation, and the union of qualifiers.

    Later non-empty qualifier values win; ``seq`` orders observations, ties go to the greater session,
    tool and value. Empty qualifier values never replace others.
    """
    order = F.struct(F.coalesce(F.col(seq), F.lit("")).alias("s"), F.coalesce("session_id", F.lit("")).alias("i"), F.coalesce("origin_tool", F.lit("")).alias("t"))
    rows = observed.withColumn("_o", order)
    head = rows.groupBy(*EDGE).agg(
        F.max("confidence").alias("confidence"),
        F.coalesce(F.bool_or("verified"), F.lit(False)).alias("verified"),
        F.max("_o").alias("_o"),
    )
    each = rows.select(*EDGE, "_o", F.explode("qualifiers").alias("k", "v")).where(F.coalesce("v", F.lit("")) != "")
    latest = each.groupBy(*EDGE, "k").agg(F.max_by("v", F.struct("_o", "v")).alias("v"))
    maps = latest.groupBy(*EDGE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("qualifiers"))
    on = [F.col(f"h.{c}").eqNullSafe(F.col(f"m.{c}")) for c in EDGE]
    joined = head.alias("h").join(maps.alias("m"), on, "left")
    none = F.create_map().cast("map<string,string>")
    return joined.select(*[f"h.{c}" for c in EDGE], "h.confidence", "h.verified", F.col("h._o.i").alias("session_id"), F.col("h._o.t").alias("origin_tool"), F.col("h._o.s").alias("created_at"), F.coalesce("m.qualifiers", none).alias("qualifiers"))


def upsert_entities(entities: DataFrame, version: Column) -> DataFrame:
    """The newest row of each id by ``version``."""
    rest = [c for c in entities.columns if c != "id"]
    return entities.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(version, *rest)).alias("r")).select("id", "r.*")


def delete_relations(relations: DataFrame, dropped: DataFrame) -> DataFrame:
    """Relations without those named by (project, from_entity, relation_type, to_entity)."""
    return relations.join(dropped.select(*EDGE), EDGE, "left_anti")


def delete_entities(entities: DataFrame, relations: DataFrame, mentions: DataFrame, dropped: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the entities of ``dropped`` (id), their edges and their mentions."""
    gone = dropped.select("id")
    out = relations.join(gone, F.col("from_entity") == F.col("id"), "left_anti").join(gone, F.col("to_entity") == F.col("id"), "left_anti")
    return entities.join(gone, "id", "left_anti"), out, mentions.join(gone, F.col("entity_id") == F.col("id"), "left_anti")


def adjacency(relations: DataFrame, direction: str = "both") -> DataFrame:
    """Distinct (u, v) steps along relations: outgoing, incoming or both ways; loops are no steps."""
    out = relations.select(F.col("from_entity").alias("u"), F.col("to_entity").alias("v"))
    back = out.select(F.col("v").alias("u"), F.col("u").alias("v"))
    steps = {"outgoing": out, "incoming": back, "both": out.union(back)}[direction]
    return steps.where("u != v").distinct()


def k_hop(steps: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, node, hop): nodes within ``hops`` steps of each seed, at their least distance, seeds apart.

    ``seeds`` has one column, seed. Each hop is one join with the steps; the nodes met so far are
    written between hops, so that no hop computes the ones before it again.
    """
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    front = seen
    for h in range(1, hops + 1):
        reached = front.join(steps, front.node == steps.u).select("seed", F.col("v").alias("node")).distinct()
        front = reached.join(seen, ["seed", "node"], "left_anti").withColumn("hop", F.lit(h))
        if h < hops:
            front = materialise(front, "hop")
        seen = seen.union(front)
    return seen.where("hop > 0")


def shortest_paths(steps: DataFrame, pairs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(source, target, found, length, path): a shortest path of each pair; of several the least as a list.

    Breadth first, at once from all sources or backwards from all targets, whichever are fewer: each level
    keeps the least path of every node met for the first time. The search ends when a level meets nothing
    new, so found = false stands for pairs that no path connects (within ``max_depth``, if given).
    """
    sides = pairs.agg(F.count_distinct("source").alias("s"), F.count_distinct("target").alias("t")).first()
    root, other = ("source", "target") if sides.s <= sides.t else ("target", "source")
    at, to = ("u", "v") if root == "source" else ("v", "u")
    longer = F.concat("path", F.array(to)) if root == "source" else F.concat(F.array(to), F.col("path"))
    front = materialise(pairs.select(root).distinct().select(root, F.col(root).alias("node"), F.array(root).alias("path")), "path")
    seen, depth = front, 0
    while max_depth is None or depth < max_depth:
        reached = front.join(steps, front.node == steps[at]).select(root, F.col(to).alias("node"), longer.alias("path"))
        fresh = reached.join(seen, [root, "node"], "left_anti").groupBy(root, "node").agg(F.min("path").alias("path"))
        front = materialise(fresh, "path")
        if front.isEmpty():
            break
        depth += 1
        seen = seen.union(front)
        if depth % 16 == 0:  # keeps the plan short
            seen = materialise(seen, "path")
    met = pairs.join(seen.withColumnRenamed("node", other), ["source", "target"], "left")
    return met.select("source", "target", F.col("path").isNotNull().alias("found"), F.coalesce(F.size("path") - 1, F.lit(-1)).alias("length"), "path")


def validity_bounds(qualifiers: Column) -> tuple[Column, Column]:
    """(from, to) of a relation as epoch seconds: a date starts at its first and ends at its last second.

    A missing, empty or unreadable bound is null, which leaves its side open.
    """
    f, t = (F.try_element_at(qualifiers, F.lit(k)) for k in ("valid_from", "valid_to"))
    return utc_seconds(f), utc_seconds(t, end_of_day=True)


def valid_at(qualifiers: Column, as_of: str) -> Column:
    """Whether a relation holds at an instant, in whatever spelling; an open side and an empty ``as_of`` always fit."""
    if not as_of:
        return F.lit(True)
    at = utc_seconds(F.lit(as_of))
    start, end = validity_bounds(qualifiers)
    return F.coalesce(start <= at, F.lit(True)) & F.coalesce(at <= end, F.lit(True))


def facts_at(relations: DataFrame, entities: DataFrame | None, as_of: str, direction: str = "outgoing") -> DataFrame:
    """(entity, other, relation_type, direction, confidence, valid_from, valid_to, is_current) of all entities.

    A fact is current when it has no valid_to.
    """
    start, end = (F.coalesce(F.try_element_at("qualifiers", F.lit(k)), F.lit("")) for k in ("valid_from", "valid_to"))
    rows = relations.where(valid_at(F.col("qualifiers"), as_of))
    parts = []
    if direction in ("outgoing", "both"):
        parts.append(rows.select(F.col("from_entity").alias("entity"), F.col("to_entity").alias("other"), "relation_type", F.lit("outgoing").alias("direction"), "confidence", start.alias("valid_from"), end.alias("valid_to")))
    if direction in ("incoming", "both"):
        parts.append(rows.select(F.col("to_entity").alias("entity"), F.col("from_entity").alias("other"), "relation_type", F.lit("incoming").alias("direction"), "confidence", start.alias("valid_from"), end.alias("valid_to")))
    out = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    if entities is not None:
        out = out.join(entities.select(F.col("id").alias("entity")).distinct(), "entity", "left_semi")
    return out.withColumn("is_current", F.col("valid_to") == "")


def _next_other(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``head``, whether a row's target differs from the row before by (start, to_entity), and
    ``next``, the start of the first later row with another target than the row's own."""
    w = Window.partitionBy(*keys).orderBy(F.desc("start"), F.desc("to_entity"))
    flagged = facts.withColumn("head", ~F.lead("to_entity").over(w).eqNullSafe(F.col("to_entity")))
    return flagged.withColumn("next", F.last(F.when(F.col("head"), F.col("start")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))


def supersede(relations: DataFrame, functional: list[str]) -> DataFrame:
    """Adds ``closed_at``: where a later relation of one subject and functional type has another target,
    the earlier, still open one ends when the first such relation begins; repeats of its own target
    between them change nothing.

    A relation starts at its valid_from, else when it was observed, whatever the spelling of either; relations
    without a readable start neither close others nor are closed. Repeated observations count once. Windows hold
    one day of a subject; days pass on to each other the heads of their first two and their last run of one target.
    """
    start = F.coalesce(validity_bounds(F.col("qualifiers"))[0], utc_seconds(F.col("created_at")))
    rows = relations.where(F.col("relation_type").isin(functional)).withColumn("start", start)
    subject = ["project", "from_entity", "relation_type"]
    facts = rows.where("to_entity is not null and start is not null").select(*subject, "to_entity", "start").distinct()
    facts = facts.withColumn("day", F.floor(F.col("start") / DAY))
    w = Window.partitionBy(*subject, "day").orderBy("start", "to_entity")
    days = _next_other(facts, [*subject, "day"]).withColumn("run", F.sum(F.col("head").cast("int")).over(w))
    days = materialise(days, "days")
    heads = days.where("head and (run <= 2 or next is null)").withColumn("tail", F.col("next").isNull()).drop("next", "head", "run")
    after = _next_other(heads, subject).where("tail").select(*subject, "day", F.col("next").alias("later"))
    same = lambda x, y, cols: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in cols]
    ends = days.alias("d").join(after.alias("a"), same("d", "a", [*subject, "day"]), "left")
    ends = ends.select(*[f"d.{c}" for c in [*subject, "to_entity", "start"]], F.coalesce("d.next", "a.later").alias("end"))
    open_ = F.trim(F.coalesce(F.try_element_at("r.qualifiers", F.lit("valid_to")), F.lit(""))) == ""
    closed = rows.alias("r").join(ends.alias("e"), same("r", "e", [*subject, "to_entity", "start"]), "left")
    return closed.select("r.*", F.when(open_, seconds_text(F.col("e.end"))).alias("closed_at"))


def adjust_confidence(relations: DataFrame, deltas: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Relations with the confidence of an entity's outgoing edges shifted by its delta and clamped.

    ``deltas`` holds (entity, delta); ``changed`` tells whether the value moved.
    """
    d = deltas.select(F.col("entity").alias("from_entity"), "delta")
    moved = F.round(F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce("confidence", F.lit(0.5)) + F.coalesce("delta", F.lit(0.0)))), 6)
    out = relations.join(d, "from_entity", "left").withColumn("new_confidence", F.when(F.col("delta").isNull(), F.col("confidence")).otherwise(moved))
    return out.withColumn("changed", F.col("delta").isNotNull() & ~F.col("new_confidence").eqNullSafe(F.col("confidence"))).drop("delta")


def name_index(entities: DataFrame) -> DataFrame:
    """(project, term, id): an entity's whole lower-case name and its tokens of two or more characters."""
    name = F.lower("name")
    terms = F.array_distinct(F.concat(F.array(name), F.filter(tokens(F.col("name")), lambda t: F.length(t) >= 2)))
    return entities.where(F.col("name").isNotNull()).select("project", F.explode(terms).alias("term"), "id").distinct()


def _grams(term: Column) -> Column:
    """Distinct runs of three signs of a term; of a shorter one the term itself."""
    at = F.sequence(F.lit(1), F.greatest(F.length(term) - 2, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substring(term, i, F.lit(3))))


def lookup_entities(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, project, term, id, exact): entities named by query terms.

    A term without an exact entry is looked for inside the entries of its project: its rarest three signs choose
    the entries that are compared. Terms of one or two signs are found by entries' own runs of so many signs.
    ``terms`` holds (query_id, project, term).
    """
    asked = terms.select("query_id", "project", F.lower("term").alias("term")).where("term <> ''").distinct()
    exact = asked.join(index, ["project", "term"]).withColumn("exact", F.lit(True))
    entries = index.select("project", "term").distinct()
    left = asked.join(entries, ["project", "term"], "left_anti").withColumnRenamed("term", "asked")
    grams = left.select("project", "asked").distinct().select("project", "asked", F.explode(_grams(F.col("asked"))).alias("gram"))
    at = F.sequence(F.lit(1), F.length("term"))
    runs = F.flatten(F.transform(at, lambda i: F.array(*[F.substring("term", i, F.lit(n)) for n in (1, 2, 3)])))
    held = entries.select("project", "term", F.explode(F.array_distinct(runs)).alias("gram"))
    held = held.join(grams.select("project", "gram").distinct(), ["project", "gram"], "left_semi")
    count = held.groupBy("project", "gram").agg(F.count(F.lit(1)).alias("n"))
    best = grams.join(count, ["project", "gram"]).groupBy("project", "asked").agg(F.min(F.struct("n", "gram")).alias("g"))
    found = best.select("project", "asked", "g.gram").join(held, ["project", "gram"]).where(F.contains("term", "asked"))
    inside = left.join(found.select("project", "asked", "term"), ["project", "asked"]).join(index, ["project", "term"])
    part = inside.select("query_id", "project", F.col("asked").alias("term"), "id").distinct().withColumn("exact", F.lit(False))
    return exact.select("query_id", "project", "term", "id", "exact").union(part)


def chunks_near(mentions: DataFrame, entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """(entity_id, chunk_id, doc_id, chunk_idx): the chunks that mention the given entities (id)."""
    near = mentions.join(entities.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    return near.join(chunks.select(F.col("id").alias("chunk_id"), "doc_id", "chunk_idx"), "chunk_id").select("entity_id", "chunk_id", "doc_id", "chunk_idx")


def evidence_mentions(relations: DataFrame) -> DataFrame:
    """(chunk_id, entity_id): both ends of a relation are mentioned by the chunk that is its evidence."""
    at = F.try_element_at("qualifiers", F.lit("evidence_chunk_id"))
    rows = relations.select(at.alias("chunk_id"), F.explode(F.array("from_entity", "to_entity")).alias("entity_id"))
    return rows.where(F.coalesce("chunk_id", F.lit("")) != "").distinct()
