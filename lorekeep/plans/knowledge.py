"""Entity, relation, graph, verification and pruning queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import canonical_key, entity_id, fingerprint, note_doc_id
from lorekeep.operators import chunking, edges, extraction, fusion, graph, learn, pagerank, verify
from lorekeep.plans.problems import _STAMP, _sec
from lorekeep.sources import files
from lorekeep.sources.tables import materialise, table

AS_OF = "2025-06-01"
FUNCTIONAL = ["located_in", "reports_to", "member_of"]


def _rel(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relations")


def _once(r: DataFrame) -> DataFrame:
    """Rows of relations without exact copies; maps cannot be compared, their sorted entries can."""
    rest = [c for c in r.columns if c != "qualifiers"]
    return r.withColumn("_q", F.array_sort(F.map_entries("qualifiers"))).dropDuplicates([*rest, "_q"]).drop("_q")


def _ent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").distinct()


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth entity by the number its id stands for."""
    return _ent(spark, d).where(F.conv("id", 16, 10).cast("decimal(20,0)") % 50 == 0)


def reconstruct_document(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("id", "doc_id", "chunk_idx", "text", "project").distinct()
    return chunking.reconstruct(c, ["project", "doc_id"])


def document_ids(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", note_doc_id(F.coalesce("source", F.lit("")), F.col("text")).alias("note_id"), fingerprint(F.col("text")).alias("fingerprint"))


def pending_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose content an ingest up to May 2026 had not seen under their source."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("path"), fingerprint(F.col("text")).alias("fingerprint"), "created_at")
    return files.pending(t, t.where("created_at < timestamp '2026-05-01 00:00:00'")).select("doc_id", "path", "fingerprint")


def relation_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Verified relations first; of all others only new keys are added."""
    r = _rel(spark, d).select(*graph.EDGE, F.coalesce("verified", F.lit(False)).alias("verified")).distinct()
    merged = files.insert_ignore(r.where("verified"), r.where("not verified"), graph.EDGE)
    return merged.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.count_if("verified").alias("verified"))


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, d, "documents"))


def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    return extraction.surface_forms(table(spark, d, "documents"), ["doc_id"])


def document_mentions(spark: SparkSession, d: str) -> DataFrame:
    return extraction.mentions(table(spark, d, "documents").where("project is not null"), ["doc_id"])


def entity_registry(spark: SparkSession, d: str) -> DataFrame:
    r = extraction.registry(_ent(spark, d).where("name is not null"), ["project"])
    return r.select("project", "key", "name", "type", F.array_join("aliases", "|").alias("aliases"), "merged")


def entity_ids(spark: SparkSession, d: str) -> DataFrame:
    return _ent(spark, d).where("name is not null").select("id", canonical_key(F.col("name")).alias("key"), entity_id(F.col("project"), F.col("name")).alias("canonical_id"))


def relation_upsert(spark: SparkSession, d: str) -> DataFrame:
    m = graph.merge_relations(_rel(spark, d))
    q = F.array_join(F.transform(F.array_sort(F.map_entries("qualifiers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return m.select("project", "from_entity", "relation_type", "to_entity", "confidence", "verified", "created_at", q.alias("qualifiers"))


def entity_upsert(spark: SparkSession, d: str) -> DataFrame:
    return graph.upsert_entities(table(spark, d, "entities"), F.coalesce("name", F.lit("")))


def delete_relation(spark: SparkSession, d: str) -> DataFrame:
    """Without the relations that were never verified and have little confidence."""
    r = _rel(spark, d).select(*graph.EDGE, "confidence", "verified").distinct()
    gone = r.where("confidence < 0.2 and not coalesce(verified, false)")
    return graph.delete_relations(r, gone).select(*graph.EDGE, "confidence")


def delete_entity(spark: SparkSession, d: str) -> DataFrame:
    """Relations left when entities without a type are deleted."""
    r = _rel(spark, d)
    _, left, _ = graph.delete_entities(_ent(spark, d), r.select(*graph.EDGE).distinct(), graph.evidence_mentions(r), _ent(spark, d).where("type is null"))
    return left


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select(F.col("id").alias("seed"))


def khop_1(spark: SparkSession, d: str) -> DataFrame:
    return graph.k_hop(graph.adjacency(_rel(spark, d)), _seeds(spark, d), 1)


def khop_2(spark: SparkSession, d: str) -> DataFrame:
    return graph.k_hop(graph.adjacency(_rel(spark, d)), _seeds(spark, d), 2)


def khop_outgoing(spark: SparkSession, d: str) -> DataFrame:
    return graph.k_hop(graph.adjacency(_rel(spark, d), "outgoing"), _seeds(spark, d), 2)


def asof_neighbors(spark: SparkSession, d: str) -> DataFrame:
    now = _rel(spark, d).where(graph.valid_at(F.col("qualifiers"), AS_OF))
    return graph.k_hop(graph.adjacency(now), _seeds(spark, d), 2)


def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """From every fiftieth entity to its project's least entity id that takes part in a relation."""
    r = _rel(spark, d)
    least = r.groupBy("project").agg(F.min("from_entity").alias("target"))
    pairs = _asked(spark, d).join(least, "project").select(F.col("id").alias("source"), "target").where("source <> target")
    p = graph.shortest_paths(materialise(graph.adjacency(r), "steps"), materialise(pairs, "pairs"))
    return p.select("source", "target", "found", "length", F.array_join("path", ">").alias("path"))


def trace_path(spark: SparkSession, d: str) -> DataFrame:
    """As ``shortest_path``, along the direction of relations only."""
    r = _rel(spark, d)
    least = r.groupBy("project").agg(F.min("from_entity").alias("target"))
    pairs = _asked(spark, d).join(least, "project").select(F.col("target").alias("source"), F.col("id").alias("target")).where("source <> target")
    p = graph.shortest_paths(materialise(graph.adjacency(r, "outgoing"), "steps"), materialise(pairs, "pairs"))
    return p.select("source", "target", "found", "length", F.array_join("path", ">").alias("path"))


def asof_facts(spark: SparkSession, d: str) -> DataFrame:
    return graph.facts_at(_once(_rel(spark, d)), _ent(spark, d), AS_OF, "both")


def supersede_facts(spark: SparkSession, d: str) -> DataFrame:
    s = graph.supersede(_once(_rel(spark, d).select("project", "from_entity", "relation_type", "to_entity", "created_at", "qualifiers")), FUNCTIONAL)
    return s.where("closed_at is not null").select("project", "from_entity", "relation_type", "to_entity", "created_at", "closed_at")


def adjust_confidence(spark: SparkSession, d: str) -> DataFrame:
    r = _once(_rel(spark, d))
    deg = r.groupBy(F.col("from_entity").alias("entity")).agg(F.round(0.02 / F.sqrt(F.count(F.lit(1))), 6).alias("delta")).where("delta < 0.02")
    return graph.adjust_confidence(r, deg).groupBy("from_entity").agg(F.count_if("changed").alias("changed"), F.sum(F.col("new_confidence").cast("decimal(18,6)")).cast("double").alias("confidence"))


def entity_term_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Terms are the first words of every fiftieth entity's name."""
    e = _ent(spark, d)
    terms = _asked(spark, d).where("name is not null").select(F.col("id").alias("query_id"), "project", F.split(F.lower("name"), " ").getItem(0).alias("term"))
    return graph.lookup_entities(graph.name_index(e), terms)


def chunks_near_entity(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("id", "doc_id", "chunk_idx").distinct()
    return graph.chunks_near(graph.evidence_mentions(_rel(spark, d)), _ent(spark, d).where("type = 'org'"), c)


def graph_search(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the asked entities and of their neighbours, nearest first."""
    m = graph.evidence_mentions(_rel(spark, d))
    near = khop_1(spark, d).unionByName(_seeds(spark, d).select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop")))
    hit = near.join(m, near.node == m.entity_id).select("seed", "chunk_id", "hop")
    best = hit.groupBy("seed", "chunk_id").agg(F.min("hop").alias("hop"))
    from lorekeep.operators.lexical import top_k

    return top_k(best.withColumn("score", -F.col("hop")), 10, ["seed"], "score", "chunk_id").select("seed", "chunk_id", "hop", "rank")


def fused_entity_search(spark: SparkSession, d: str) -> DataFrame:
    """Graph neighbourhood, reliable facts and shared projects fused by reciprocal ranks."""
    from lorekeep.operators.lexical import top_k

    deg = _rel(spark, d).groupBy(F.col("to_entity").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    hops = khop_2(spark, d)
    near = top_k(hops.withColumn("s", -F.col("hop")), 50, ["seed"], "s", "node").select("seed", "node", "rank")
    known = top_k(hops.join(deg, "node"), 50, ["seed"], "deg", "node").select("seed", "node", "rank")
    fused = fusion.reciprocal_rank_fusion([near, known], ["seed"], "node")
    return fused.where("rank <= 10").select("seed", "node", "score", "rank")


def ppr_transition(spark: SparkSession, d: str) -> DataFrame:
    return pagerank.transition(_rel(spark, d)).select("u", "v", F.round("p", 6).alias("p"))


def _ppr(spark: SparkSession, d: str, rounds: int | None) -> DataFrame:
    nodes = _ent(spark, d).select(F.col("id").alias("node"))
    return pagerank.personalised_pagerank(pagerank.transition(_rel(spark, d)), nodes, _asked(spark, d).select(F.col("id").alias("node")), rounds)


def ppr_fixed_rounds(spark: SparkSession, d: str) -> DataFrame:
    return _ppr(spark, d, 3).select("node", F.round("score", 6).alias("score"))


def ppr_topk(spark: SparkSession, d: str) -> DataFrame:
    return pagerank.top_nodes(_ppr(spark, d, None))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return edges.edge_features(edges.undirected(_rel(spark, d), "from_entity", "to_entity"))


def edge_features(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d)


def spurious_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges.spurious(_features(spark, d)).where("suggested").select("a", "b", "spuriousness")


def spurious_edges_learned(spark: SparkSession, d: str) -> DataFrame:
    """The logistic form with stated weights, as its SQL has them; ``spurious_edges_trained`` fits its own."""
    return edges.spurious(_features(spark, d), {"heuristic": 2.0, "jaccard": -1.5, "common": -1.0, "deg_u": 0.4, "deg_v": 0.4, "hub": 0.5}, -0.8).select("a", "b", "spuriousness", "suggested")


def _drawn(*keys: str) -> Column:
    """A hash-drawn fifth of the rows."""
    return F.pmod(F.xxhash64(*keys), F.lit(5)) == 0


def _edge_labels(spark: SparkSession, d: str) -> DataFrame:
    """(project, a, b, label): edges to prune (1) have only refused relations, edges to keep (0) a verified one."""
    r = _rel(spark, d).where("verified is not null and from_entity <> to_entity")
    return r.groupBy("project", F.least("from_entity", "to_entity").alias("a"), F.greatest("from_entity", "to_entity").alias("b")).agg((~F.bool_or("verified")).cast("int").alias("label"))


def _edge_models(spark: SparkSession, d: str, features: DataFrame) -> DataFrame:
    rows = _edge_labels(spark, d).join(features, ["a", "b"])
    return learn.calibrate_groups(rows, "project", edges.FEATURES, "label", _drawn("project", "a", "b"), least=20)


def _named(models: DataFrame, features: list[str]) -> DataFrame:
    """(project, name, value): the numbers of each project's fit; projects without one have their row counts only."""
    parts = [(f, F.col("weights")[i]) for i, f in enumerate(features)] + [(n, F.col(c)) for n, c in (("intercept", "intercept"), ("train_loss", "loss"), ("auc", "auc"), ("n_train", "n_train"), ("n_test", "n_test"))]
    rows = models.select("project", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.round(c.cast("double"), 6).alias("value")) for n, c in parts])).alias("r"))
    return rows.select("project", "r.name", "r.value").where("value is not null")


def edge_scorer(spark: SparkSession, d: str) -> DataFrame:
    """Learned weights of the edge scorer of each project, from edges labelled by their relations."""
    return _named(_edge_models(spark, d, _features(spark, d)), edges.FEATURES)


def spurious_edges_trained(spark: SparkSession, d: str) -> DataFrame:
    """Edges of each project scored by its learned weights; by the heuristic where a project has no fit."""
    f = materialise(_features(spark, d), "features")
    m = _edge_models(spark, d, f).select(F.col("project").alias("_p"), "weights", "intercept")
    of = _rel(spark, d).select("project", F.least("from_entity", "to_entity").alias("a"), F.greatest("from_entity", "to_entity").alias("b")).distinct()
    rows = of.join(f, ["a", "b"]).join(m, F.col("project").eqNullSafe(F.col("_p")), "left")
    score = edges.logistic({n: F.col("weights")[i] for i, n in enumerate(edges.FEATURES)}, F.col("intercept"))
    s = F.when(F.col("weights").isNotNull(), score).otherwise(F.col("heuristic"))
    return rows.select("project", "a", "b", s.alias("spuriousness"), F.col("weights").isNotNull().alias("learned")).withColumn("suggested", F.col("spuriousness") >= edges.SPURIOUS)


def prune_isolated(spark: SparkSession, d: str) -> DataFrame:
    r = _rel(spark, d)
    return edges.isolated_entities(_ent(spark, d), r, graph.evidence_mentions(r), _ent(spark, d).where("type = 'tool'").select("id")).select("id", "name", "project")


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    known = _rel(spark, d).where("verified").select(F.least("from_entity", "to_entity").alias("a"), F.greatest("from_entity", "to_entity").alias("b"))
    return edges.review_candidates(edges.spurious(_features(spark, d)), ["a", "b"], known).select("a", "b", "spuriousness", "distance")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    r = _once(_rel(spark, d)).withColumn("a", F.least("from_entity", "to_entity")).withColumn("b", F.greatest("from_entity", "to_entity"))
    t = edges.topology(edges.undirected(r, "from_entity", "to_entity"))
    j = r.join(t, ["a", "b"], "left").select("project", "from_entity", "relation_type", "to_entity", "confidence", "verified", "created_at", F.col("n_common").alias("common_neighbors"), F.when(F.col("from_entity") == F.col("a"), F.col("deg_a")).otherwise(F.col("deg_b")).alias("degree_from"), F.when(F.col("from_entity") == F.col("a"), F.col("deg_b")).otherwise(F.col("deg_a")).alias("degree_to"))
    return verify.components(j).withColumn("score", verify.heuristic_score()).withColumn("level", verify.decision(F.col("score")))


_KEY = ["project", "from_entity", "relation_type", "to_entity", "created_at"]


def relation_scores(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return s.select(*_KEY, F.round("base", 6).alias("base"), F.round("jaccard", 6).alias("jaccard"), "type_boost", "isolated", "score", "level")


def verification_cap(spark: SparkSession, d: str) -> DataFrame:
    c = verify.cap_calls(_scored(spark, d), ["project"], ["created_at", "from_entity", "relation_type", "to_entity", "score"])
    return c.groupBy("project", "level").agg(F.count(F.lit(1)).alias("n"), F.count_if("ask").alias("asked"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers a model might have given, spelled from what is known of each relation."""
    conf = F.format_string("%.2f", F.floor(F.coalesce("confidence", F.lit(0.5)) * 100) / 100)
    word = F.when(F.col("verified"), "Verdict: grounded").when(~F.col("verified"), "PARTIAL support")
    return _once(_rel(spark, d)).select(*_KEY, F.coalesce(F.concat(word, F.lit(", CONFIDENCE: "), conf), F.lit("")).alias("answer"))


def verdict_parse(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).withColumn("p", verify.parse_verdict(F.col("answer"))).groupBy("p.verdict", "p.accepted").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p.confidence"), 4).alias("confidence"))


def relation_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every relation spelled as a line of an answer, and read back."""
    conf = F.format_string(" | CONFIDENCE: %.2f", F.floor(F.coalesce("confidence", F.lit(0.5)) * 100) / 100)
    line = F.concat("from_entity", F.lit(" -["), F.upper("relation_type"), F.lit("]-> "), "to_entity", conf)
    answers = _rel(spark, d).where("session_id <> ''").select("session_id", line.alias("answer"))
    return verify.parse_relation_lines(answers, ["session_id"])


def calibrated_scorer(spark: SparkSession, d: str) -> DataFrame:
    """Learned weights of the relation scorer of each project, from verified and unverified relations."""
    rows = _scored(spark, d).where("verified is not null").withColumn("label", F.col("verified").cast("int"))
    features = ["base", "jaccard", "type_boost", "isolated"]
    return _named(learn.calibrate_groups(rows, "project", features, "label", _drawn(*_KEY)), features)


def relation_scores_trained(spark: SparkSession, d: str) -> DataFrame:
    """Relations scored by their project's learned weights, by the heuristic where it has none."""
    rows = _scored(spark, d)
    features = ["base", "jaccard", "type_boost", "isolated"]
    labelled = rows.where("verified is not null").withColumn("label", F.col("verified").cast("int"))
    models = learn.calibrate_groups(labelled, "project", features, "label", _drawn(*_KEY))
    return learn.learned_score(rows, models, "project", features, F.col("score")).select(*_KEY, "score", "learned_score")


def verify_and_merge(spark: SparkSession, d: str) -> DataFrame:
    """Observations that a model's answers accept, stamped with their verifier and merged into the graph."""
    key = F.struct(*_KEY)
    judged = _answers(spark, d).withColumn("accepted", verify.parse_verdict(F.col("answer")).accepted).where("accepted")
    said = judged.select(key.alias("_k")).distinct()
    rows = _once(_rel(spark, d)).withColumn("_k", key)
    accepted = rows.join(said, "_k", "left_semi").drop("_k").withColumn("accepted", F.lit(True))
    merged = graph.merge_relations(verify.stamped(accepted, "vog"))
    stamp = F.try_element_at("qualifiers", F.lit("verifier"))
    return merged.groupBy("project", stamp.alias("verifier")).agg(F.count(F.lit(1)).alias("relations"), F.count_if("verified").alias("verified"))


QUERIES = {
    f.__name__: f
    for f in (
        document_ids, pending_documents, relation_insert_ignore, reconstruct_document, chunk_documents, extract_entities, document_mentions, entity_registry, entity_ids, relation_upsert, entity_upsert, delete_relation, delete_entity, khop_1, khop_2, khop_outgoing, asof_neighbors,
        shortest_path, trace_path, asof_facts, supersede_facts, adjust_confidence, entity_term_lookup, chunks_near_entity, graph_search, fused_entity_search, ppr_transition, ppr_fixed_rounds, ppr_topk, edge_features, spurious_edges,
        spurious_edges_learned, prune_isolated, review_queue, relation_scores, verification_cap, verdict_parse, relation_lines, calibrated_scorer, edge_scorer, spurious_edges_trained, relation_scores_trained, verify_and_merge,
    )
}

_E = "e AS (SELECT DISTINCT * FROM entities)"
_R = "r AS (SELECT DISTINCT * FROM relations)"
_ASKED = "asked AS (SELECT * FROM e WHERE CAST('0x' || id AS UBIGINT) % 50 = 0)"
_VALID = f"""CAST({_sec("trim(qualifiers['valid_from'])")} AS BIGINT) AS vf, CAST({_sec("trim(qualifiers['valid_to'])", 86399)} AS BIGINT) AS vt"""
_AT = "1748736000"
_HOLDS = f"(vf IS NULL OR vf <= {_AT}) AND (vt IS NULL OR {_AT} <= vt)"
_NOW = f"now AS (SELECT * FROM (SELECT *, {_VALID} FROM relations) WHERE {_HOLDS})"
_BOTH = "adj AS (SELECT DISTINCT u, v FROM (SELECT from_entity AS u, to_entity AS v FROM {t} UNION ALL SELECT to_entity, from_entity FROM {t}) WHERE u <> v)"
_HOPS = """h1 AS (SELECT id AS seed, v AS node, 1 AS hop FROM asked JOIN adj ON u = id),
h2 AS (SELECT DISTINCT seed, v AS node, 2 AS hop FROM h1 JOIN adj ON u = node WHERE v <> seed AND (seed, v) NOT IN (SELECT (seed, node) FROM h1))"""
_MENTIONS = "m AS (SELECT DISTINCT c AS chunk_id, x AS entity_id FROM (SELECT qualifiers['evidence_chunk_id'] AS c, unnest([from_entity, to_entity]) AS x FROM relations) WHERE coalesce(c, '') <> '')"
_TRANS = """w AS (SELECT u, v, max(w) AS w FROM (SELECT from_entity AS u, to_entity AS v, coalesce(confidence, 1) AS w FROM relations UNION ALL SELECT to_entity, from_entity, coalesce(confidence, 1) FROM relations) WHERE u <> v GROUP BY u, v HAVING max(w) > 0),
p AS (SELECT u, v, w / sum(w) OVER (PARTITION BY u) AS p FROM w)"""
_TOPO = f"""{_BOTH.format(t="relations")}, pr AS (SELECT u AS a, v AS b FROM adj WHERE u < v), deg AS (SELECT u, count(*) AS d FROM adj GROUP BY u),
cn AS (SELECT a, b, count(*) AS c FROM pr JOIN adj x ON x.u = a JOIN adj y ON y.u = b AND y.v = x.v GROUP BY a, b),
topo AS (SELECT pr.a, pr.b, coalesce(c, 0) AS n_common, da.d AS deg_a, db.d AS deg_b FROM pr JOIN deg da ON da.u = a JOIN deg db ON db.u = b LEFT JOIN cn USING (a, b))"""
_FEAT = f"""{_TOPO}, feat AS (SELECT a, b, least(1.0, round(1 - n_common / greatest(deg_a, deg_b, 1) + CASE WHEN greatest(deg_a, deg_b) > 20 THEN 0.15 ELSE 0 END::DOUBLE, 4))::DOUBLE AS heuristic,
 round(n_common / greatest(deg_a + deg_b - n_common, 1), 4) AS jaccard, round(n_common / greatest(deg_a, deg_b, 1), 4) AS common,
 round(deg_a / (SELECT max(d) FROM deg), 4) AS deg_u, round(deg_b / (SELECT max(d) FROM deg), 4) AS deg_v, CASE WHEN greatest(deg_a, deg_b) > 20 THEN 1.0 ELSE 0.0 END::DOUBLE AS hub FROM topo)"""
_SCORED = f"""{_TOPO}, {_R}, j AS (SELECT r.*, coalesce(n_common, 0) AS c, coalesce(CASE WHEN from_entity = topo.a THEN deg_a ELSE deg_b END, 0) AS df, coalesce(CASE WHEN from_entity = topo.a THEN deg_b ELSE deg_a END, 0) AS dt
 FROM r LEFT JOIN topo ON topo.a = least(from_entity, to_entity) AND topo.b = greatest(from_entity, to_entity)),
k AS (SELECT *, coalesce(nullif(confidence, 0), 0.5) AS base, c / greatest(df + dt - c, 1) AS jaccard, CASE WHEN coalesce(relation_type, 'unknown') IN ('related_to', 'unknown') THEN 0.0 ELSE 1.0 END::DOUBLE AS type_boost,
 CASE WHEN df = 0 AND dt = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS isolated FROM j),
s AS (SELECT *, round(least(1, greatest(0, 0.4::DOUBLE * base + 0.4::DOUBLE * jaccard + 0.05::DOUBLE * type_boost - 0.3::DOUBLE * isolated)), 4) AS score FROM k),
l AS (SELECT *, CASE WHEN score >= 0.7 THEN 'srmkg_high' WHEN score < 0.3 THEN 'srmkg_low' ELSE 'borderline' END AS level FROM s)"""
_MERGED = """o AS (SELECT *, (coalesce(created_at, ''), coalesce(session_id, ''), coalesce(origin_tool, '')) AS o FROM relations),
head AS (SELECT project, from_entity, relation_type, to_entity, max(confidence) AS confidence, coalesce(bool_or(verified), false) AS verified, max(coalesce(created_at, '')) AS created_at FROM relations GROUP BY ALL),
kv AS (SELECT project, from_entity, relation_type, to_entity, o, unnest(map_entries(qualifiers)) AS q FROM o),
last AS (SELECT project, from_entity, relation_type, to_entity, q.key AS k, arg_max(q.value, (o, q.value)) AS v FROM kv WHERE coalesce(q.value, '') <> '' GROUP BY ALL),
maps AS (SELECT project, from_entity, relation_type, to_entity, string_agg(k || '=' || v, ';' ORDER BY k) AS qualifiers FROM last GROUP BY ALL)"""


def _ppr_rounds(rounds: int) -> str:
    out = f"WITH {_E}, {_ASKED}, {_TRANS}, n AS (SELECT id AS node, CASE WHEN id IN (SELECT id FROM asked) THEN 1.0::DOUBLE / (SELECT count(*) FROM asked) ELSE 0 END AS s, id IN (SELECT u FROM p) AS live FROM (SELECT DISTINCT id FROM e)), r0 AS MATERIALIZED (SELECT node, s AS score FROM n)"
    for i in range(rounds):
        out += f""", f{i} AS (SELECT v AS node, sum(p * score) AS f FROM p JOIN r{i} ON u = node GROUP BY v), d{i} AS (SELECT coalesce(sum(score), 0) AS lost FROM r{i} JOIN n USING (node) WHERE NOT live),
r{i + 1} AS MATERIALIZED (SELECT n.node, 0.5::DOUBLE * (coalesce(f, 0) + lost / (SELECT count(*) FROM n)) + 0.5::DOUBLE * s AS score FROM n LEFT JOIN f{i} USING (node), d{i})"""
    return out


def _ppr_sql(rounds: int) -> str:
    return _ppr_rounds(rounds) + f" SELECT node, round(score, 6) AS score FROM r{rounds} WHERE score > 0"


def _ppr_converged(rounds: int) -> str:
    """The first round that moves less than the tolerance; each halves what is left, so few can be needed."""
    moved = " UNION ALL ".join(f"SELECT {i} AS i, sum(abs(a.score - b.score)) AS g FROM r{i} a JOIN r{i - 1} b USING (node)" for i in range(1, rounds + 1))
    chosen = " UNION ALL ".join(f"SELECT * FROM r{i} WHERE (SELECT i FROM pick) = {i}" for i in range(1, rounds + 1))
    return _ppr_rounds(rounds) + f""", pick AS (SELECT min(i) AS i FROM ({moved}) WHERE g < 0.0001),
res AS (SELECT node, round(score, 6) AS score FROM ({chosen}) WHERE score > 0),
top AS (SELECT node, score, CAST(row_number() OVER (ORDER BY score DESC, node) AS INTEGER) AS rank FROM res) SELECT * FROM top WHERE rank <= 30"""


# letters beyond ASCII stand as "_", other signs as none, so that word bounds are those of Unicode
_FORMS = rf"""plain AS (SELECT doc_id, project, text, regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{{L}}\p{{N}}\p{{M}}]', chr(1), 'g'), '[^\x00-\x7F]', '_', 'g') AS a FROM documents WHERE text IS NOT NULL),
lists AS (SELECT doc_id, project, list_concat(
  list_transform(list_filter(regexp_extract_all(a, '{extraction.PHRASE}'), lambda p: NOT list_has_any(regexp_split_to_array(lower(p), '\s+'), {extraction.STOP_WORDS})), lambda n: {{'name': n, 'type': 'concept'}}),
  list_transform(regexp_extract_all(a, '{extraction.CAMEL}'), lambda n: {{'name': n, 'type': 'identifier'}}),
  list_transform(regexp_extract_all(text, '{extraction.BACKTICK}', 1), lambda n: {{'name': n, 'type': 'code'}})) AS f FROM plain),
forms AS (SELECT doc_id, project, pos - 1 AS pos, n.name AS name, n.type AS type, regexp_replace(lower(n.name), '[^a-z0-9]+', '', 'g') AS key
  FROM (SELECT doc_id, project, unnest(f) AS n, generate_subscripts(f, 1) AS pos FROM lists))"""

_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_STRIP = f"regexp_replace({{x}}, '^{_WS}+|{_WS}+$', '', 'g')".replace("p{Z}", "p{{Z}}")
#: End of the last break in the back half of a window, counted in characters of the section.
_BREAK = "b + 800 + length(nullif(regexp_extract(s[b + 801 : e], '(?s)^.*{sep}'), ''))"
_WINDOWS = f"""
part AS (SELECT doc_id, unnest(regexp_split_to_array(text, '(?m)^#{{1,3}}{_WS}+')) AS raw, generate_subscripts(regexp_split_to_array(text, '(?m)^#{{1,3}}{_WS}+'), 1) AS sec FROM documents WHERE text IS NOT NULL),
sect AS (SELECT doc_id, sec, {_STRIP.format(x="raw")} AS s FROM part),
step AS (SELECT doc_id, sec, s, -1 AS n, 0 AS b, 0 AS stop, 0 AS nxt FROM sect WHERE s <> ''
  UNION ALL SELECT doc_id, sec, s, n + 1, b, stop, greatest(stop - 160, b + 1) FROM
  (SELECT *, CASE WHEN e >= length(s) THEN length(s) ELSE coalesce({", ".join(_BREAK.format(sep=x) for x in (chr(92) + "n" + chr(92) + "n", chr(92) + "n", "[.] ", " "))}, e) END AS stop FROM
   (SELECT doc_id, sec, s, n, nxt AS b, least(nxt + 1600, length(s)) AS e FROM step WHERE n = -1 OR stop < length(s)))),
piece AS (SELECT doc_id, sec, n, {_STRIP.format(x="s[b + 1 : stop]")} AS text FROM step WHERE n >= 0)"""

SQL = {
    "chunk_documents": f"""WITH RECURSIVE {_WINDOWS}, d AS (SELECT doc_id, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec, n) - 1 AS INTEGER) AS chunk_idx FROM piece WHERE text <> '')
SELECT doc_id, chunk_idx, md5(doc_id || ':' || chunk_idx) AS chunk_id, text FROM d""",
    "extract_entities": f"WITH {_FORMS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, name, type FROM forms WHERE key <> ''",
    "document_mentions": f"WITH {_FORMS} SELECT DISTINCT doc_id, md5(project || ':' || key)[1:12] AS entity_id FROM forms WHERE key <> '' AND project IS NOT NULL",
    "document_ids": "SELECT doc_id, sha256(coalesce(source, '') || ':' || substring(text, 1, 256))[1:16] AS note_id, sha256(text)[1:16] AS fingerprint FROM documents WHERE text IS NOT NULL",
    "pending_documents": """WITH t AS (SELECT doc_id, coalesce(source, '') AS path, sha256(text)[1:16] AS fingerprint, created_at FROM documents WHERE text IS NOT NULL)
SELECT doc_id, path, fingerprint FROM t ANTI JOIN (SELECT path, fingerprint FROM t WHERE created_at < TIMESTAMPTZ '2026-05-01 00:00:00+00') k USING (path, fingerprint)""",
    "relation_insert_ignore": """WITH r AS (SELECT DISTINCT project, from_entity, relation_type, to_entity, coalesce(verified, false) AS v FROM relations),
a AS (SELECT * FROM r WHERE v UNION ALL SELECT * FROM (SELECT * FROM r WHERE NOT v) n ANTI JOIN (SELECT * FROM r WHERE v) k USING (project, from_entity, relation_type, to_entity))
SELECT project, count(*) AS n, count(*) FILTER (v) AS verified FROM a GROUP BY project""",
    "reconstruct_document": "WITH c AS (SELECT DISTINCT id, doc_id, chunk_idx, text, project FROM chunks WHERE text IS NOT NULL) SELECT project, doc_id, count(*) AS n_chunks, string_agg(text, chr(10) || chr(10) ORDER BY chunk_idx, id) AS text FROM c GROUP BY project, doc_id",
    "entity_registry": f"""WITH {_E}, k AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS key, length(regexp_replace(name, '\\P{{Lu}}', '', 'g')) AS ups FROM e WHERE name IS NOT NULL)
SELECT project, key, arg_min(name, (-ups, length(name), name)) AS name,
 arg_min(type, (CASE type WHEN 'code' THEN 0 WHEN 'identifier' THEN 1 WHEN 'person' THEN 2 WHEN 'org' THEN 3 WHEN 'tool' THEN 4 WHEN 'concept' THEN 5 ELSE 6 END, type)) AS type,
 string_agg(DISTINCT name, '|' ORDER BY name) AS aliases, CAST(count(DISTINCT name) - 1 AS INTEGER) AS merged FROM k WHERE key <> '' GROUP BY project, key""",
    "entity_ids": f"WITH {_E} SELECT id, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS key, md5(project || ':' || regexp_replace(lower(name), '[^a-z0-9]+', '', 'g'))[1:12] AS canonical_id FROM e WHERE name IS NOT NULL",
    "relation_upsert": f"WITH {_MERGED} SELECT project, from_entity, relation_type, to_entity, confidence, verified, created_at, coalesce(qualifiers, '') AS qualifiers FROM head h LEFT JOIN (SELECT project AS p, from_entity AS f, relation_type AS t, to_entity AS o, qualifiers FROM maps) m ON p IS NOT DISTINCT FROM project AND f IS NOT DISTINCT FROM from_entity AND t IS NOT DISTINCT FROM relation_type AND o IS NOT DISTINCT FROM to_entity",
    "entity_upsert": "SELECT id, max(name) AS name, arg_max(type, coalesce(name, '')) AS type, arg_max(project, coalesce(name, '')) AS project FROM entities GROUP BY id",
    "delete_relation": "WITH r AS (SELECT DISTINCT project, from_entity, relation_type, to_entity, confidence, verified FROM relations) SELECT project, from_entity, relation_type, to_entity, confidence FROM r ANTI JOIN (SELECT * FROM r WHERE confidence < 0.2 AND NOT coalesce(verified, false)) g USING (project, from_entity, relation_type, to_entity)",
    "delete_entity": "SELECT DISTINCT project, from_entity, relation_type, to_entity FROM relations WHERE from_entity NOT IN (SELECT id FROM entities WHERE type IS NULL) AND to_entity NOT IN (SELECT id FROM entities WHERE type IS NULL)",
    "khop_1": f"WITH {_E}, {_ASKED}, {_BOTH.format(t='relations')}, {_HOPS} SELECT * FROM h1",
    "khop_2": f"WITH {_E}, {_ASKED}, {_BOTH.format(t='relations')}, {_HOPS} SELECT * FROM h1 UNION ALL SELECT * FROM h2",
    "khop_outgoing": f"WITH {_E}, {_ASKED}, adj AS (SELECT DISTINCT from_entity AS u, to_entity AS v FROM relations WHERE from_entity <> to_entity), {_HOPS} SELECT * FROM h1 UNION ALL SELECT * FROM h2",
    "asof_neighbors": f"WITH {_E}, {_ASKED}, {_NOW}, {_BOTH.format(t='now')}, {_HOPS} SELECT * FROM h1 UNION ALL SELECT * FROM h2",
    "shortest_path": f"""WITH RECURSIVE {_E}, {_ASKED}, {_BOTH.format(t="relations")}, t AS (SELECT project, min(from_entity) AS target FROM relations GROUP BY project),
pairs AS (SELECT id AS source, target FROM asked JOIN t USING (project) WHERE id <> target),
walk(source, node, path) USING KEY (source, node) AS (SELECT DISTINCT source, source, [source] FROM pairs UNION
 SELECT w.source, v, min(list_append(w.path, v)) FROM walk w JOIN adj ON u = w.node LEFT JOIN recurring.walk k ON k.source = w.source AND k.node = v WHERE k.node IS NULL GROUP BY w.source, v),
best AS (SELECT source, node AS target, path FROM walk)
SELECT source, target, path IS NOT NULL AS found, CAST(coalesce(len(path) - 1, -1) AS INTEGER) AS length, array_to_string(path, '>') AS path FROM pairs LEFT JOIN best USING (source, target)""",
    "trace_path": f"""WITH RECURSIVE {_E}, {_ASKED}, adj AS (SELECT DISTINCT from_entity AS u, to_entity AS v FROM relations WHERE from_entity <> to_entity), t AS (SELECT project, min(from_entity) AS target FROM relations GROUP BY project),
pairs AS (SELECT target AS source, id AS target FROM asked JOIN t USING (project) WHERE id <> target),
walk(source, node, path) USING KEY (source, node) AS (SELECT DISTINCT source, source, [source] FROM pairs UNION
 SELECT w.source, v, min(list_append(w.path, v)) FROM walk w JOIN adj ON u = w.node LEFT JOIN recurring.walk k ON k.source = w.source AND k.node = v WHERE k.node IS NULL GROUP BY w.source, v),
best AS (SELECT source, node AS target, path FROM walk)
SELECT source, target, path IS NOT NULL AS found, CAST(coalesce(len(path) - 1, -1) AS INTEGER) AS length, array_to_string(path, '>') AS path FROM pairs LEFT JOIN best USING (source, target)""",
    "asof_facts": f"""WITH {_E}, {_R}, n AS (SELECT *, {_VALID}, coalesce(qualifiers['valid_from'], '') AS valid_from, coalesce(qualifiers['valid_to'], '') AS valid_to FROM r),
v AS (SELECT * FROM n WHERE {_HOLDS}),
b AS (SELECT from_entity AS entity, to_entity AS other, relation_type, 'outgoing' AS direction, confidence, valid_from, valid_to FROM v UNION ALL SELECT to_entity, from_entity, relation_type, 'incoming', confidence, valid_from, valid_to FROM v)
SELECT *, valid_to = '' AS is_current FROM b WHERE entity IN (SELECT id FROM e)""",
    # of all later facts with another target the earliest one closes a fact
    "supersede_facts": f"""WITH r AS (SELECT DISTINCT project, from_entity, relation_type, to_entity, created_at, qualifiers FROM relations WHERE relation_type IN ('located_in', 'reports_to', 'member_of')),
s AS (SELECT *, coalesce(vf, CAST({_sec("trim(created_at)")} AS BIGINT)) AS start, row_number() OVER () AS n FROM (SELECT *, {_VALID} FROM r)),
c AS (SELECT a.n, min(b.start) AS closed FROM s a JOIN s b ON a.project = b.project AND a.from_entity = b.from_entity AND a.relation_type = b.relation_type
 WHERE b.to_entity <> a.to_entity AND (b.start, b.to_entity) > (a.start, a.to_entity) GROUP BY a.n)
SELECT project, from_entity, relation_type, to_entity, created_at, {_STAMP.format(x="closed")} AS closed_at FROM s JOIN c USING (n) WHERE trim(coalesce(qualifiers['valid_to'], '')) = ''""",
    "adjust_confidence": f"""WITH {_R}, d AS (SELECT from_entity, round(0.02::DOUBLE / sqrt(count(*)), 6) AS delta FROM r GROUP BY from_entity HAVING round(0.02::DOUBLE / sqrt(count(*)), 6) < 0.02),
x AS (SELECT r.*, delta, CASE WHEN delta IS NULL THEN confidence ELSE round(least(1, greatest(0, coalesce(confidence, 0.5) + delta)), 6) END AS nc FROM r LEFT JOIN d USING (from_entity))
SELECT from_entity, count(*) FILTER (delta IS NOT NULL AND nc IS DISTINCT FROM confidence) AS changed, CAST(sum(CAST(nc AS DECIMAL(18,6))) AS DOUBLE) AS confidence FROM x GROUP BY from_entity""",
    "entity_term_lookup": f"""WITH {_E}, {_ASKED}, i AS (SELECT DISTINCT project, term, id FROM (SELECT project, id, unnest(list_append(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda t: length(t) >= 2), lower(name))) AS term FROM e WHERE name IS NOT NULL)),
t AS (SELECT DISTINCT id AS query_id, project, split_part(lower(name), ' ', 1) AS term FROM asked WHERE name IS NOT NULL),
x AS (SELECT query_id, project, term, i.id, true AS exact FROM t JOIN i USING (project, term))
SELECT * FROM x UNION ALL SELECT DISTINCT query_id, t.project, t.term, i.id, false FROM (SELECT * FROM t ANTI JOIN i USING (project, term)) t JOIN i ON i.project = t.project AND contains(i.term, t.term)""",
    "chunks_near_entity": f"WITH {_MENTIONS}, c AS (SELECT DISTINCT id, doc_id, chunk_idx FROM chunks) SELECT entity_id, chunk_id, doc_id, chunk_idx FROM m JOIN c ON c.id = chunk_id WHERE entity_id IN (SELECT id FROM entities WHERE type = 'org')",
    "graph_search": f"""WITH {_E}, {_ASKED}, {_BOTH.format(t="relations")}, {_HOPS}, {_MENTIONS}, near AS (SELECT * FROM h1 UNION ALL SELECT id, id, 0 FROM asked),
b AS (SELECT seed, chunk_id, min(hop) AS hop FROM near JOIN m ON entity_id = node GROUP BY ALL)
SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM (SELECT seed, chunk_id, hop, row_number() OVER (PARTITION BY seed ORDER BY hop, chunk_id) AS rank FROM b) WHERE rank <= 10""",
    "fused_entity_search": f"""WITH {_E}, {_ASKED}, {_BOTH.format(t="relations")}, {_HOPS}, hh AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2), dg AS (SELECT to_entity AS node, count(*) AS deg FROM relations GROUP BY 1),
a1 AS (SELECT * FROM (SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY hop, node) AS rank, 0 AS arm FROM hh) WHERE rank <= 50),
a2 AS (SELECT * FROM (SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY deg DESC, node) AS rank, 1 AS arm FROM hh JOIN dg USING (node)) WHERE rank <= 50),
f AS (SELECT seed, node, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(arm) AS arm, arg_min(rank, arm) AS first FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2) GROUP BY seed, node)
SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM (SELECT seed, node, score, row_number() OVER (PARTITION BY seed ORDER BY score DESC, arm, first, node) AS rank FROM f) WHERE rank <= 10""",
    "ppr_transition": f"WITH {_TRANS} SELECT u, v, round(p, 6) AS p FROM p",
    "ppr_fixed_rounds": _ppr_sql(3),
    "ppr_topk": _ppr_converged(17),
    "edge_features": f"WITH {_FEAT} SELECT * FROM feat",
    "spurious_edges": f"WITH {_FEAT} SELECT a, b, heuristic AS spuriousness FROM feat WHERE heuristic >= 0.65",
    "spurious_edges_learned": f"WITH {_FEAT}, z AS (SELECT a, b, round(1 / (1 + exp(-(-0.8::DOUBLE + 2.0::DOUBLE * heuristic - 1.5::DOUBLE * jaccard - common + 0.4::DOUBLE * deg_u + 0.4::DOUBLE * deg_v + 0.5::DOUBLE * hub))), 4) AS spuriousness FROM feat) SELECT *, spuriousness >= 0.65 AS suggested FROM z",
    "prune_isolated": f"WITH {_E}, {_MENTIONS} SELECT id, name, project FROM e WHERE id NOT IN (SELECT from_entity FROM relations UNION ALL SELECT to_entity FROM relations) AND id NOT IN (SELECT entity_id FROM m) AND type IS DISTINCT FROM 'tool'",
    "review_queue": f"""WITH {_FEAT}, k AS (SELECT DISTINCT least(from_entity, to_entity) AS a, greatest(from_entity, to_entity) AS b FROM relations WHERE verified)
SELECT a, b, heuristic AS spuriousness, round(abs(heuristic - 0.65::DOUBLE), 6) AS distance FROM feat ANTI JOIN k USING (a, b)
WHERE round(abs(heuristic - 0.65::DOUBLE), 6) <= 0.25 AND CAST('0x' || md5(a || ':' || b)[1:4] AS INTEGER) < 13107 ORDER BY distance, a, b LIMIT 50""",
    "relation_scores": f"WITH {_SCORED} SELECT project, from_entity, relation_type, to_entity, created_at, round(base, 6) AS base, round(jaccard, 6) AS jaccard, type_boost, isolated, score, level FROM l",
    "verification_cap": f"""WITH {_SCORED}, q AS (SELECT *, row_number() OVER (PARTITION BY project, level ORDER BY created_at, from_entity, relation_type, to_entity, score) AS i FROM l)
SELECT project, CASE WHEN level = 'borderline' AND i > 30 THEN 'srmkg_cap' ELSE level END AS level, count(*) AS n, count(*) FILTER (level = 'borderline' AND i <= 30) AS asked FROM q GROUP BY 1, 2""",
    "verdict_parse": f"""WITH {_R}, v AS (SELECT CASE WHEN verified THEN 'GROUNDED' WHEN NOT verified THEN 'PARTIAL' ELSE 'REJECTED' END AS verdict, CAST(printf('%.2f', floor(coalesce(confidence, 0.5) * 100) / 100) AS DOUBLE) AS c FROM r)
SELECT verdict, verdict <> 'REJECTED' AS accepted, count(*) AS n, round(avg(CASE verdict WHEN 'GROUNDED' THEN c WHEN 'PARTIAL' THEN round(c * 0.6::DOUBLE, 4) ELSE 0 END), 4) AS confidence FROM v GROUP BY ALL""",
    "verify_and_merge": """SELECT project, 'vog' AS verifier, count(DISTINCT (from_entity, relation_type, to_entity)) AS relations, count(DISTINCT (from_entity, relation_type, to_entity)) AS verified
FROM relations r WHERE EXISTS (SELECT 1 FROM relations s WHERE s.verified IS NOT NULL AND s.project IS NOT DISTINCT FROM r.project AND s.from_entity IS NOT DISTINCT FROM r.from_entity AND s.relation_type IS NOT DISTINCT FROM r.relation_type AND s.to_entity IS NOT DISTINCT FROM r.to_entity AND s.created_at IS NOT DISTINCT FROM r.created_at) GROUP BY project""",
    "relation_lines": """WITH t AS (SELECT session_id, from_entity, relation_type, to_entity, confidence FROM relations WHERE session_id <> '' AND relation_type IS NOT NULL)
SELECT session_id, 0 AS line, from_entity AS source, relation_type, to_entity AS target, coalesce(CAST(printf('%.2f', floor(confidence * 100) / 100) AS DOUBLE), 0.5) AS confidence FROM t""",
}
