"""What agents ask: priming, expansion, graph and hybrid search, review of edges, ingest of payloads.

Questions are asked about every fiftieth entity: "What is known about NAME?" in the entity's project.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import entity_id, strip
from lorekeep.functions.vectors import stub_embed
from lorekeep.operators import edges, evaluate, fusion, graph, lexical, recall, review, telemetry, vector, verify
from lorekeep.plans import knowledge as k
from lorekeep.plans.usage import _CALLS, _calls
from lorekeep.sources import files
from lorekeep.sources.tables import materialise, table

DIM, TOP, HOPS = 16, 10, 2


def _questions(spark: SparkSession, d: str) -> DataFrame:
    named = k._asked(spark, d).where("name is not null and project is not null")
    text = F.concat(F.lit("What is known about "), "name", F.lit("?"))
    return named.groupBy("project", F.col("id").alias("query_id")).agg(F.min(text).alias("query"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where("id is not null and project is not null")
    least = rows.groupBy(F.col("id").alias("chunk_id")).agg(F.min(F.struct("project", "doc_id", "chunk_idx", "source", "text")).alias("c"))
    return least.select("chunk_id", "c.*")


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    known = _chunks(spark, d).select("chunk_id")
    return graph.evidence_mentions(k._rel(spark, d)).join(known, "chunk_id", "left_semi")


def _seeds(spark: SparkSession, d: str, most: int) -> DataFrame:
    index = graph.name_index(k._ent(spark, d).where("project is not null"))
    return materialise(recall.seed_entities(_questions(spark, d), index, most), "seeds")


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(k._rel(spark, d))


def _dense(spark: SparkSession, d: str) -> DataFrame:
    """The chunks nearest to each question by the deterministic embedding, over all projects."""
    some = _chunks(spark, d).where(strip(F.coalesce("text", F.lit(""))) != "")
    known = some.select("chunk_id", stub_embed(F.col("text"), DIM).alias("embedding"))
    asked = _questions(spark, d).select("query_id", stub_embed(F.col("query"), DIM).alias("qvec"))
    return vector.search_batch(known, asked, TOP, "chunk_id")


def stub_embeddings(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d).select("query_id", F.posexplode(stub_embed(F.col("query"), DIM)).alias("pos", "x"))
    return q.select("query_id", "pos", F.round("x", 6).alias("x"))


def question_terms(spark: SparkSession, d: str) -> DataFrame:
    return recall.question_terms(_questions(spark, d), recall.GRAPH_TERMS)


def list_entities(spark: SparkSession, d: str) -> DataFrame:
    return k._ent(spark, d).select("project", "id", "name", "type")


def list_relations(spark: SparkSession, d: str) -> DataFrame:
    """Merged relations with the names of their ends."""
    names = table(spark, d, "entities").groupBy("id").agg(F.max("name").alias("name"))
    out = graph.merge_relations(k._rel(spark, d))
    for end in ("from", "to"):
        out = out.join(names.select(F.col("id").alias(f"{end}_entity"), F.col("name").alias(f"{end}_name")), f"{end}_entity", "left")
    return out.select("project", "from_entity", "from_name", "relation_type", "to_entity", "to_name", "confidence", "verified")


def priming_context(spark: SparkSession, d: str) -> DataFrame:
    nodes = _seeds(spark, d, recall.PRIMING_TERMS).select("query_id", F.col("id").alias("node"), F.lit(0).alias("hop"))
    near = recall.near_chunks(nodes, _mentions(spark, d))
    return recall.priming(_dense(spark, d).where("rank <= 5"), near, 5)


def expand_context(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours within two steps of each asked entity, with the chunks that mention them."""
    seeds = k._asked(spark, d).select(F.col("id").alias("query_id"), "id").distinct()
    near = recall.neighbourhood(seeds, _steps(spark, d), HOPS)
    hits = near.join(_mentions(spark, d), near.node == F.col("entity_id"), "left")
    return hits.groupBy("query_id", "node", "hop").agg(F.count("chunk_id").alias("chunks"), F.min("chunk_id").alias("first_chunk"))


def _graph_arm(spark: SparkSession, d: str, most: int) -> DataFrame:
    near = recall.neighbourhood(_seeds(spark, d, most), _steps(spark, d), HOPS - 1)
    chunks = recall.near_chunks(near, _mentions(spark, d))
    return recall.ranked(chunks, ["hop", "chunk_id"], TOP)


def graph_only_search(spark: SparkSession, d: str) -> DataFrame:
    return _graph_arm(spark, d, recall.GRAPH_TERMS).select("query_id", "chunk_id", "hop", "rank")


def _ppr_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Scores after three rounds of personalised PageRank from all asked entities."""
    return k.ppr_fixed_rounds(spark, d)


def ppr_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of the thirty best nodes, each with its best node's score, best first."""
    best = _ppr_nodes(spark, d).orderBy(F.desc("score"), "node").limit(30)
    hit = best.join(_mentions(spark, d), best.node == F.col("entity_id")).groupBy("chunk_id").agg(F.max("score").alias("score"))
    return hit.select("chunk_id", "score")


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    scored = lexical.bm25_scores(_chunks(spark, d), _questions(spark, d), "chunk_id", "text", ["project"])
    return lexical.top_k(scored, TOP, ["query_id"], tie="chunk_id").select("query_id", "chunk_id", "rank")


def three_list_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Dense, graph and PageRank chunks of each question by reciprocal ranks."""
    return _fused(spark, d, lexical_too=False)


def _fused(spark: SparkSession, d: str, lexical_too: bool) -> DataFrame:
    near = materialise(recall.neighbourhood(_seeds(spark, d, recall.SEARCH_TERMS), _steps(spark, d), HOPS - 1), "near")
    mentions = materialise(_mentions(spark, d), "mentions")
    walk = recall.ranked(recall.near_chunks(near, mentions), ["hop", "chunk_id"], TOP)
    scored = near.join(_ppr_nodes(spark, d), "node").select("query_id", "node", (-F.col("score")).alias("cost"))
    ppr = recall.ranked(recall.near_chunks(scored, mentions, "cost"), ["cost", "chunk_id"], TOP)
    arms = [_dense(spark, d), walk, ppr] + ([_lexical(spark, d)] if lexical_too else [])
    lists = [a.select("query_id", "chunk_id", "rank") for a in arms]
    fused = fusion.reciprocal_rank_fusion(lists, ["query_id"], "chunk_id")
    return fused.where(F.col("rank") <= TOP).select("query_id", "chunk_id", "score", "rank")


def full_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Four arms fused, chunks judged by their stored similarity: those accepted, or else the first three."""
    fused = _fused(spark, d, lexical_too=True)
    sim = table(spark, d, "chunks").groupBy(F.col("id").alias("chunk_id")).agg(F.max("similarity").alias("similarity"))
    home = _chunks(spark, d).select("chunk_id", F.col("project").alias("home"))
    asked = _questions(spark, d).select("query_id", "project")
    rows = fused.join(sim, "chunk_id", "left").join(home, "chunk_id").join(asked, "query_id")
    judged = verify.bucket_chunks(rows).withColumn("accepted", F.col("bucket") == "accept")
    final = recall.verified_or_first(judged)
    return final.select("query_id", "chunk_id", "rank", "bucket", (F.col("home") != F.col("project")).alias("cross_project"))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose chunks are evidence of a relation of the asked entity."""
    asked = _questions(spark, d).select("query_id")
    hit = _mentions(spark, d).join(asked, F.col("entity_id") == F.col("query_id"))
    return hit.join(_chunks(spark, d).where("doc_id is not null"), "chunk_id").select("query_id", F.col("doc_id").alias("doc")).distinct()


def _documents(spark: SparkSession, d: str, ranked: DataFrame) -> DataFrame:
    of = _chunks(spark, d).where("doc_id is not null").select("chunk_id", F.col("doc_id").alias("doc"))
    return ranked.join(of, "chunk_id").select("query_id", "doc", "rank")


def recall_at_documents(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the graph search among its first five different documents, against the evidence."""
    found = recall.distinct_first(_documents(spark, d, _graph_arm(spark, d, recall.SEARCH_TERMS)), "doc", 5)
    return evaluate.rank_metrics(found, _gold(spark, d))


def retrieval_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Mean metrics of the dense, lexical and graph arms alone, and of lexical and graph arms fused."""
    gold = materialise(_gold(spark, d), "gold")
    lex, walk = materialise(_lexical(spark, d), "lexical"), materialise(_graph_arm(spark, d, recall.SEARCH_TERMS), "graph")
    both = fusion.reciprocal_rank_fusion([x.select("query_id", "chunk_id", "rank") for x in (lex, walk)], ["query_id"], "chunk_id")
    arms = {"dense": _dense(spark, d), "lexical": lex, "graph": walk, "lexical+graph": both}
    out = None
    for name, arm in arms.items():
        per = evaluate.rank_metrics(_documents(spark, d, arm), gold)
        mean = evaluate.mean_metrics(per).select(F.lit(name).alias("arm"), "*")
        out = mean if out is None else out.unionByName(mean)
    return out


def _queue_rows(spark: SparkSession, d: str) -> DataFrame:
    f = edges.spurious(k._features(spark, d)).where(F.abs(F.col("spuriousness") - edges.SPURIOUS) <= 0.25)
    of = k._rel(spark, d).where("project is not null")
    of = of.select("project", F.least("from_entity", "to_entity").alias("a"), F.greatest("from_entity", "to_entity").alias("b")).distinct()
    return review.feature_rows(of.join(f, ["a", "b"]), table(spark, d, "entities"))


def _queue(spark: SparkSession, d: str) -> DataFrame:
    """The queue of all edges near the limit; those with a verified or a refused relation were labelled."""
    rows = _queue_rows(spark, d)
    empty = rows.withColumn("status", F.lit("")).withColumn("label", F.lit("")).where(F.lit(False))
    said = k._edge_labels(spark, d).select("project", "a", "b", F.when(F.col("label") == 1, "prune").otherwise("keep").alias("label"))
    return review.label(review.capture(empty, rows), said)


def review_features(spark: SparkSession, d: str) -> DataFrame:
    return _queue_rows(spark, d)


def review_pending(spark: SparkSession, d: str) -> DataFrame:
    return review.pending(_queue(spark, d)).select("project", "a", "b", "spuriousness", "distance")


def review_stats(spark: SparkSession, d: str) -> DataFrame:
    return review.statistics(_queue(spark, d))


def prune_dry_run(spark: SparkSession, d: str) -> DataFrame:
    """Suggested edges whose relations' own scores are low as well."""
    suggested = edges.spurious(k._features(spark, d)).where("suggested")
    return review.apply_pruning(k._rel(spark, d), suggested, k._scored(spark, d))


def decision_log(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on relations with their components, as the calibration reads them."""
    s = k._scored(spark, d)
    label = F.when(F.col("level") == "srmkg_high", 1).when(F.col("level") == "srmkg_low", 0)
    return s.where("level <> 'borderline'").groupBy("project", "relation_type", "level", label.alias("final_label")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("base"), 6).alias("base"), F.round(F.avg("jaccard"), 6).alias("jaccard")
    )


def conflict_parse(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on facts of one subject and type with different targets, from answers spelled by their confidence."""
    r = k._once(k._rel(spark, d)).where("relation_type in ('located_in', 'reports_to', 'member_of')")
    conf = F.format_string("%.2f", F.floor(F.coalesce("confidence", F.lit(0.5)) * 100) / 100)
    word = F.when(F.col("verified"), "No conflict").when(~F.col("verified"), "CONFLICT")
    a = r.select("project", F.coalesce(F.concat(word, F.lit(", confidence: "), conf), F.lit("")).alias("answer"))
    p = a.withColumn("p", verify.parse_conflict(F.col("answer")))
    percent = F.round(F.col("p.confidence") * 100).cast("bigint")
    return p.groupBy("project", "p.conflict").agg(F.count(F.lit(1)).alias("n"), F.sum(percent).alias("percent"))


def payload_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Counters of payloads built from the stored chunks of each document and the entities they mention."""
    return _payloads(spark, d)[3].select("project", "doc_id", "truncated_chunks")


def payload_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _payloads(spark, d)[0].select("project", "doc_id", "chunk_idx", F.col("id").alias("chunk_id"), F.length("text").alias("n"))


def _payloads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows = _chunks(spark, d).where("doc_id is not null and text is not null")
    item = F.struct("chunk_idx", "chunk_id", F.struct("text", F.col("chunk_idx").alias("idx")).alias("c"))
    docs = rows.groupBy("project", "doc_id").agg(F.min("source").alias("source"), F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.c)).alias("payload"))
    return files.prechunked(docs)


def session_dump(spark: SparkSession, d: str) -> DataFrame:
    """What each session hands over at its end: relations with their ends' canonical ids, merged into the graph."""
    r = k._rel(spark, d).where("session_id <> '' and project is not null")
    names = table(spark, d, "entities").where("name is not null").groupBy("id").agg(F.max("name").alias("name"))
    for end in ("from_entity", "to_entity"):
        r = r.join(names.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name")), end)
    ids = [entity_id(F.col("project"), F.col(f"{e}_name")).alias(e) for e in ("from_entity", "to_entity")]
    once = r.select("session_id", "project", *ids, "relation_type").distinct()
    subjects = once.groupBy("session_id", "project", "from_entity").agg(F.count(F.lit(1)).alias("n"))
    return subjects.groupBy("session_id", "project").agg(F.sum("n").alias("relations"), F.count(F.lit(1)).alias("subjects"))


def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors after a second delivery of every third one, moved by one: the newest version of each id."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    again = e.where("vec_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(1).cast("float")))
    both = e.withColumn("version", F.lit(1)).unionByName(again.withColumn("version", F.lit(2)))
    newest = graph.upsert_entities(both.withColumnRenamed("vec_id", "id"), F.col("version"))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return newest.select(F.col("id").alias("vec_id"), "label", "version", (F.round(total, 3) + F.lit(0.0)).alias("total"))  # no negative zero


def raw_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("project", "chunk_id", "doc_id", "source", F.length("text").alias("n_chars"))


def maintenance_metrics(spark: SparkSession, d: str) -> DataFrame:
    """What a maintenance run would report of each project: sessions, relations by level, and isolated entities."""
    levels = k._scored(spark, d).groupBy("project").agg(
        F.count(F.lit(1)).alias("relations"),
        F.count_if(F.col("level") == "srmkg_high").alias("accepted"),
        F.count_if(F.col("level") == "srmkg_low").alias("rejected"),
    )
    alone = k.prune_isolated(spark, d).groupBy("project").agg(F.count(F.lit(1)).alias("isolated"))
    calls = telemetry.usage_stats(_calls(spark, d), ["project"]).select("project", "calls", "blocked")
    out = levels.join(alone, "project", "full_outer").join(calls, "project", "full_outer")
    return out.where("project is not null").fillna(0)


QUERIES = {
    f.__name__: f
    for f in (
        stub_embeddings, question_terms, list_entities, list_relations, priming_context, expand_context, graph_only_search,
        ppr_chunks, three_list_fusion, full_hybrid, recall_at_documents, retrieval_ablation, review_features, review_pending,
        review_stats, prune_dry_run, decision_log, conflict_parse, payload_ingest, payload_chunks, session_dump, vector_upsert,
        raw_chunks, maintenance_metrics,
    )
}

_QUESTIONS = f"""{k._E}, {k._ASKED},
qn AS (SELECT project, id AS query_id, min('What is known about ' || name || '?') AS query FROM asked WHERE name IS NOT NULL AND project IS NOT NULL GROUP BY ALL)"""
_CHUNKS = "ch AS (SELECT DISTINCT ON (id) id AS chunk_id, project, doc_id, chunk_idx, source, text FROM chunks WHERE id IS NOT NULL AND project IS NOT NULL)"
_MENTIONS = f"{k._MENTIONS}, m2 AS (SELECT m.* FROM m SEMI JOIN ch USING (chunk_id))"
# words in the sense of Unicode stand for the word bounds of the patterns
_TERMS = r"""w AS (SELECT query_id, project, regexp_extract_all(query, '[\p{L}\p{N}\p{M}_]+') AS ws, regexp_extract_all(query, '`([^`]+)`', 1) AS bt FROM qn),
l AS (SELECT query_id, project, list_concat(list_filter(ws, lambda x: regexp_full_match(x, '[A-Z][a-z]+([A-Z][a-z]+)+')),
  list_filter(ws, lambda x: regexp_full_match(x, '[A-Z][a-zA-Z]+')), bt) AS ts FROM w),
tq AS (SELECT query_id, project, term, row_number() OVER (PARTITION BY query_id ORDER BY nr) - 1 AS pos FROM
  (SELECT query_id, project, term, min(nr) AS nr FROM (SELECT query_id, project, unnest(ts) AS term, generate_subscripts(ts, 1) AS nr FROM l) GROUP BY ALL))"""


def _seed_sql(most: int) -> str:
    return f"""{_TERMS}, i AS (SELECT DISTINCT project, term, id FROM (SELECT project, id,
  unnest(list_append(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda t: length(t) >= 2), lower(name))) AS term FROM e WHERE name IS NOT NULL AND project IS NOT NULL)),
t AS (SELECT DISTINCT query_id, project, lower(term) AS term FROM tq WHERE pos < {most} AND term <> ''),
sd AS (SELECT query_id, i.id FROM t JOIN i USING (project, term)
  UNION SELECT query_id, i.id FROM (SELECT * FROM t ANTI JOIN i USING (project, term)) t JOIN i ON i.project = t.project AND contains(i.term, t.term))"""


_NEAR = """nb AS (SELECT query_id, node, min(hop) AS hop FROM (SELECT query_id, id AS node, 0 AS hop FROM sd UNION ALL SELECT query_id, v, 1 FROM sd JOIN adj ON u = id) GROUP BY ALL),
gc AS (SELECT query_id, chunk_id, min(hop) AS hop FROM nb JOIN m2 ON entity_id = node GROUP BY ALL),
walk AS (SELECT * FROM (SELECT query_id, chunk_id, hop, row_number() OVER (PARTITION BY query_id ORDER BY hop, chunk_id) AS rank FROM gc) WHERE rank <= 10)"""
_STUB = "list_transform(range(16), lambda i: (CAST('0x' || substr(sha256({x}), CAST(i * 2 + 1 AS INTEGER), 2) AS INTEGER) - 128) / 128.0::DOUBLE)"
_COS = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"
_DENSE = rf"""ev AS (SELECT chunk_id, {_STUB.format(x="text")} AS e FROM ch WHERE regexp_matches(text, '[^\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]')),
qv AS (SELECT query_id, {_STUB.format(x="query")} AS e FROM qn),
dense AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM
  (SELECT query_id, chunk_id, round({_COS}, 6) AS s FROM ev a, qv b)) WHERE rank <= 10)"""
_LEX = """ct AS (SELECT chunk_id, project, coalesce(len(regexp_extract_all(lower(text), '[a-z0-9]+')), 0) AS dl, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM ch),
corpus AS (SELECT project, count(*) AS n, avg(dl) AS avgdl FROM ct GROUP BY project),
qt AS (SELECT query_id, project, term, count(*) AS times FROM (SELECT query_id, project, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM qn) GROUP BY ALL),
post AS (SELECT chunk_id, project, dl, term, count(*) AS tf FROM (SELECT chunk_id, project, dl, unnest(t) AS term FROM ct) GROUP BY ALL),
df AS (SELECT project, term, count(*) AS df FROM post GROUP BY ALL),
lex AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
  (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * times), 6) AS score
   FROM post JOIN qt USING (project, term) JOIN df USING (project, term) JOIN corpus USING (project) GROUP BY ALL) WHERE score > 0) WHERE rank <= 10)"""
_PPR = f"""ppr AS ({k._ppr_sql(3)}),
pc AS (SELECT query_id, chunk_id, max(score) AS score FROM nb JOIN ppr USING (node) JOIN m2 ON entity_id = node GROUP BY ALL),
pr AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pc) WHERE rank <= 10)"""
_BASE = f"{_QUESTIONS}, {_CHUNKS}, {_MENTIONS}, {k._BOTH.format(t='relations')}"


def _rrf_sql(arms: list[str]) -> str:
    lists = " UNION ALL ".join(f"SELECT query_id, chunk_id, rank, {n} AS arm FROM {a}" for n, a in enumerate(arms))
    return f"""fused AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, arm, first, chunk_id) AS rank FROM
  (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(arm) AS arm, arg_min(rank, arm) AS first FROM ({lists}) GROUP BY query_id, chunk_id))"""


_GOLD = "gold AS (SELECT DISTINCT query_id, doc_id AS doc FROM m2 JOIN qn ON entity_id = query_id JOIN ch USING (chunk_id) WHERE doc_id IS NOT NULL)"


def _metrics_sql(arm: str, out: str) -> str:
    return f"""{out} AS (SELECT q.query_id, min(r) AS r FROM (SELECT DISTINCT query_id FROM gold) q LEFT JOIN
  (SELECT query_id, doc, r FROM (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc) AS r FROM
    (SELECT query_id, doc_id AS doc, min(rank) AS rank FROM {arm} JOIN ch USING (chunk_id) WHERE doc_id IS NOT NULL GROUP BY ALL)) JOIN gold USING (query_id, doc)) x USING (query_id) GROUP BY q.query_id)"""


_HIT = "CASE WHEN r <= {n} THEN 1.0 ELSE 0.0 END::DOUBLE"
_MEANS = ", ".join(f"round(avg(CASE WHEN q IS NOT NULL THEN {_HIT.format(n=n)} END), 6) AS hit{n}" for n in (1, 3, 5))
_QUEUE = f"""{k._FEAT}, of AS (SELECT DISTINCT project, least(from_entity, to_entity) AS a, greatest(from_entity, to_entity) AS b FROM relations WHERE project IS NOT NULL),
nm AS (SELECT id, max(name) AS name FROM entities GROUP BY id),
qr AS (SELECT of.project, feat.*, na.name AS name_a, nb.name AS name_b, heuristic AS spuriousness FROM of JOIN feat USING (a, b) LEFT JOIN nm na ON na.id = a LEFT JOIN nm nb ON nb.id = b
  WHERE abs(heuristic - 0.65::DOUBLE) <= 0.25),
lb AS (SELECT project, least(from_entity, to_entity) AS a, greatest(from_entity, to_entity) AS b, CASE WHEN bool_or(verified) THEN 'keep' ELSE 'prune' END AS label
  FROM relations WHERE verified IS NOT NULL AND from_entity <> to_entity GROUP BY ALL),
queue AS (SELECT qr.*, label, CASE WHEN label IS NULL THEN 'pending' ELSE 'labelled' END AS status FROM qr LEFT JOIN lb USING (project, a, b))"""

SQL = {
    "stub_embeddings": f"WITH {_QUESTIONS}, qv AS (SELECT query_id, {_STUB.format(x='query')} AS e FROM qn) SELECT query_id, unnest(range(16))::INTEGER AS pos, round(unnest(e) / sqrt(list_dot_product(e, e)), 6) AS x FROM qv",
    "question_terms": f"WITH {_QUESTIONS}, {_TERMS} SELECT query_id, project, CAST(pos AS INTEGER) AS pos, term FROM tq WHERE pos < 8",
    "list_entities": "SELECT DISTINCT project, id, name, type FROM entities",
    "list_relations": f"""WITH {k._MERGED}, nm AS (SELECT id, max(name) AS name FROM entities GROUP BY id)
SELECT project, from_entity, a.name AS from_name, relation_type, to_entity, b.name AS to_name, confidence, verified FROM head LEFT JOIN nm a ON a.id = from_entity LEFT JOIN nm b ON b.id = to_entity""",
    "priming_context": f"""WITH {_BASE}, {_seed_sql(3)}, {_DENSE}, u AS (SELECT query_id, chunk_id, 0 AS arm, rank FROM dense WHERE rank <= 5
  UNION ALL SELECT DISTINCT query_id, chunk_id, 1, 0 FROM sd JOIN m2 ON entity_id = id),
o AS (SELECT query_id, chunk_id, min((arm, rank)) AS nr FROM u GROUP BY ALL)
SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY nr, chunk_id) AS rank FROM o) WHERE rank <= 7""",
    "expand_context": f"""WITH {_BASE}, {k._HOPS}, near AS (SELECT DISTINCT id AS query_id, id AS node, 0 AS hop FROM asked UNION ALL SELECT DISTINCT seed, node, hop FROM h1 UNION ALL SELECT * FROM h2)
SELECT query_id, node, hop, count(chunk_id) AS chunks, min(chunk_id) AS first_chunk FROM near LEFT JOIN m2 ON entity_id = node GROUP BY ALL""",
    "graph_only_search": f"WITH {_BASE}, {_seed_sql(8)}, {_NEAR} SELECT query_id, chunk_id, hop, CAST(rank AS INTEGER) AS rank FROM walk",
    "ppr_chunks": f"WITH {_CHUNKS}, {_MENTIONS}, b AS (SELECT * FROM ({k._ppr_sql(3)}) ORDER BY score DESC, node LIMIT 30) SELECT chunk_id, max(score) AS score FROM b JOIN m2 ON entity_id = node GROUP BY chunk_id",
    "three_list_fusion": f"""WITH {_BASE}, {_seed_sql(5)}, {_NEAR}, {_DENSE}, {_PPR}, {_rrf_sql(["dense", "walk", "pr"])}
SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM fused WHERE rank <= 10""",
    "full_hybrid": f"""WITH {_BASE}, {_seed_sql(5)}, {_NEAR}, {_DENSE}, {_PPR}, {_LEX}, {_rrf_sql(["dense", "walk", "pr", "lex"])},
j AS (SELECT fused.*, ch.project AS home, qn.project AS asked_in, CASE WHEN s >= 0.7 THEN 'accept' WHEN s IS NULL OR s < 0.3 THEN 'reject' ELSE 'ask' END AS bucket
  FROM fused JOIN ch USING (chunk_id) JOIN qn USING (query_id) LEFT JOIN (SELECT id AS chunk_id, max(similarity) AS s FROM chunks GROUP BY id) USING (chunk_id) WHERE rank <= 10),
o AS (SELECT *, count(*) FILTER (bucket = 'accept') OVER (PARTITION BY query_id) AS ok FROM j)
SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, bucket, home <> asked_in AS cross_project FROM o WHERE bucket = 'accept' OR (ok = 0 AND rank <= 3)""",
    "recall_at_documents": f"""WITH {_BASE}, {_seed_sql(5)}, {_NEAR}, {_GOLD}, five AS (SELECT query_id, doc, rank FROM (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY nr, doc) AS rank FROM
  (SELECT query_id, doc_id AS doc, min(rank) AS nr FROM walk JOIN ch USING (chunk_id) WHERE doc_id IS NOT NULL GROUP BY ALL)) WHERE rank <= 5),
r AS (SELECT q.query_id, min(rank) AS r FROM (SELECT DISTINCT query_id FROM gold) q LEFT JOIN (SELECT * FROM five JOIN gold USING (query_id, doc)) x USING (query_id) GROUP BY q.query_id)
SELECT query_id, {", ".join(f"{_HIT.format(n=n)} AS hit{n}" for n in (1, 3, 5))}, coalesce(round(1.0::DOUBLE / r, 6), 0) AS rr FROM r""",
    "retrieval_ablation": f"""WITH {_BASE}, {_seed_sql(5)}, {_NEAR}, {_DENSE}, {_LEX}, {_GOLD}, {_rrf_sql(["lex", "walk"])},
{_metrics_sql("dense", "md")}, {_metrics_sql("lex", "ml")}, {_metrics_sql("walk", "mg")}, {_metrics_sql("fused", "mb")}
SELECT arm, count(q) AS queries, {_MEANS}, round(avg(CASE WHEN q IS NOT NULL THEN coalesce(round(1.0::DOUBLE / r, 6), 0) END), 6) AS mrr
FROM (VALUES ('dense'), ('lexical'), ('graph'), ('lexical+graph')) v(arm) LEFT JOIN (SELECT 'dense' AS arm, query_id AS q, r FROM md UNION ALL SELECT 'lexical', query_id, r FROM ml UNION ALL SELECT 'graph', query_id, r FROM mg UNION ALL SELECT 'lexical+graph', query_id, r FROM mb) USING (arm) GROUP BY arm""",
    "review_features": f"WITH {_QUEUE} SELECT project, a, b, name_a, name_b, heuristic, jaccard, common, deg_u, deg_v, hub, spuriousness FROM qr",
    "review_pending": f"WITH {_QUEUE} SELECT project, a, b, spuriousness, round(abs(spuriousness - 0.65::DOUBLE), 6) AS distance FROM queue WHERE status = 'pending' ORDER BY distance, project, a, b LIMIT 20",
    "review_stats": f"""WITH {_QUEUE} SELECT project, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'labelled') AS labelled,
count(*) FILTER (label = 'keep') AS keep, count(*) FILTER (label = 'prune') AS prune, count(label) >= 20 AS trainable FROM queue GROUP BY project""",
    "prune_dry_run": f"""WITH {k._SCORED}, feat AS {k._FEAT.split(", feat AS ", 1)[1]},
g AS (SELECT project, from_entity, relation_type, to_entity, max(score) AS score FROM l GROUP BY ALL)
SELECT g.* FROM g JOIN feat ON feat.a = least(from_entity, to_entity) AND feat.b = greatest(from_entity, to_entity) WHERE heuristic >= 0.65 AND score < 0.3""",
    "decision_log": f"""WITH {k._SCORED} SELECT project, relation_type, level, CASE level WHEN 'srmkg_high' THEN 1 ELSE 0 END AS final_label, count(*) AS n, round(avg(base), 6) AS base, round(avg(jaccard), 6) AS jaccard
FROM l WHERE level <> 'borderline' GROUP BY project, relation_type, level""",
    "conflict_parse": f"""WITH {k._R}, a AS (SELECT project, verified, CAST(printf('%.2f', floor(coalesce(confidence, 0.5) * 100) / 100) AS DOUBLE) AS c FROM r WHERE relation_type IN ('located_in', 'reports_to', 'member_of'))
SELECT project, coalesce(NOT verified, false) AS conflict, count(*) AS n, CAST(sum(round(100 * CASE WHEN verified IS NULL THEN 0.5 ELSE c END)) AS BIGINT) AS percent FROM a GROUP BY ALL""",
    "payload_ingest": rf"""WITH {_CHUNKS} SELECT project, doc_id, greatest(count(*) - 200, 0) AS truncated_chunks FROM ch
WHERE doc_id IS NOT NULL AND regexp_matches(text, '[^\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]') GROUP BY ALL""",
    "payload_chunks": rf"""WITH {_CHUNKS}, n AS (SELECT project, doc_id, text, row_number() OVER (PARTITION BY project, doc_id ORDER BY chunk_idx NULLS FIRST, chunk_id) - 1 AS i FROM ch
WHERE doc_id IS NOT NULL AND regexp_matches(text, '[^\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]'))
SELECT project, doc_id, CAST(i AS INTEGER) AS chunk_idx, md5(doc_id || ':' || i) AS chunk_id, CAST(length(text) AS INTEGER) AS n FROM n WHERE i < 200""",
    "session_dump": """WITH nm AS (SELECT id, regexp_replace(lower(max(name)), '[^a-z0-9]+', '', 'g') AS key FROM entities WHERE name IS NOT NULL GROUP BY id),
o AS (SELECT DISTINCT session_id, project, md5(project || ':' || a.key)[1:12] AS f, relation_type, md5(project || ':' || b.key)[1:12] AS t FROM relations JOIN nm a ON a.id = from_entity JOIN nm b ON b.id = to_entity
  WHERE session_id <> '' AND project IS NOT NULL)
SELECT session_id, project, count(*) AS relations, count(DISTINCT f) AS subjects FROM o GROUP BY ALL""",
    "vector_upsert": """SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS version,
round(list_sum(list_transform(embedding, lambda x: CAST(CASE WHEN vec_id % 3 = 0 THEN x + 1::FLOAT ELSE x END AS DOUBLE))), 3) + 0.0::DOUBLE AS total FROM embeddings""",
    "maintenance_metrics": f"""WITH {k._SCORED}, {_CALLS},
lv AS (SELECT project, count(*) AS relations, count(*) FILTER (level = 'srmkg_high') AS accepted, count(*) FILTER (level = 'srmkg_low') AS rejected FROM l GROUP BY project),
al AS (SELECT project, count(*) AS isolated FROM ({k.SQL["prune_isolated"]}) GROUP BY project),
us AS (SELECT project, count(*) AS calls, CAST(coalesce(sum(was_hallucination_blocked), 0) AS BIGINT) AS blocked FROM c GROUP BY project)
SELECT project, coalesce(relations, 0) AS relations, coalesce(accepted, 0) AS accepted, coalesce(rejected, 0) AS rejected, coalesce(isolated, 0) AS isolated, coalesce(calls, 0) AS calls, coalesce(blocked, 0) AS blocked
FROM lv FULL JOIN al USING (project) FULL JOIN us USING (project) WHERE project IS NOT NULL""",
    "raw_chunks": f"WITH {_CHUNKS} SELECT project, chunk_id, doc_id, source, CAST(length(text) AS INTEGER) AS n_chars FROM ch",
}
