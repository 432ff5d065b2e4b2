"""Retrieval over the graph, review of edges and the small operators around them."""

from pyspark.sql import functions as F

from lorekeep.operators import chunking, evaluate, learn, recall, review, verify
from lorekeep.sources import files
from lorekeep.streaming import pipelines


def test_question_terms(spark):
    q = spark.createDataFrame([(1, "p", "How does NightGardener use Lance with `top_k` and Lance?"), (2, "p", "who is Amélie"), (3, "p", None)], "query_id int, project string, query string")
    got = {}
    for r in recall.question_terms(q, 4).collect():
        got.setdefault(r.query_id, []).append((r.pos, r.term))
    assert [t for _, t in sorted(got[1])] == ["NightGardener", "How", "Lance", "top_k"] and 2 not in got and 3 not in got


def test_neighbourhood_and_chunks(spark):
    steps = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")], "u string, v string")
    seeds = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "query_id int, id string")
    mentions = spark.createDataFrame([("k1", "a"), ("k2", "c"), ("k2", "b"), ("k3", "c")], "chunk_id string, entity_id string")
    near = recall.neighbourhood(seeds, steps, 1)
    assert {(r.query_id, r.node): r.hop for r in near.collect()} == {(1, "a"): 0, (1, "b"): 0, (1, "c"): 1, (2, "c"): 0, (2, "b"): 1}
    got = {(r.query_id, r.chunk_id): r.hop for r in recall.near_chunks(near, mentions).collect()}
    assert got == {(1, "k1"): 0, (1, "k2"): 0, (1, "k3"): 1, (2, "k2"): 0, (2, "k3"): 0}
    dense = spark.createDataFrame([(1, "k3", 1), (1, "k9", 2)], "query_id int, chunk_id string, rank int")
    first = recall.priming(dense, recall.near_chunks(near, mentions), 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in first] == [(1, "k3"), (1, "k9"), (1, "k1"), (1, "k2"), (2, "k2"), (2, "k3")]


def test_verified_or_the_first_three(spark):
    rows = [(1, r, r == 5) for r in range(1, 7)] + [(2, r, False) for r in range(1, 7)]
    got = recall.verified_or_first(spark.createDataFrame(rows, "query_id int, rank int, accepted boolean")).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(1, 5), (2, 1), (2, 2), (2, 3)]


def test_distinct_first_counts_units(spark):
    rows = [(1, "s1", 1), (1, "s1", 2), (1, "s2", 3), (1, "s3", 4)]
    got = recall.distinct_first(spark.createDataFrame(rows, "query_id int, doc string, rank int"), "doc", 2)
    gold = spark.createDataFrame([(1, "s2")], "query_id int, doc string")
    assert [(r.doc, r["rank"]) for r in got.orderBy("rank").collect()] == [("s1", 1), ("s2", 2)]
    means = evaluate.mean_metrics(evaluate.rank_metrics(got, gold)).first()
    assert (means.queries, means.hit1, means.hit3, means.mrr) == (1, 0.0, 1.0, 0.5)


EDGE = "project string, a string, b string, heuristic double, jaccard double, common double, deg_u double, deg_v double, hub double, spuriousness double"


def test_review_cycle(spark, tmp_path):
    scored = spark.createDataFrame([("p", "a", f"b{i:02}", 0.7, 0.1, 0.1, 0.2, 0.2, 0.0, 0.6 + i / 100) for i in range(25)], EDGE)
    names = spark.createDataFrame([("a", "Ann"), ("b00", "Bob")], "id string, name string")
    rows = review.feature_rows(scored, names)
    empty = rows.withColumn("status", F.lit("")).withColumn("label", F.lit("")).where("false")
    queue = review.capture(review.capture(empty, rows), rows)  # a second capture adds nothing
    assert queue.count() == 25 and {(r.name_a, r.name_b) for r in queue.where("b <= 'b01'").collect()} == {("Ann", "Bob"), ("Ann", None)}
    labels = spark.createDataFrame([("p", "a", f"b{i:02}", "keep" if i % 2 else "prune") for i in range(20)] + [("p", "a", "b24", "maybe")], "project string, a string, b string, label string")
    done = review.label(queue, labels)
    s = review.statistics(done).first()
    assert (s.total, s.pending, s.labelled, s.keep, s.prune, s.trainable) == (25, 5, 20, 10, 10, True)
    assert [r.b for r in review.pending(queue, 3).collect()] == ["b05", "b04", "b06"]
    review.export_labels(done, str(tmp_path / "labels"))
    assert spark.read.json(str(tmp_path / "labels")).count() == 20


def test_pruning_asks_the_scorer_again(spark):
    edge = "project string, from_entity string, relation_type string, to_entity string"
    rel = spark.createDataFrame([("p", "b", "uses", "a"), ("p", "a", "owns", "b"), ("p", "c", "uses", "d")], edge)
    scores = spark.createDataFrame([("p", "b", "uses", "a", 0.1), ("p", "b", "uses", "a", 0.2), ("p", "a", "owns", "b", 0.9), ("p", "c", "uses", "d", 0.1)], edge + ", score double")
    suggested = spark.createDataFrame([("a", "b")], "a string, b string")
    assert [(r.from_entity, r.score) for r in review.apply_pruning(rel, suggested, scores).collect()] == [("b", 0.2)]
    assert sorted(r.from_entity for r in review.apply_pruning(rel, suggested, scores, dry_run=False).collect()) == ["a", "c"]


def test_judgements_and_stamps(spark):
    said = [("The context: ANSWERED.", "ANSWERED"), ("partial", "PARTIAL"), ("No.", "NO"), ("nothing known", "UNAVAILABLE"), ("", "UNAVAILABLE"), (None, "UNAVAILABLE")]
    got = spark.createDataFrame(said, "a string, want string").select("want", verify.parse_judgement(F.col("a")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    rows = spark.createDataFrame([(True, False, {"verifier": "x", "k": "v"}), (True, None, None), (False, False, {})], "accepted boolean, verified boolean, qualifiers map<string,string>")
    out = [(r.verified, r.qualifiers) for r in verify.stamped(rows, "vog").collect()]
    assert out == [(True, {"k": "v", "verifier": "vog"}), (True, {"verifier": "vog"})]


def test_weights_are_kept(spark, tmp_path):
    models = spark.createDataFrame([("p", [2.0], -1.0)], "project string, weights array<double>, intercept double")
    learn.save_weights(models, str(tmp_path / "w"))
    learn.save_weights(learn.load_weights(spark, str(tmp_path / "w")), str(tmp_path / "w"))
    rows = spark.createDataFrame([("p", 0.5), ("q", 0.5)], "project string, x double")
    got = {r.project: r.learned_score for r in learn.learned_score(rows, learn.load_weights(spark, str(tmp_path / "w")), "project", ["x"], F.lit(0.9)).collect()}
    assert got == {"p": 0.5, "q": 0.9}


def test_sections_and_windows(spark):
    text = "intro\n# One\n" + "word " * 500 + "\n#### deep stays\n## Two\nlast  \n"
    rows = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "   \n", "x"), (4, "", "x")], "doc_id int, text string, chunk_idx string")
    got = chunking.chunk_documents(rows).orderBy("chunk_idx").collect()
    assert [r.doc_id for r in got] == [1] * 4 and got[0].text == "intro" and got[-1].text == "Two\nlast" and got[-2].text.endswith("#### deep stays")
    assert max(len(r.text) for r in got) <= 1600 and [r.chunk_idx for r in got] == [0, 1, 2, 3]


def test_folder_totals_and_imports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\ntext")
    (tmp_path / "in" / "b.md").write_bytes(b"\xff\xfe broken")
    (tmp_path / "in" / "c.md").write_text("  ")
    found = files.read_markdown(spark, str(tmp_path / "in"))
    done = found.where("path like '%a.md'")
    t = files.ingest_totals(found, files.pending(found, done), chunking.chunk_documents(found)).first()
    assert (t.files, t.skipped, t.empty, t.unreadable, t.chunks) == (3, 1, 1, 1, 2)
    rows = files.export_rows("entities", spark.createDataFrame([("e1", "Ann", "p")], "id string, name string, project string"))
    back = files.imported_table(rows, "entities", "id string, name string, project string", "q").collect()
    assert [tuple(r) for r in back] == [("e1", "Ann", "q")]

    def broken(texts):
        raise RuntimeError

    v = files.embed_texts(spark.createDataFrame([("x",)], "text string"), "text", broken, dim=2).first()
    assert v.embedding == [0.0, 0.0]


def test_logged_events_append(spark, data, tmp_path):
    spark.read.parquet(f"{data}/telemetry_events.parquet").repartition(2).write.parquet(str(tmp_path / "in"))
    events = pipelines.read_events(spark, str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        pipelines.log_events(events, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == spark.read.parquet(str(tmp_path / "in")).count()
