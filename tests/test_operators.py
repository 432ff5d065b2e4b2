"""Small fixtures with known results."""

import math

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.text import canonical_key, chunk_id, entity_id, fingerprint, note_doc_id, query_terms, strip
from lorekeep.functions.vectors import cosine, or_zeros, stub_embed, truncate_norm
from lorekeep.operators import chunking, components, edges, evaluate, extraction, fusion, graph, learn, lexical, pagerank, sessions, telemetry, vector, verify


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_ids(spark):
    r = one(spark, e=entity_id(F.lit("demo"), F.lit("Lore-Keep")), l=entity_id(F.lit("p"), F.lit("StoreDB")), n=note_doc_id(F.lit("note"), F.lit("hello")), c=chunk_id(F.lit("d1"), F.lit(0)), f=fingerprint(F.lit("hello world")), k=canonical_key(F.lit("!!!")))
    assert (r.e, r.l, r.n, r.c, r.f, r.k) == ("6e2b834b6a46", "f828dc36df49", "cb55d39c0ad60ef0", "a7cd1d37555fac76f8c4f3f738196793", "b94d27b9934d3e08", "")


def test_strip_and_terms(spark):
    r = one(spark, s=strip(F.lit("   a b\t　")), t=query_terms(F.lit("How does GraphStore use `rank fusion` in Berlin Berlin?")))
    assert r.s == "a b" and r.t == ["GraphStore", "How", "Berlin", "rank fusion"]


def test_stub_embedding(spark):
    r = one(spark, v=stub_embed(F.lit("hello"), 8), z=or_zeros(F.lit(None).cast("array<float>"), 3), t=truncate_norm(F.array(*[F.lit(x) for x in (3.0, 4.0, 9.0)]), 2), c=cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))))
    assert [round(x, 6) for x in r.v] == [-0.402144, 0.545767, -0.244159, 0.277671, -0.157985, 0.229797, 0.16756, -0.545767]
    assert r.z == [0, 0, 0] and [round(x, 6) for x in r.t] == [0.6, 0.8] and r.c == 0


def test_bm25(spark):
    docs = spark.createDataFrame([("k1", "garden nightly job prunes spurious edges"), ("k2", "it stores vector embeddings"), ("k3", "Kelvex is the default graph backend"), ("k4", None)], "doc_id string, text string").where("text is not null")
    q = spark.createDataFrame([(1, "Kelvex backend")], "query_id int, query string")
    s = lexical.bm25_scores(docs, q).collect()
    assert [(r.doc_id, round(r.score, 6)) for r in s] == [("k3", 1.857191)]


def test_rrf(spark):
    arms = [spark.createDataFrame([(1, k, i + 1) for i, k in enumerate(x)], "q int, id string, rank int") for x in ("xyz", "yxz", "xzy")]
    got = {r.id: (round(r.score, 6), r["rank"]) for r in fusion.reciprocal_rank_fusion(arms, ["q"], "id").collect()}
    assert got == {"x": (0.048916, 1), "y": (0.048395, 2), "z": (0.047875, 3)}


def test_window_chunks(spark):
    assert chunking.window_cuts("short", 10, 2) == ["short"]
    text = "word " * 900
    cuts = chunking.window_cuts(text, 1600, 160)
    assert all(len(c) <= 1600 for c in cuts) and len(cuts) == 4 and "".join(cuts).count("word") >= 900
    docs = spark.createDataFrame([("d", "intro\n# One\nbody `x`\n## Two\n\nmore\n#### deep"), ("e", "  "), ("f", None), ("g", "y" * 5000)], "doc_id string, text string")
    got = chunking.chunk_documents(docs).orderBy("doc_id", "chunk_idx").collect()
    assert [r.text for r in got if r.doc_id == "d"] == ["intro", "One\nbody `x`", "Two\n\nmore\n#### deep"]
    assert {r.doc_id for r in got} == {"d", "g"} and [len(r.text) for r in got if r.doc_id == "g"] == [1600, 1600, 1600, 680]


def test_extraction(spark):
    docs = spark.createDataFrame([("d", "The Garden Keeper feeds GraphStore, not The Store. Use `top_k` and Garden Keeper in Berlin.")], "doc_id string, text string")
    got = [(r.name, r.type) for r in extraction.surface_forms(docs, ["doc_id"]).orderBy("pos").collect()]
    assert ("GraphStore", "identifier") in got and ("top_k", "code") in got and ("Garden Keeper", "concept") in got
    with pytest.raises(ValueError):
        extraction.extractor("none")
    names = spark.createDataFrame([(n, t) for n, t in (("LoreKeep", "concept"), ("lorekeep", "tool"), ("LOREKEEP", "identifier"), ("Lore Keep", None), ("!!!", "org"))], "name string, type string")
    r = extraction.registry(names, []).collect()
    assert len(r) == 1 and (r[0].name, r[0].type, r[0].merged) == ("LOREKEEP", "identifier", 3)


REL = "project string, from_entity string, to_entity string, relation_type string, confidence double, verified boolean, session_id string, origin_tool string, created_at string, qualifiers map<string,string>"


def rel(a, b, t="uses", c=0.5, v=False, at="1", q=None):
    return ("p", a, b, t, c, v, "s", "tool", at, q)


def test_relation_merge(spark):
    rows = [rel("a", "b", c=0.4, at="1", q={"valid_from": "2026", "verifier": "manual"}), rel("a", "b", c=0.9, v=True, at="2", q={"valid_to": "2027", "verifier": "vog", "valid_from": ""}), rel("a", "b", t="owns", v=None)]
    got = {r.relation_type: r for r in graph.merge_relations(spark.createDataFrame(rows, REL)).collect()}
    u = got["uses"]
    assert (u.confidence, u.verified, u.created_at, u.qualifiers) == (0.9, True, "2", {"valid_from": "2026", "valid_to": "2027", "verifier": "vog"})
    assert got["owns"].qualifiers == {} and got["owns"].verified is False


def test_validity_and_neighbours(spark):
    rows = [rel("a", "b", "worked_on", q={"valid_from": "2026-01-01", "valid_to": "2026-06-01"}), rel("a", "c", "worked_on", q={"valid_from": "2026-07-01"}), rel("c", "d")]
    df = spark.createDataFrame(rows, REL)
    seeds = spark.createDataFrame([("a",)], "seed string")
    for as_of, want in (("2026-03-01", {"b"}), ("2026-08-01", {"c", "d"}), ("", {"b", "c", "d"}), ("2026-06-01T23:00:00Z", {"b"})):
        hops = graph.k_hop(graph.adjacency(df.where(graph.valid_at(F.col("qualifiers"), as_of))), seeds, 2)
        assert {r.node for r in hops.collect()} == want
    s = graph.supersede(df, ["worked_on"]).where("closed_at is not null").count()
    assert s == 0  # the earlier fact is closed already


def test_supersede(spark):
    rows = [rel("al", "paris", "located_in", at="2026-01-01"), rel("al", "london", "located_in", at="2026-02-01"), rel("al", "x", "uses", at="2026-03-01")]
    got = graph.supersede(spark.createDataFrame(rows, REL), ["located_in"]).where("closed_at is not null").collect()
    assert [(r.to_entity, r.closed_at) for r in got] == [("paris", "2026-02-01T00:00:00Z")]


def test_shortest_path(spark):
    df = spark.createDataFrame([rel(a, b) for a, b in ("ab", "bc", "cd", "ad", "de", "xy")], REL)
    pairs = spark.createDataFrame([("a", "e"), ("a", "y"), ("b", "d")], "source string, target string")
    got = {(r.source, r.target): (r.found, r.length, r.path) for r in graph.shortest_paths(graph.adjacency(df), pairs).collect()}
    assert got == {("a", "e"): (True, 2, ["a", "d", "e"]), ("a", "y"): (False, -1, None), ("b", "d"): (True, 2, ["b", "a", "d"])}


def _brute_paths(steps, pairs):
    """Least shortest path of each pair, level by level in plain Python."""
    out, after = {}, {}
    for u, v in steps:
        after.setdefault(u, set()).add(v)
    for s, t in pairs:
        seen, front = {s: (s,)}, {s: (s,)}
        while front:
            new = {}
            for u, p in front.items():
                for v in after.get(u, ()):
                    if v not in seen:
                        new[v] = min(new.get(v, (*p, v)), (*p, v))
            seen |= new
            front = new
        out[s, t] = seen.get(t)
    return out


def test_supersede_closes_repeated_facts(spark):
    import random

    draw = random.Random(3)
    rows = [rel("a", x, "located_in", at=f"{y}-01-01") for x, y in (("x", 2020), ("x", 2021), ("y", 2022))]
    rows += [rel(f"s{i % 3}", draw.choice("xyz" if i % 3 else "xxxxxy"), "located_in", at=f"2026-01-{draw.randint(1, 9):02}T0{draw.randint(0, 4)}:00:00Z", q=draw.choice([None, None, {"valid_to": "2027"}])) for i in range(120)]

    def closed(r):
        later = [(o[8], o[2]) for o in rows if o[1] == r[1] and (o[8], o[2]) > (r[8], r[2]) and o[2] != r[2]]
        return min(later)[0][:10] + (min(later)[0][10:] or "T00:00:00Z") if later and not r[9] else None

    got = [(r.from_entity, r.to_entity, r.created_at, r.closed_at) for r in graph.supersede(spark.createDataFrame(rows, REL), ["located_in"]).collect()]
    assert sorted(got, key=repr) == sorted(((r[1], r[2], r[8], closed(r)) for r in rows), key=repr)
    assert [g[3] for g in sorted(got, key=repr)[:3]] == ["2022-01-01T00:00:00Z", "2022-01-01T00:00:00Z", None]


@pytest.mark.parametrize("direction", ["both", "outgoing"])
def test_shortest_path_has_no_depth_limit(spark, direction):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(8)]
    steps = graph.adjacency(spark.createDataFrame([rel(a, b) for a, b in [*chain, ("n00", "m"), ("m", "n02"), ("q", "z")]], REL), direction)
    known = [tuple(r) for r in steps.collect()]
    for asked in ([("n00", "n08"), ("n03", "n08"), ("n00", "n02"), ("q", "n08")], [("n00", "n08"), ("n00", "n07"), ("n00", "n02"), ("n00", "z")]):  # few targets, few sources
        got = {(r.source, r.target): r.path and tuple(r.path) for r in graph.shortest_paths(steps, spark.createDataFrame(asked, "source string, target string")).collect()}
        assert got == _brute_paths(known, asked)
        assert len(got["n00", "n08"]) == 9


def test_shortest_path_query_meets_far_pairs(spark, tmp_path):
    from lorekeep.plans.knowledge import shortest_path

    ids = [f"{50 * i:012x}" for i in range(1, 10)]
    spark.createDataFrame([rel(a, b) for a, b in zip(ids, ids[1:])], REL).write.parquet(str(tmp_path / "relations.parquet"))
    spark.createDataFrame([(i, f"n {i}", "concept", "p") for i in ids], "id string, name string, type string, project string").write.parquet(str(tmp_path / "entities.parquet"))
    got = {r.source: (r.found, r.length) for r in shortest_path(spark, str(tmp_path)).collect()}
    assert got == {x: (True, i) for i, x in enumerate(ids) if i}


def test_pagerank_chain(spark):
    df = spark.createDataFrame([rel(a, b, c=1.0) for a, b in ("ab", "bc", "cd")], REL)
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    steps = pagerank.transition(df)
    seed = spark.createDataFrame([("a",)], "node string")
    got = {r.node: round(r.score, 6) for r in pagerank.personalised_pagerank(steps, nodes, seed, rounds=5).collect()}
    assert got == {"a": 0.574219, "b": 0.318359, "c": 0.082031, "d": 0.025391}
    done = {r.node: round(r.score, 4) for r in pagerank.personalised_pagerank(steps, nodes, seed).collect()}
    assert done == {"a": 0.5778, "b": 0.3111, "c": 0.0889, "d": 0.0222}
    assert pagerank.personalised_pagerank(steps, nodes, spark.createDataFrame([("q",)], "node string")).count() == 0


def test_edge_features(spark):
    e = spark.createDataFrame([tuple(x) for x in ("ab", "bc", "cd", "de", "ac", "bd", "ba")], "u string, v string")
    got = {r.a + r.b: tuple(r)[2:] for r in edges.edge_features(edges.undirected(e, "u", "v")).collect()}
    assert got["ab"] == (0.6667, 0.25, 0.3333, 0.6667, 1, 0) and got["bc"] == (0.3333, 0.5, 0.6667, 1, 1, 0) and got["de"] == (1, 0, 0, 1, 0.3333, 0)


def test_verification(spark):
    rows = spark.createDataFrame([("uses", 0.9, 8, 9, 9), ("unknown", 0.0, 0, 0, 0)], "relation_type string, confidence double, common_neighbors int, degree_from int, degree_to int")
    got = verify.components(rows).withColumn("score", verify.heuristic_score()).withColumn("level", verify.decision(F.col("score"))).collect()
    assert [(round(r.jaccard, 4), r.score, r.level) for r in got] == [(0.8, 0.73, "srmkg_high"), (0.0, 0.0, "srmkg_low")]


def test_parsers(spark):
    p = lambda t: verify.parse_verdict(F.lit(t))
    r = one(spark, a=p("GROUNDED CONFIDENCE: 0.9"), b=p("partial, confidence: 0.5"), c=p(""), d=p("no idea"), e=verify.parse_conflict(F.lit("CONFLICT here")), f=verify.parse_conflict(F.lit("NO CONFLICT CONFIDENCE: 0.9")), g=verify.parse_conflict(F.lit(None).cast("string")))
    assert tuple(r.a) == ("GROUNDED", 0.9, True) and tuple(r.b) == ("PARTIAL", 0.3, True) and tuple(r.c) == ("REJECTED", 0.0, False) and r.d.verdict == "REJECTED"
    assert tuple(r.e) == (True, 0.7) and tuple(r.f) == (False, 0.9) and tuple(r.g) == (False, 0.5)
    lines = spark.createDataFrame([(1, "- Garden Keeper --[Prunes]-> Edges | CONFIDENCE: 0.8\nnoise\nA –[is part of]–→ B confidence: 1.\nA -[x]-> B")], "q int, answer string")
    got = [tuple(x)[1:] for x in verify.parse_relation_lines(lines, ["q"]).orderBy("line").collect()]
    assert got == [(0, "Garden Keeper", "prunes", "Edges", 0.8), (2, "A", "is part of", "B", 1.0)]
    asked = verify.ask_model(lines, "answer", lambda t: 1 / 0, "said").first()
    assert asked.said == ""


def test_learning(spark):
    rows = [(0.8 + i % 5 / 100, 0.7, 1.0, 0.0, 1) for i in range(40)] + [(0.2 + i % 5 / 100, 0.05, 0.0, 1.0, 0) for i in range(40)]
    df = spark.createDataFrame(rows, "base double, jaccard double, type_boost double, isolated double, label int")
    names = ["base", "jaccard", "type_boost", "isolated"]
    m = learn.calibrate(df, names, "label", rounds=30, rate=0.2)
    scored = df.withColumn("score", edges.logistic(m["weights"], m["intercept"]))
    assert learn.auc(scored, "score", "label").first().auc >= 0.95
    assert learn.calibrate(df.limit(10), names, "label") is None and learn.calibrate(df.where("label = 1"), names, "label", least=5) is None
    ties = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "s double, y int")
    assert learn.auc(ties, "s", "y").first().auc == 0.875


def test_sessions(spark):
    e = spark.createDataFrame([("p", "s", 1, "2026-01-01", "t", " same ", 2), ("p", "s", 2, "2026-01-02", "t", "same", 3), ("p", "s", 3, "2026-01-03", "t", " ", 1), ("p", "s", 4, "2026-01-04", "u", "other", None)], "project string, session_id string, pos int, ts string, tool_name string, summary string, repeat_count int")
    by = ["project", "session_id"]
    m = {r.summary: r for r in sessions.merge_sessions([e.where("pos < 2"), e.where("pos >= 2")], by).collect()}
    assert m["same"].repeat_count == 5 and m["same"].last_seen_at == "2026-01-02" and len(m) == 2
    assert sessions.session_text(sessions.normalise_entries(e, by), by).first().text == "[2026-01-02] t x5\nsame\n\n[2026-01-04] u\nother"
    assert sessions.prepare_sessions(sessions.normalise_entries(e, by), by).first().summaries == ["same"]


def test_consolidation(spark):
    reuse = spark.createDataFrame([("p", "hot", 4, 9, 1.0), ("p", "cold", 1, 1, 40.0), ("p", "fresh", 1, 1, 2.0)], "project string, entity_id string, sessions int, touches int, days_since double")
    deg = spark.createDataFrame([(x, 2) for x in ("hot", "cold", "fresh")], "entity_id string, degree int")
    got = {r.entity_id: (r.action, r.delta) for r in telemetry.consolidate(reuse, deg).collect()}
    assert got == {"hot": ("boost", 0.009391), "cold": ("decay", -0.042194), "fresh": ("none", 0.0)}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "c", 1)], "query_id int, doc string, rank int")
    gold = spark.createDataFrame([(1, "b"), (2, "z")], "query_id int, doc string")
    got = {r.query_id: (r.hit1, r.hit3, r.rr) for r in evaluate.rank_metrics(ranked, gold).collect()}
    assert got == {1: (0.0, 1.0, 0.5), 2: (0.0, 0.0, 0.0)} and evaluate.mean_metrics(evaluate.rank_metrics(ranked, gold)).first().mrr == 0.25


def test_components(spark):
    e = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(50, 50), (3, 2), (None, 4)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(e, "a int, b int"), "a", "b").collect()}
    assert got == {i: i // 10 * 10 for i in range(40)} | {40: 30} or math.prod(got[i] == i // 10 * 10 for i in range(40))
    assert components.connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_extraction_and_chunks_match_plain_python(spark, data):
    import re

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect() if r.text}
    got = {}
    for r in extraction.surface_forms(docs, ["doc_id"]).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.name, r.type))
    for d, t in texts.items():
        phrases = [(p, "concept") for p in re.findall(extraction.PHRASE, t) if not set(p.lower().split()) & set(extraction.STOP_WORDS)]
        names = phrases + [(n, "identifier") for n in re.findall(extraction.CAMEL, t)] + [(n, "code") for n in re.findall(extraction.BACKTICK, t)]
        assert got.get(d, []) == [x for x in names if re.sub("[^a-z0-9]+", "", x[0].lower())]
    chunks = {}
    for r in chunking.chunk_documents(docs).orderBy("doc_id", "chunk_idx").collect():
        chunks.setdefault(r.doc_id, []).append(r.text)
    for d, t in texts.items():
        parts = [s.strip() for s in re.split(r"(?m)^#{1,3}\s+", t) if s.strip()]
        assert chunks.get(d, []) == [p for s in parts for p in ([s] if len(s) <= 1600 else chunking.window_cuts(s, 1600, 160))]


def test_calibrate_groups(spark):
    import random

    draw, rows = random.Random(5), []
    for i in range(400):
        x, z, g = draw.random(), round(draw.random(), 1), ("p", "q")[i % 2]
        rows.append((g, i, round(x, 2), z, int(x + draw.gauss(0, 0.3) > 0.5) if g == "p" else int(z < 0.5), i % 5 == 0))
    rows += [("few", 1000 + i, 0.5, 0.5, i % 2, False) for i in range(20)] + [("one", 2000 + i, 0.5, 0.5, 1, i == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, i int, x double, z double, y int, t boolean")

    def plain(g, rounds):
        train = [r for r in rows if r[0] == g and not r[5]]
        n, w, b, loss = len(train), [0.0, 0.0], 0.0, 0.0
        for _ in range(rounds):
            p = [1 / (1 + math.exp(-(w[0] * r[2] + w[1] * r[3] + b))) for r in train]
            loss = -sum(math.log((q if r[4] else 1 - q) + 1e-12) for q, r in zip(p, train)) / n + 0.5 * (w[0] ** 2 + w[1] ** 2) / n
            step = [sum((q - r[4]) * r[k] for q, r in zip(p, train)) / n + w[k - 2] / n for k in (2, 3)]
            b -= 0.1 * sum(q - r[4] for q, r in zip(p, train)) / n
            w = [w[k] - 0.1 * step[k] for k in (0, 1)]
        tested = [(w[0] * r[2] + w[1] * r[3], r[4]) for r in rows if r[0] == g and r[5]]
        pos, neg = [s for s, y in tested if y], [s for s, y in tested if not y]
        area = sum((a > c) + (a == c) / 2 for a in pos for c in neg) / (len(pos) * len(neg))
        return pytest.approx((160, 40, *w, b, loss, area), abs=1e-6)

    for rounds, task_rows in ((500, learn.TASK_ROWS), (3, 0)):
        got = {r.g: r for r in learn.calibrate_groups(df, "g", ["x", "z"], "y", F.col("t"), *([] if rounds == 500 else [rounds]), task_rows=task_rows).collect()}
        for g in "pq":
            r = got[g]
            assert (r.n_train, r.n_test, *r.weights, r.intercept, r.loss, r.auc) == plain(g, rounds)
        assert [(got[g].n_train, got[g].n_test, got[g].weights, got[g].auc) for g in ("few", "one")] == [(20, 0, None, None), (59, 1, None, None)]


def test_edge_scorer_learns_from_labels(spark, tmp_path):
    from lorekeep.plans import knowledge

    hub = [rel("hub", f"h{i:02}", v=False) for i in range(40)]
    tri = [rel(f"t{i:02}{a}", f"t{i:02}{b}", v=True) for i in range(20) for a, b in ("ab", "bc", "ac")]
    spark.createDataFrame([*hub, *tri, ("q", "m", "n", "uses", 0.5, True, "s", "tool", "1", None)], REL).write.parquet(str(tmp_path / "relations.parquet"))
    value = {(r.project, r.name): r.value for r in knowledge.edge_scorer(spark, str(tmp_path)).collect()}
    assert value["p", "auc"] == 1 and value["p", "jaccard"] < 0 < value["p", "hub"] and value["p", "n_train"] + value["p", "n_test"] == 100
    assert {n for p, n in value if p == "q"} == {"n_train", "n_test"}
    got = {(r.project, r.a): (r.spuriousness > 0.5, r.learned) for r in knowledge.spurious_edges_trained(spark, str(tmp_path)).collect()}
    assert got["p", "h00"] == (True, True) and got["p", "t00a"] == (False, True) and got["q", "m"] == (True, False)


def test_sums_before_equal_plain_ones(spark):
    from lorekeep.operators.reduction import sums_before

    rows = [("hot" if i % 4 else "cold", i * 37 % 101, i % 7) for i in range(101)] + [(None, 1, 5)]
    got = sums_before(spark.createDataFrame(rows, "g string, o int, v bigint"), ["g"], ["o"], "v", "before").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.before == sum(v for g, o, v in rows if g == r.g and o < r.o)


def test_cap_counts_equal_rows_once(spark):
    rows = [("p", "borderline", i // 3) for i in range(30)] + [(None, "borderline", 1)] * 4 + [("p", "srmkg_high", 0)]
    df = spark.createDataFrame(rows, "project string, level string, at int")
    got = verify.cap_calls(df, ["project"], ["at"], 10)
    n = {(r.project, r.level, r.ask): r["count"] for r in got.groupBy("project", "level", "ask").count().collect()}
    assert n == {("p", "borderline", True): 10, ("p", "srmkg_cap", False): 20, ("p", "srmkg_high", False): 1, (None, "borderline", True): 4}
    assert sorted(r.at for r in got.where("ask and project = 'p'").collect()) == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]


def test_lookup_inside_entries(spark):
    index = graph.name_index(spark.createDataFrame([("1", "Memory Lane", "p"), ("2", "memo", "p"), ("3", "Memory", "q"), ("4", "x1 y", "p")], "id string, name string, project string"))
    terms = spark.createDataFrame([(1, "p", "emo"), (2, "p", "memory"), (3, "p", "zzz"), (4, "p", "x"), (5, "p", ""), (6, "q", "mor")], "query_id int, project string, term string")
    got = {(r.query_id, r.id, r.exact) for r in graph.lookup_entities(index, terms).collect()}
    assert got == {(1, "1", False), (1, "2", False), (2, "1", True), (4, "4", False), (6, "3", False)}


def test_search_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vector, "PACK", 7)
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rnd.integers(-3, 4, 4)] if i % 11 else None, i % 3) for i in range(60)] + [(60, [0.0] * 4, 0)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int")
    asked = df.where("vec_id % 5 = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), "label")
    for scope in ([], ["label"]):
        got = {}
        for r in vector.search_batch(df, asked.drop("label") if not scope else asked, 4, scope=scope).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.similarity))
        for q, v, lab in rows:
            if q % 5 == 1 and v:
                cos = lambda x: round(float(np.dot(v, x) / (np.linalg.norm(v) * np.linalg.norm(x) or 1)), 6) if any(x) and any(v) else 0.0  # noqa: B023, E731
                want = sorted((-cos(x), i) for i, x, s in rows if x and (not scope or s == lab))[:4]
                assert [(i, s) for _, i, s in sorted(got[q])] == [(i, -s) for s, i in want]


def _shuffled(spark, run):
    """Rows that ``run`` wrote to shuffles, and its result."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def rows():
        sc.listenerBus().waitUntilEmpty(30_000)
        empty = jvm.java.util.ArrayList()
        stages = sc.statusStore().stageList(empty, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), empty)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before, out = rows(), run()
    return rows() - before, out


@pytest.mark.parametrize("name", ["bm25_topk", "hybrid_verified", "retrieval_metrics", "hybrid_search", "search_context"])
def test_search_without_pairs(name, spark, tmp_path):
    """400 titles that share words with all of 800 texts: the best of each, and no row for each pair."""
    from lorekeep.plans import retrieval
    from tests.sqlcheck import assert_same, connect

    texts = [(50 * i if i < 400 else 20_001 + 50 * i, f"same shared words {i % 7} {'same ' * (i % 5)}\nmore {i % 11}" if i % 13 else None) for i in range(800)]
    texts += [(7, ""), (9, "Ünrelated — ☃")]
    spark.createDataFrame([(*x, "p") for x in texts], "doc_id bigint, text string, project string").withColumn("source", F.lit("s")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    n, _ = _shuffled(spark, lambda: assert_same(retrieval.QUERIES[name](spark, str(tmp_path)), connect(str(tmp_path)), retrieval.SQL[name]))
    assert n < 60_000  # of 270,000 pairs


@pytest.mark.parametrize("ids", [[50, 100, 100, 3], [50, None, 4, 3]])
def test_lexical_top_of_repeated_ids(spark, ids):
    docs = spark.createDataFrame(list(zip(ids, ["a b", "b c", "b b", "a c c"])), "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "a b b"), (2, "c"), (3, "!"), (4, None)], "query_id int, query string")
    got = sorted(map(tuple, lexical.bm25_top(docs, asked, 2).select("query_id", "doc_id", "score", "rank").collect()), key=repr)
    want = lexical.top_k(lexical.bm25_scores(docs, asked), 2, ["query_id"]).select("query_id", "doc_id", "score", "rank")
    assert got == sorted(map(tuple, want.collect()), key=repr)


def test_lexical_top_over_blocks(spark, monkeypatch):
    """Several blocks of texts and of queries, string keys, and more terms than are sent to all tasks."""
    docs = spark.createDataFrame([(f"d{i:03}", " ".join(f"w{j}" for j in range(i % 9 + 1)) + f" u{i % 17}") for i in range(200)], "id string, t string")
    asked = spark.createDataFrame([(f"q{i:02}", f"w{i % 9} w{i % 9} u{i} none") for i in range(40)], "query_id string, query string")
    want = sorted(map(tuple, lexical.top_k(lexical.bm25_scores(docs, asked, "id", "t"), 3, ["query_id"], tie="id").collect()))
    for name, value in (("DOC_BLOCK", 16), ("QUERY_BLOCK", 7), ("BROADCAST_TERMS", 5)):
        monkeypatch.setattr(lexical, name, value)
        got = lexical.bm25_top(docs, asked, 3, "id", "t").select("query_id", "id", "score", "rank")
        assert sorted(map(tuple, got.collect())) == want


def test_stub_embedding_hashes_once(spark):
    df = spark.createDataFrame([("hello",), ("",), (None,)], "t string")
    plan = df.select(stub_embed(F.col("t"), 16).alias("v"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    got = [r.v for r in plan.collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-9 and got[1] != got[0] and got[2] == [None] * 16


def test_dense_search_passes_on_the_best_only(spark, monkeypatch):
    """Over many blocks of vectors a task passes on k rows a query, with ties to the lesser key."""
    import numpy as np

    monkeypatch.setattr(vector, "PACK", 50)
    rng = np.random.default_rng(5)
    known = np.repeat(rng.integers(-3, 4, (500, 6)), 4, axis=0).astype(float)
    asked = rng.integers(-3, 4, (120, 6)).astype(float)
    known[7] = asked[3] = 0
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(known)], "vec_id int, embedding array<double>").repartition(2)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "query_id int, qvec array<double>")
    n, got = _shuffled(spark, lambda: sorted((r.query_id, r["rank"], r.vec_id, r.similarity) for r in vector.search_batch(v, q, 5).collect()))
    size = np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(known, axis=1)[None, :]
    sim = np.round(np.divide(asked @ known.T, size, out=np.zeros(size.shape), where=size > 0), 6) + 0.0
    assert got == [(i, j + 1, int(x), float(sim[i, x])) for i in range(120) for j, x in enumerate(np.lexsort((np.arange(len(known)), -sim[i]))[:5])]
    assert n < 6_000  # 2,000 vectors and 120 queries moved, and 5 rows a query of each task; 24,000 of all blocks


def test_dense_search_runs_once(spark, data, monkeypatch):
    from lorekeep.plans import retrieval

    runs, whole = [], retrieval._dense_texts
    monkeypatch.setattr(retrieval, "_dense_texts", lambda *a: runs.append(a) or whole(*a))
    retrieval.hybrid_verified(spark, data)
    assert len(runs) == 1


def test_terms_are_found_whole(spark):
    """Terms of one to four words of eight bytes, beginnings of others, at the ends of texts and in other cases."""
    import numpy as np

    terms = ["a", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "0123456789" * 3, "z"]
    text = "A abcdefg.abcdefgh-abcdefghi abcdefghij ABCDEFGHIJKLMNOP abcdefghijklmnopq z " + "0123456789" * 3 + " 012345678901234 zz z"
    docs = spark.createDataFrame([(2, text), (1, None), (3, ""), (4, "z" * 50), (5, "a")], "id int, text string").coalesce(1)
    r = lexical._doc_blocks(docs, terms, "id", "text").first()
    df = lexical._numbers(bytes(r.df), len(terms))
    doc, tf = (lexical._numbers(bytes(x), int(df.sum())) for x in (r.doc, r.tf))
    assert r["keys"] == [1, 2, 3, 4, 5] and lexical._numbers(bytes(r.dl), 5).tolist() == [0, 12, 0, 1, 1]
    assert list(zip(np.repeat(terms, df).tolist(), doc.tolist(), tf.tolist())) == [("a", 1, 1), ("a", 4, 1), *[(t, 1, 1) for t in terms[1:6]], ("z", 1, 2)]


def test_lexical_top_of_no_terms(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    for query in ("!", "none"):
        assert not lexical.bm25_top(docs, spark.createDataFrame([(1, query)], "query_id int, query string"), 2).collect()


@pytest.mark.parametrize("name", ["hybrid_search", "retrieval_metrics"])
def test_hybrid_embeds_from_digests(name, spark, data, monkeypatch):
    """No row of a hybrid search carries its vector as an array through Spark, and the scores stay those of ``stub_embed``."""
    from lorekeep.plans import retrieval

    seen, packed = [], vector._packed
    monkeypatch.setattr(vector, "_packed", lambda rows, key, column, *a: seen.append(rows.schema[column].dataType.simpleString()) or packed(rows, key, column, *a))
    retrieval.QUERIES[name](spark, data)
    assert seen == ["binary", "binary"]
    docs = spark.read.parquet(f"{data}/documents.parquet").where("text is not null")
    want = vector.search_batch(docs.select("doc_id", stub_embed(F.col("text"), 16).alias("embedding")), retrieval._queries(docs).select("query_id", stub_embed(F.col("query"), 16).alias("qvec")), 10, "doc_id")
    assert sorted(map(tuple, retrieval._dense_texts(spark, data).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("ids", [list(range(40, 0, -1)), [f"d{i:02}" for i in range(40, 0, -1)]])
def test_lexical_ties_across_blocks(spark, monkeypatch, ids):
    """More equal scores than places, over several blocks: the lesser keys win."""
    monkeypatch.setattr(lexical, "DOC_BLOCK", 3)
    kind = "int" if isinstance(ids[0], int) else "string"
    docs = spark.createDataFrame([(x, "a b" if i % 2 else "a c") for i, x in enumerate(ids)], f"doc_id {kind}, text string").coalesce(1)
    got = lexical.bm25_top(docs, spark.createDataFrame([(1, "a")], "query_id int, query string"), 5).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"])] == sorted(ids)[:5]


def test_retrieval_metrics_reads_questions_once(spark, data):
    """Documents are read for the questions and for each of the two searches, and not by the plan that is left."""
    from lorekeep.plans import retrieval

    plan = retrieval.retrieval_metrics(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "text#" not in plan
