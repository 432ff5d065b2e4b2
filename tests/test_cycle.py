from lorekeep.operators import cycle

REL = "project string, from_entity string, relation_type string, to_entity string, confidence double, verified boolean, session_id string, origin_tool string, created_at string, qualifiers map<string,string>"


def answer(prompt):
    if prompt.startswith("Verify:"):
        return "not supported" if "knows" in prompt else "GROUNDED, CONFIDENCE: 0.8"
    if "broken" in prompt:
        raise RuntimeError
    return "noise\n1. Ann Lee -[USES]-> Lance DB CONFIDENCE: 0.95\n- Lance-DB -[owns]-> Bob | CONFIDENCE: 0.5\n- Ann Lee -[KNOWS]-> Bob CONFIDENCE: 0.4\nAnn Lee -[USES]-> Nobody CONFIDENCE: 1"


def test_cycle(spark, tmp_path):
    names = [("e1", "Ann Lee", "person", "p"), ("e2", "LanceDB", "tool", "p"), ("e3", "Bob", "person", "p"), ("e4", "alone", "concept", "p"), ("e5", "said", "concept", "p")]
    entities = spark.createDataFrame(names, "id string, name string, type string, project string")
    texts = spark.createDataFrame([("p", "s1", "Ann Lee and Lance DB"), ("p", "s2", "broken"), ("q", "s3", "Ann Lee")], "project string, session_id string, text string")
    relations = spark.createDataFrame([("p", "e1", "uses", "e2", 0.3, False, "s0", "t", "2026-01-01", {"k": "v"})], REL)
    mentions = spark.createDataFrame([("c1", "e5")], "chunk_id string, entity_id string")
    log = str(tmp_path / "log")
    merged, kept = cycle.run_cycle(spark, texts, entities, relations, mentions, answer, log, "2026-02-01T00:00:00Z")
    got = {(r.from_entity, r.relation_type, r.to_entity): (r.confidence, r.verified, r.qualifiers) for r in merged.collect()}
    # the known relation is confirmed, a new one is added, another one is refused
    assert got[("e1", "uses", "e2")] == (0.95, True, {"k": "v", "verifier": "cycle"})
    assert got[("e2", "owns", "e3")] == (0.5, True, {"verifier": "cycle"}) and len(got) == 2
    assert sorted(r.id for r in kept.collect()) == ["e1", "e2", "e3", "e5"]
    cycle.run_cycle(spark, texts, kept, merged, mentions, answer, log, "2026-03-01T00:00:00Z")
    m = cycle.run_metrics(spark, log).first()
    assert (m.runs, m.last, m.candidates, m.pruned) == (2, "2026-03-01T00:00:00Z", 6, 1)
