import json

import pytest
from pyspark.sql import functions as F

from lorekeep.sources import files
from lorekeep.streaming import pipelines


def test_markdown_resume(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# A\ntext")
    (tmp_path / "sub" / "b.md").write_text("B ü")
    (tmp_path / "c.txt").write_text("no")
    read = files.read_markdown(spark, str(tmp_path))
    assert sorted(r.text for r in read.collect()) == ["# A\ntext", "B ü"]
    done = spark.createDataFrame(read.select("path", "fingerprint").collect())
    assert files.pending(read, done).count() == 0
    (tmp_path / "a.md").write_text("# A\nchanged")
    assert [r.text for r in files.pending(files.read_markdown(spark, str(tmp_path)), done).collect()] == ["# A\nchanged"]


def test_prechunked(spark):
    payload = json.dumps([{"text": "one", "idx": 0, "entities": [{"name": "Ann Lee", "type": "person"}], "relations": []}, {"text": "two", "entities": [{"name": "Graph", "type": "tool"}], "relations": [{"from": "ann lee", "to": "graph", "type": "uses", "confidence": 0.8}, {"from": "Ann Lee", "to": "Nobody", "type": "uses"}]}, {"text": " "}])
    rows = spark.createDataFrame([("p", "d", "s", payload), ("p", "bad", "s", "{oops"), ("p", "none", "s", None)], "project string, doc_id string, source string, payload string")
    chunks, entities, relations, counters = files.prechunked(rows)
    assert [(r.chunk_idx, r.text) for r in chunks.orderBy("chunk_idx").collect()] == [(0, "one"), (1, "two")]
    assert entities.count() == 2 and [(r.relation_type, r.confidence) for r in relations.collect()] == [("uses", 0.8)]
    assert counters.first().truncated_chunks == 0


def test_insert_ignore(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    assert sorted(tuple(r) for r in files.insert_ignore(t, spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k int, v string"), ["k"]).collect()) == [(1, "a"), (2, "c")]


def test_signed_export(spark, tmp_path):
    parts = {"entities": spark.createDataFrame([("e1", "Ann"), ("e2", None)], "id string, name string"), "chunks": spark.createDataFrame([("c1", "text")], "id string, text string")}
    out = str(tmp_path / "x")
    files.export_project(parts, out, "demo", "me", "secret", "2026-01-01T00:00:00Z")
    head, rows = files.import_project(spark, out, "secret", {"me"})
    assert head["project"] == "demo" and rows.count() == 3
    for secret, issuers in (("other", {"me"}), ("secret", {"you"})):
        with pytest.raises(ValueError):
            files.import_project(spark, out, secret, issuers)
    tampered = spark.read.schema("kind string, row string, tag string").json(f"{out}/rows").withColumn("row", F.regexp_replace("row", "Ann", "Eve"))
    tampered.write.json(str(tmp_path / "y/rows"))
    spark.read.text(f"{out}/envelope").write.text(str(tmp_path / "y/envelope"))
    with pytest.raises(ValueError):
        files.import_project(spark, str(tmp_path / "y"), "secret")


def test_streamed_nodes_equal_batch(spark, data, tmp_path):
    from lorekeep.operators import rolling

    src = spark.read.parquet(f"{data}/telemetry_events.parquet")
    files_in = str(tmp_path / "in")
    src.repartition(3).write.parquet(files_in)
    q = pipelines.keep_rolling_nodes(pipelines.read_events(spark, files_in), str(tmp_path / "nodes"), str(tmp_path / "cp"))
    q.awaitTermination(180)
    cols = ["project", "level", "idx", *rolling.SUMS]
    got = sorted(map(tuple, pipelines.rolling_nodes(spark, str(tmp_path / "nodes")).select(cols).collect()))
    assert got == sorted(map(tuple, rolling.segment_nodes(rolling.daily_leaves(src)).select(cols).collect()))


def test_windowed_stream(spark, data, tmp_path):
    events = pipelines.read_events(spark, f"{data}/telemetry_events.parquet*")
    q = pipelines.windowed_usage(events, "1 day").writeStream.format("memory").queryName("usage").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    ids = spark.read.parquet(f"{data}/telemetry_events.parquet")
    from lorekeep.functions.time import utc_seconds

    n = ids.where(utc_seconds(F.col("ts")).isNotNull()).select("id").distinct().count()
    assert spark.table("usage").agg(F.sum("calls")).first()[0] == n
    q2 = pipelines.session_windows(events).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q2.awaitTermination(180)
    assert spark.table("bursts").count() >= 0
