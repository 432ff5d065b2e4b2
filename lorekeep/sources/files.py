"""Ingest of files and payloads, resumable by fingerprint, and signed exchange of a project."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.text import canonical_key, chunk_id, entity_id, note_doc_id, path_doc_id, strip

FILES = "path string, doc_id string, fingerprint string, text string"
#: Caps of one agent payload (a feature of the format): chunks, entities and relations.
MAX_CHUNKS, MAX_ENTITIES, MAX_RELATIONS = 200, 1000, 500

PAYLOAD = T.ArrayType(
    T.StructType(
        [
            T.StructField("text", T.StringType()),
            T.StructField("idx", T.IntegerType()),
            T.StructField("entities", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]))),
            T.StructField("relations", T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("to", T.StringType()), T.StructField("type", T.StringType()), T.StructField("confidence", T.DoubleType())]))),
        ]
    )
)


def read_markdown(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, doc_id, fingerprint, text) of the Markdown files below a folder or of one file."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", str(recursive).lower())
    raw = reader.load(path)
    return raw.select("path", path_doc_id(F.col("path")).alias("doc_id"), F.concat(F.col("length"), F.lit(":"), F.sha2("content", 256)).alias("fingerprint"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def ingest_totals(found: DataFrame, todo: DataFrame, chunks: DataFrame) -> DataFrame:
    """(files, skipped, empty, unreadable, chunks): what a scan of a folder came to.

    ``found`` and ``todo`` hold the files of ``read_markdown``, all and pending, ``chunks`` what was cut from them. A
    file that is no valid UTF-8 is read with replacement signs and counted as unreadable; it stops no other.
    """
    one = lambda df, name, cond=None: df.agg((F.count(F.lit(1)) if cond is None else F.count_if(cond)).alias(name))
    parts = [
        one(found, "files"),
        one(found.join(todo.select("path"), "path", "left_anti"), "skipped"),
        one(found, "empty", strip(F.coalesce("text", F.lit(""))) == ""),
        one(found, "unreadable", F.contains("text", F.lit("\ufffd"))),
        one(chunks, "chunks"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def pending(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files that are new or whose content changed since their last ingest; ``done`` holds (path, fingerprint)."""
    return files.join(done.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti")


def notes(rows: DataFrame) -> DataFrame:
    """Adds doc_id to remembered notes (source, text); blank notes are dropped."""
    return rows.where(strip(F.coalesce("text", F.lit(""))) != "").withColumn("doc_id", note_doc_id(F.col("source"), F.col("text")))


def prechunked(payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(chunks, entities, relations, counters) of agents' payloads.

    ``payloads`` holds (project, doc_id, source, payload), the payload being a JSON list of chunks with
    their entities and relations. A relation counts where both its names are entities of the same
    payload; names are matched by canonical key. What exceeds the format's caps is counted as
    truncated. Unreadable payloads have no chunks.
    """
    parsed = payloads.select("project", "doc_id", "source", F.posexplode(F.from_json("payload", PAYLOAD)).alias("pos", "c"))
    parsed = parsed.where(strip(F.coalesce("c.text", F.lit(""))) != "")
    nth = lambda *order: F.row_number().over(Window.partitionBy("project", "doc_id").orderBy(*order))
    ranked = parsed.withColumn("n", nth("pos"))
    kept = ranked.where(F.col("n") <= MAX_CHUNKS)
    idx = (F.col("n") - 1).cast("int")
    chunks = kept.select(chunk_id(F.col("doc_id"), idx).alias("id"), "project", "doc_id", "source", idx.alias("chunk_idx"), F.col("c.text").alias("text"))
    names = kept.select("project", "doc_id", "pos", F.posexplode("c.entities").alias("k", "e")).where(canonical_key(F.coalesce("e.name", F.lit(""))) != "")
    names = names.withColumn("n", nth("pos", "k"))
    entities = names.where(F.col("n") <= MAX_ENTITIES).select(entity_id(F.col("project"), F.col("e.name")).alias("id"), F.col("e.name").alias("name"), F.coalesce("e.type", F.lit("concept")).alias("type"), "project", "doc_id").dropDuplicates(["id", "doc_id"])
    edges = kept.select("project", "doc_id", "pos", F.posexplode("c.relations").alias("k", "r")).withColumn("n", nth("pos", "k"))
    ends = entities.select("project", "doc_id", F.col("id").alias("known"))
    named = edges.where(F.col("n") <= MAX_RELATIONS).select("project", "doc_id", entity_id(F.col("project"), F.col("r.from")).alias("from_entity"), entity_id(F.col("project"), F.col("r.to")).alias("to_entity"), F.coalesce("r.type", F.lit("related_to")).alias("relation_type"), F.coalesce("r.confidence", F.lit(0.5)).alias("confidence"))
    relations = named
    for end in ("from_entity", "to_entity"):
        relations = relations.join(ends.withColumnRenamed("known", end), ["project", "doc_id", end], "left_semi")
    count = lambda df, cap, name: df.groupBy("project", "doc_id").agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias(name))
    counters = count(ranked, MAX_CHUNKS, "truncated_chunks")
    for df, cap, name in ((names, MAX_ENTITIES, "truncated_entities"), (edges, MAX_RELATIONS, "truncated_relations")):
        counters = counters.join(count(df, cap, name), ["project", "doc_id"], "left")
    return chunks, entities, relations, counters.fillna(0)


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with those rows whose keys it does not hold yet; of new rows with equal keys the least is kept."""
    rest = [c for c in table.columns if c not in keys]
    least = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    fresh = least.join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def export_rows(kind: str, df: DataFrame) -> DataFrame:
    """(kind, row): each row as canonical JSON, its fields in the order of their names."""
    return df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("row"))


def _row_tag(secret: str) -> Column:
    @F.pandas_udf(T.StringType())
    def tag(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: hmac.new(secret.encode(), r.encode(), hashlib.sha256).hexdigest())

    return tag


def export_project(parts: dict[str, DataFrame], path: str, project: str, issuer: str, secret: str, created_at: str) -> None:
    """Write a project's tables as signed JSON lines below ``path``.

    Every row carries its HMAC-SHA256; ``envelope`` signs the number of rows and the sum of their tags,
    so that a changed, missing or added row is noticed without gathering rows anywhere.
    """
    spark = next(iter(parts.values())).sparkSession
    rows = None
    for kind, df in sorted(parts.items()):
        e = export_rows(kind, df)
        rows = e if rows is None else rows.unionByName(e)
    tag = _row_tag(secret)
    signed = rows.withColumn("tag", tag(F.concat_ws("\n", "kind", "row")))
    signed.write.mode("overwrite").json(f"{path}/rows")
    head = {"format": "lorekeep-export", "version": 1, "project": project, "issuer": issuer, "created_at": created_at, **_digest(spark.read.schema("kind string, row string, tag string").json(f"{path}/rows"))}
    head["signature"] = _sign(head, secret)
    spark.createDataFrame([(json.dumps(head, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/envelope")


def _digest(rows: DataFrame) -> dict:
    n, total = rows.agg(F.count(F.lit(1)), F.sum(F.conv(F.substring("tag", 1, 15), 16, 10).cast("decimal(38,0)"))).first()
    return {"rows": n, "sum": str(total or 0)}


def _sign(head: dict, secret: str) -> str:
    body = json.dumps({k: v for k, v in head.items() if k != "signature"}, sort_keys=True, separators=(",", ":"))
    return hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def import_project(spark: SparkSession, path: str, secret: str, issuers: set[str] | None = None) -> tuple[dict, DataFrame]:
    """(envelope, rows (kind, row)) of a signed export.

    Raises ValueError for another format or version, an issuer that is not listed, a wrong signature, or
    rows that were changed, added or removed.
    """
    head = json.loads(spark.read.text(f"{path}/envelope").first()[0])
    if head.get("format") != "lorekeep-export" or head.get("version") != 1:
        raise ValueError("unknown format or version")
    if issuers is not None and head.get("issuer") not in issuers:
        raise ValueError("the issuer is not trusted")
    if not hmac.compare_digest(head.get("signature", ""), _sign(head, secret)):
        raise ValueError("the signature does not fit")
    rows = spark.read.schema("kind string, row string, tag string").json(f"{path}/rows")
    wrong = rows.where(_row_tag(secret)(F.concat_ws("\n", "kind", "row")) != F.col("tag")).isEmpty()
    if not wrong or _digest(rows) != {"rows": head["rows"], "sum": head["sum"]}:
        raise ValueError("rows were changed")
    return head, rows.select("kind", "row")


def imported_table(rows: DataFrame, kind: str, schema: str, project: str | None = None) -> DataFrame:
    """One table of an import's rows (kind, row), under another ``project`` if one is given."""
    out = rows.where(F.col("kind") == kind).select(F.from_json("row", schema).alias("r")).select("r.*")
    return out if project is None else out.withColumn("project", F.lit(project))


def embed_texts(rows: DataFrame, text: str, model, out: str = "embedding", dim: int | None = None) -> DataFrame:
    """Adds embeddings by an injected function list[str] -> list[list[float]]; a failing batch gives nulls, or with
    ``dim`` vectors of zeros, which are similar to nothing."""

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                vectors = list(model(b[text].fillna("").to_list()))
            except Exception:
                vectors = [None if dim is None else [0.0] * dim] * len(b)
            yield b.assign(**{out: vectors})

    return rows.mapInPandas(embed, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))
