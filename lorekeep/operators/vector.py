"""Exact vector retrieval, centroids and zero-shot classes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.vectors import cosine
from lorekeep.sources.tables import materialise

#: Vectors of a block, queries that one task keeps results of, and queries of one matrix product.
PACK, TASK_QUERIES, TILE = 2048, 16_384, 256


def search(vectors: DataFrame, query: Sequence[float], k: int, key: str = "vec_id") -> DataFrame:
    """(key, similarity, rank) of the k nearest vectors of one query; ties go to the lesser key.

    The query is part of the plan; every task keeps its own k best before the last sort.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    best = vectors.select(key, F.round(cosine(F.col("embedding"), q), 6).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), key)))


#: Rows of numbers from a column of vectors.
Decode = Callable[[pd.Series], np.ndarray]


def _arrays(column: pd.Series) -> np.ndarray:
    return np.concatenate([np.asarray(v, "float64") for v in column])


def _packed(vectors: DataFrame, key: str, vector: str, scope: list[str], prefix: str, decode: Decode = _arrays) -> DataFrame:
    """(scope..., {prefix}block, {prefix}keys, {prefix}flat): the vectors of each input batch as one row per scope, with a name
    of the row; flat has the bytes of their components."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), PACK):
                part = b.iloc[lo : lo + PACK]
                for s, g in part.groupby(scope, dropna=False, sort=False) if scope else [((), part)]:
                    row = {f"{prefix}block": uuid.uuid4().hex, f"{prefix}keys": [g[key].to_list()], f"{prefix}flat": [decode(g[vector]).tobytes()]}
                    yield pd.DataFrame({**dict(zip(scope, [[x] for x in s])), **row})

    kinds = [f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in scope]
    kind = vectors.schema[key].dataType.simpleString()
    schema = ", ".join([*kinds, f"{prefix}block string", f"{prefix}keys array<{kind}>", f"{prefix}flat binary"])
    return vectors.select(*scope, key, vector).where(F.col(vector).isNotNull()).mapInPandas(pack, schema)


class _Best:
    """The k best vectors so far of each query of a block: places of the queries, keys, similarities."""

    def __init__(self, queries: np.ndarray, scope: list, vectors: np.ndarray, size: np.ndarray, near: np.ndarray, k: int):
        self.queries, self.scope, self.vectors, self.size, self.near, self.k = queries, scope, vectors, size, near, k
        self.new, self.least = True, np.full(len(queries), -np.inf)
        self.at, self.keys, self.sim = np.empty(0, "int64"), None, np.empty(0)
        self.waiting: list[tuple] = []
        self.rows = 0

    def add(self, at: np.ndarray, keys: np.ndarray, sim: np.ndarray) -> None:
        self.waiting.append((at, keys, sim))
        self.rows += len(at)
        if self.new or self.rows > self.k * len(self.queries):
            self.merge()

    def merge(self) -> None:
        own = [] if self.new else [(self.at, self.keys, self.sim)]
        at, keys, sim = (np.concatenate(x) for x in zip(*own, *self.waiting))
        order = np.lexsort((keys, -sim, at))
        at, keys, sim = at[order], keys[order], sim[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        some = place < self.k
        self.at, self.keys, self.sim = at[some], keys[some], sim[some]
        full = place == self.k - 1
        self.least[at[full]] = sim[full]
        self.waiting, self.rows, self.new = [], 0, False


def search_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", scope: list[str] | None = None, decode: Decode = _arrays) -> DataFrame:
    """(query_id, scope..., key, similarity, rank): the k nearest vectors of each query of a stated set.

    ``queries`` holds query_id, qvec and the scope columns. Blocks of up to PACK queries meet blocks of up to PACK
    vectors, each scope's own where a scope is given; both are packed once. A task keeps k vectors a query over all of
    its blocks: every pair of blocks is a matrix product in single precision, TILE queries at a time, and only what may
    still enter is computed in double precision. Null vectors are left out; a vector without length has the similarity
    0. Ties go to the lesser key. ``decode`` reads the columns of vectors where they are no arrays.
    """
    scope = scope or []
    if scope:
        pairs = _packed(vectors, key, "embedding", scope, "v", decode).join(_packed(queries, "query_id", "qvec", scope, "q", decode), scope)
    else:
        known, few = materialise(_packed(vectors, key, "embedding", scope, "v", decode), "vectors"), materialise(queries.select("query_id", "qvec"), "queries")
        parts = max(1, -(-few.count() // TASK_QUERIES))
        pairs = known.crossJoin(materialise(_packed(few.repartition(parts), "query_id", "qvec", scope, "q", decode), "asked"))

    def unit(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.divide(rows, size[:, None], out=np.zeros(rows.shape), where=size[:, None] > 0).astype("float32")

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, _Best] = {}
        for b in batches:
            for r in b.to_dict("records"):
                v = np.frombuffer(r["vflat"]).reshape(len(r["vkeys"]), -1)
                if r["qblock"] not in kept:
                    q = np.frombuffer(r["qflat"]).reshape(len(r["qkeys"]), -1)
                    size = np.linalg.norm(q, axis=1)
                    kept[r["qblock"]] = _Best(np.asarray(r["qkeys"]), [r[c] for c in scope], q, size, unit(q, size), k)
                own, keys, size = kept[r["qblock"]], np.asarray(r["vkeys"]), np.linalg.norm(v, axis=1)
                near_v = np.ascontiguousarray(unit(v, size).T)
                # both precisions and the rounding differ by less
                slack = 1e-5 + 1e-6 * v.shape[1]
                pairs = []
                for lo in range(0, len(own.near), TILE):
                    near = own.near[lo : lo + TILE] @ near_v
                    least = own.least[lo : lo + TILE] - slack
                    if own.new and k < near.shape[1]:
                        least = np.maximum(least, np.partition(near, -k, axis=1)[:, -k] - 2 * slack)
                    least = least.astype("float32")
                    rows = np.flatnonzero(near.max(axis=1) >= least)
                    at, col = np.divmod(np.flatnonzero(near[rows] >= least[rows, None]), near.shape[1])
                    pairs.append((rows[at] + lo, col))
                at, col = (np.concatenate(x) for x in zip(*pairs))
                length = own.size[at] * size[col]
                dot = np.einsum("ij,ij->i", own.vectors[at], v[col])
                own.add(at, keys[col], np.round(np.divide(dot, length, out=np.zeros(len(at)), where=length > 0), 6) + 0.0)
        for own in kept.values():
            own.merge()
            out = {"query_id": own.queries[own.at], **{c: [x] * len(own.at) for c, x in zip(scope, own.scope)}}
            yield pd.DataFrame({**out, key: own.keys, "similarity": own.sim})

    fields = [("query_id", queries.schema["query_id"]), *[(c, vectors.schema[c]) for c in scope], (key, vectors.schema[key])]
    schema = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in fields) + ", similarity double"
    best = pairs.mapInPandas(nearest, schema)
    w = Window.partitionBy("query_id", *scope).orderBy(F.desc("similarity"), key)
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", *scope, key, "similarity", "rank")


def centroids(vectors: DataFrame, label: str) -> DataFrame:
    """(label, centroid): the mean vector of each class."""
    each = vectors.select(label, F.posexplode("embedding").alias("pos", "x"))
    mean = each.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("centroid"))


def classify(vectors: DataFrame, centers: DataFrame, label: str, key: str = "vec_id", threshold: float | None = None) -> DataFrame:
    """(key, predicted, similarity): the class of the nearest centroid; ties go to the lesser class.

    Below ``threshold`` no class is predicted (null). The classes are few and are broadcast.
    """
    near = vectors.select(key, "embedding").crossJoin(F.broadcast(centers.select(F.col(label).alias("c"), "centroid")))
    sim = F.round(cosine(F.col("embedding"), F.col("centroid")), 6)
    best = near.groupBy(key).agg(F.min_by(F.struct("c", sim.alias("s")), F.struct((-sim).alias("n"), "c")).alias("b"))
    c = F.col("b.c") if threshold is None else F.when(F.col("b.s") >= threshold, F.col("b.c"))
    return best.select(key, c.alias("predicted"), F.col("b.s").alias("similarity"))
