"""Filling containers of fixed token capacity by multiway differencing.

Documents are spread over shards by a hash of their id, each of some BINS containers' worth of tokens.
Inside a shard the Karmarkar-Karp rule merges the two partial partitions of the greatest imbalance,
heaviest part against lightest, until one partition is left; whenever its heaviest part exceeds the
capacity the number of containers rises by one.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.encode import token_counts
from lorekeep.sources.tables import materialise

CAPACITY = 4096
#: A shard's content: about so many full containers, at most about so many items.
BINS, ITEMS = 48, 2000


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(part of each item, sums of the parts) by multiway differencing into k parts."""
    heap, trees = [], []
    for i, s in enumerate(sizes.tolist()):
        sums = np.zeros(k, "int64")
        sums[0] = s
        trees.append([i, *[None] * (k - 1)])
        heap.append((-s, i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        joined = a + b[::-1]  # a is sorted downwards, so its heaviest part meets b's lightest
        order = np.argsort(-joined, kind="stable")
        left, right = trees[i], trees[j][::-1]
        trees[i] = [_both(left[p], right[p]) for p in order]
        joined = joined[order]
        heapq.heappush(heap, (int(joined[-1] - joined[0]), i, joined))
    part = np.zeros(len(sizes), "int64")
    _, i, sums = heap[0]
    for p, tree in enumerate(trees[i]):
        stack = [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack.extend(t)
            elif t is not None:
                part[t] = p
    return part, sums


def _both(a, b):
    return b if a is None else a if b is None else (a, b)


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, no container above the capacity; no item may exceed it."""
    k = max(1, math.ceil(int(sizes.sum()) / capacity))
    while True:
        part, sums = difference(sizes, k)
        if sums.max(initial=0) <= capacity:
            return part
        k += 1


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, token_from, token_to, container, container_tokens) of rows (doc_id, tokens).

    A document up to the capacity is one piece. A larger one is cut into full containers of its own and
    a rest, which is packed like a document. Documents of no tokens take up no space and sit in a
    container of their shard. Null sizes count as 0; doc_id must be unique and not null. An empty table
    gives an empty result. Only two totals reach the driver.
    """
    sizes = sizes.select("doc_id", F.coalesce(F.col("tokens"), F.lit(0)).cast("bigint").alias("tokens"))
    full = F.floor(F.greatest(F.col("tokens") - 1, F.lit(0)) / capacity)
    cut = sizes.select("doc_id", "tokens", full.alias("full"))
    whole = cut.where(F.col("full") > 0).select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece"))
    whole = whole.select(
        "doc_id",
        "piece",
        (F.col("piece") * F.lit(capacity).cast("bigint")).alias("token_from"),
        ((F.col("piece") + 1) * F.lit(capacity).cast("bigint")).alias("token_to"),
        F.concat(F.lit("d"), "doc_id", F.lit("-"), "piece").alias("container"),
        F.lit(capacity).cast("bigint").alias("container_tokens"),
    )
    rest = cut.select("doc_id", F.col("full").cast("int").alias("piece"), (F.col("full") * capacity).alias("token_from"), F.col("tokens").alias("token_to"))
    n, total = rest.agg(F.count(F.lit(1)), F.sum(F.col("token_to") - F.col("token_from"))).first()
    shards = max(1, math.ceil((total or 0) / (BINS * capacity)), math.ceil(n / ITEMS))
    keyed = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(n=group.token_to - group.token_from).sort_values(["n", "doc_id"], ascending=[False, True])
        part = fill(group.n.to_numpy("int64"), capacity)
        load = np.bincount(part, weights=group.n)[part].astype("int64")
        return group.assign(container=[f"s{s}-{p}" for s, p in zip(group.shard, part)], container_tokens=load)[["doc_id", "piece", "token_from", "token_to", "container", "container_tokens"]]

    kind = sizes.schema["doc_id"].dataType.simpleString()
    return keyed.groupBy("shard").applyInPandas(place, f"doc_id {kind}, piece int, token_from bigint, token_to bigint, container string, container_tokens bigint").union(whole)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pack`` of texts sized in tokens of the byte-level BPE tokenizer; null and empty texts have none."""
    return pack(materialise(token_counts(docs), "sizes"), capacity)  # else both passes of pack would encode
