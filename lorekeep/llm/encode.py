"""Encoding of whole texts with a public byte-level BPE tokenizer.

Texts up to LEAF characters are encoded in batches. A longer one is cut into leaves that are encoded in
parallel and then joined as a tree, in rounds over (document, node): a node joins up to FAN_IN neighbours,
pairwise. Around each join a growing window is split into words again, from a word start that the left side
is sure of, until it meets a word start of the right side. From there on both sides agree exactly, because the
tokenizer's word pattern only looks ahead.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the tokenizer files and the characters of a leaf.
FOLDER = os.environ.get("LOREKEEP_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
LEAF = 8192
WINDOW = 64
#: Neighbouring nodes that one task joins in a round.
FAN_IN = 16
#: The word pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORDS = regex.compile(PATTERN)
#: Where a word begins wherever a scan starts: at a blank between two letters, and where letters, numbers and
#: other signs meet, but for letters after an apostrophe, which it may take along.
_STARTS = regex.compile(
    r"(?<=\p{L})(?= \p{L})|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])"
    r"|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])|(?<=')(?=\p{N})"
)


@lru_cache(maxsize=4)
def encoding(name: str = NAME, folder: str = FOLDER) -> tiktoken.Encoding:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_batch(texts: list[str], name: str = NAME, folder: str = FOLDER) -> list[list[int]]:
    enc = encoding(name, folder)
    return [enc.encode_ordinary(t) for t in texts]


def _words(text: str, start: int, end: int) -> Iterator[int]:
    """Starts of the words of text[start:end], whose scan begins at ``start``, and the end."""
    for m in _WORDS.finditer(text[start:end]):
        yield start + m.start()
    yield end


def join(text: str, left: tuple[int, int, list[int]], right: tuple[int, int, list[int]], enc: tiktoken.Encoding) -> tuple[int, int, list[int]]:
    """Encoding (start, end, ids) of two neighbouring encoded spans of ``text`` as one."""
    a, cut, x = left
    _, b, y = right
    size = WINDOW
    while True:
        lo, hi = max(a, cut - size), min(b, cut + size)
        start = _sure(text, a, lo, cut)
        if start is not None:
            seen = set(_words(text, cut, hi))
            seen.discard(hi)
            if hi == b:
                seen.add(b)
            # the last two words of a window cut short may end early
            ours = list(_words(text, start, hi))
            stable = ours if hi == b else ours[:-3]
            theirs = seen if hi == b else {w for w in seen if w <= (stable[-1] if stable else -1)}
            meet = next((w for w in stable if w >= cut and w in theirs), None)
            if meet is not None:
                # word by word, since the last of them may owe its end to what follows it
                at = ours[: ours.index(meet) + 1]
                middle = [t for p, q in zip(at, at[1:]) for t in enc.encode_ordinary(text[p:q])]
                return a, b, _head(text, a, start, cut, x, enc) + middle + _tail(text, cut, meet, y, enc)
        if lo == a and hi == b:
            return a, b, enc.encode_ordinary(text[a:b])
        size *= 4


def _sure(text: str, a: int, lo: int, cut: int) -> int | None:
    """A place in [lo, cut) where a word of any scan from ``a`` begins, or ``a`` itself when the window
    reaches back to it."""
    if lo == a:
        return a
    m = _STARTS.search(text[lo - 1 : cut])
    return lo - 1 + m.start() if m else None


def _head(text: str, a: int, start: int, cut: int, ids: list[int], enc: tiktoken.Encoding) -> list[int]:
    """The ids of text[a:start], given the ids of text[a:cut]: drop those of the rest."""
    if start == a:
        return []
    drop = len(text[start:cut].encode("utf-8", "surrogatepass"))
    k = len(ids)
    while drop > 0:
        k -= 1
        drop -= len(enc.decode_single_token_bytes(ids[k]))
    return ids[:k]


def _tail(text: str, cut: int, meet: int, ids: list[int], enc: tiktoken.Encoding) -> list[int]:
    drop = len(text[cut:meet].encode("utf-8", "surrogatepass"))
    k = 0
    while drop > 0:
        drop -= len(enc.decode_single_token_bytes(ids[k]))
        k += 1
    return ids[k:]


def join_tree(text: str, parts: list[tuple[int, int, list[int]]], enc: tiktoken.Encoding) -> list[int]:
    """Join neighbouring spans pairwise until one is left."""
    while len(parts) > 1:
        pairs = [join(text, parts[i], parts[i + 1], enc) for i in range(0, len(parts) - 1, 2)]
        parts = pairs + parts[len(parts) - len(parts) % 2 :]
    return parts[0][2]


def _encode(name: str, folder: str):
    def encode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            texts = b.column("text").to_pylist()
            step = 256  # keeps the lists of a batch of long texts small
            for i in range(0, len(texts), step):
                ids = encode_batch(texts[i : i + step], name, folder)
                yield pa.record_batch([*[b.column(c)[i : i + step] for c in b.schema.names if c != "text"], pa.array(ids, pa.list_(pa.int32()))], names=[*[c for c in b.schema.names if c != "text"], "ids"])

    return encode


def encode_texts(docs: DataFrame, key: str = "doc_id", name: str = NAME, folder: str = FOLDER, leaf: int = LEAF) -> DataFrame:
    """(key, ids): the token ids of every text, as if encoded in one piece, without special tokens.

    A null text gives null, an empty one an empty list. One row comes out per input row of a unique
    ``key``; columns beyond ``key`` and ``text`` are ignored. An empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, "text")
    short = rows.where(F.col("text").isNotNull() & (F.length("text") <= leaf)).mapInArrow(_encode(name, folder), f"`{key}` {kind}, ids array<int>")
    none = rows.where(F.col("text").isNull()).select(key, F.lit(None).cast("array<int>").alias("ids"))
    long = rows.where(F.length("text") > leaf)
    most = long.agg(F.max(F.length("text"))).first()[0] or 0

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for d, t in zip(b.column(key), b.column("text").to_pylist()):
                parts = [t[i : i + leaf] for i in range(0, len(t), leaf)]
                keys = pa.array([d.as_py()] * len(parts), b.column(key).type)
                yield pa.record_batch([keys, pa.array(range(len(parts)), pa.int32()), pa.array(parts)], names=[key, "k", "text"])

    # every leaf goes its own way, so that one very long text is encoded by many tasks
    leaves = long.mapInArrow(cut, f"`{key}` {kind}, k int, text string").repartition(F.col(key), F.col("k"))
    nodes = leaves.mapInArrow(_encode_leaves(name, folder), f"`{key}` {kind}, k int, text string, ids array<int>")

    def joined(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for b in source:
            whole, out = [], []
            for texts, ids in zip(b.column("texts").to_pylist(), b.column("idss").to_pylist()):
                ends = np.cumsum([len(t) for t in texts]).tolist()
                parts = [(e - len(t), e, x) for t, e, x in zip(texts, ends, ids)]
                whole.append("".join(texts))
                out.append(join_tree(whole[-1], parts, enc))
            yield pa.record_batch([b.column(key), b.column("k"), pa.array(whole), pa.array(out, pa.list_(pa.int32()))], names=[key, "k", "text", "ids"])

    width = leaf
    while width < most:
        width *= FAN_IN
        up = nodes.groupBy(key, F.floor(F.col("k") / FAN_IN).cast("int").alias("k"))
        near = up.agg(F.array_sort(F.collect_list(F.struct(F.col("k").alias("at"), "text", "ids"))).alias("p"))
        near = near.select(key, "k", F.col("p.text").alias("texts"), F.col("p.ids").alias("idss"))
        nodes = near.mapInArrow(joined, f"`{key}` {kind}, k int, text string, ids array<int>")
    return short.union(none).union(nodes.select(key, "ids"))


def _encode_leaves(name: str, folder: str):
    def encode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            ids = encode_batch(b.column("text").to_pylist(), name, folder)
            yield pa.record_batch([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, "ids"])

    return encode


def token_counts(docs: DataFrame, key: str = "doc_id", name: str = NAME, folder: str = FOLDER) -> DataFrame:
    """(key, tokens): the number of tokens of every text; 0 for null and empty texts."""
    ids = encode_texts(docs, key, name, folder)
    return ids.select(key, F.coalesce(F.size("ids"), F.lit(0)).alias("tokens"))
