"""Markdown chunking with a fixed window, and texts put together from chunks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import chunk_id

#: Window and overlap in tokens; a token counts as four characters.
MAX_TOKENS, OVERLAP_TOKENS, CHARS = 400, 40, 4
#: Separators in the order in which they are looked for (fixed values).
BREAKS = ("\n\n", "\n", ". ", " ")


#: Marks of headings of levels 1 to 3, which part sections and are dropped (fixed pattern).
HEADING = re.compile(r"(?m)^#{1,3}\s+")


def sections(text: str) -> list[str]:
    """Parts between headings of levels 1 to 3, without their marks and outer blanks; blank parts are dropped."""
    return [p for p in (x.strip() for x in HEADING.split(text)) if p]


def _break_ends(text: str) -> list[tuple[int, list[int]]]:
    """(length, sorted end positions) of each kind of break, overlapping ones included."""
    return [(len(b), [m.start() + len(b) for m in re.finditer(f"(?={re.escape(b)})", text)]) for b in BREAKS]


def window_cuts(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of at most ``size`` characters: each ends at the last break in the back half of its window,
    or at its end, and the next begins ``overlap`` characters before that."""
    breaks = _break_ends(text) if len(text) > size else []
    out, start, end = [], 0, 0
    while end < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            last = [(ends[k], n) for n, ends in breaks for k in [bisect_right(ends, end) - 1] if k >= 0]
            end = next((e for e, n in last if e - n >= start + size // 2), end)
        out.append(text[start:end].strip())
        start = max(end - overlap, start + 1)
    return [p for p in out if p]


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_idx, chunk_id, text): the chunks of every document, numbered from 0.

    Sections and windows are cut in one pass over Arrow batches. Null, empty and blank texts have no chunks.
    """
    size, overlap = MAX_TOKENS * CHARS, min(OVERLAP_TOKENS * CHARS, MAX_TOKENS * CHARS // 2)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pieces = [[p for s in sections(t) for p in window_cuts(s, size, overlap)] for t in b["text"]]
            n = np.array([len(p) for p in pieces], "int64")
            idx = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            flat = pd.Series([p for x in pieces for p in x], dtype=object)
            yield pd.DataFrame({key: np.repeat(b[key].to_numpy(object), n), "chunk_idx": idx, "text": flat})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, F.col(text).alias("text")).where("text is not null")
    each = rows.mapInPandas(cut, f"`{key}` {kind}, chunk_idx int, text string")
    return each.select(key, "chunk_idx", chunk_id(F.col(key).cast("string"), F.col("chunk_idx")).alias("chunk_id"), "text")


def _ordered_join(sep: str, *cols: str) -> Column:
    """Texts (last of ``cols``) of a group in the order of the others."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*cols))), lambda s: s[cols[-1]]), sep)


def reconstruct(chunks: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n_chunks, text): a document's chunks in order, joined by an empty line."""
    some = chunks.where(F.col("text").isNotNull())
    return some.groupBy(*by).agg(F.count(F.lit(1)).alias("n_chunks"), _ordered_join("\n\n", "chunk_idx", "id", "text").alias("text"))


def build_context(ranked: DataFrame, by: list[str]) -> DataFrame:
    """(by..., context): ranked chunks as numbered blocks with their source."""
    block = F.concat(F.lit("["), F.col("rank"), F.lit("] Source: "), F.coalesce("source", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return ranked.withColumn("_block", block).groupBy(*by).agg(_ordered_join("\n\n---\n\n", "rank", "_block").alias("context"))


def flatten_turns(turns: DataFrame, by: list[str], order: list[str], role: str, text: str) -> DataFrame:
    """(by..., text): turns as "role: text" lines in order."""
    line = F.concat(F.col(role), F.lit(": "), F.coalesce(F.col(text), F.lit("")))
    return turns.withColumn("_line", line).groupBy(*by).agg(_ordered_join("\n", *order, "_line").alias("text"))
