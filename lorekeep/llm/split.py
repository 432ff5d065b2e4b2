"""Splitting oversized chunks at natural boundaries by packing a structure tree.

A text's lines are parsed into a tree: sections by heading level, then blocks (paragraphs between blank
lines, code fences, closed elements of markup), list items and elements by their nesting, lines, sentences,
clauses and words. Each boundary has the depth of the nodes that it separates; inside a code fence there are
no headings, blocks or items. A node within the limit stays whole; only an oversized node is opened, and its
packed children are merged with their neighbours as long as they fit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.sources.tables import materialise

LIMIT, OVERLAP = 1600, 160
#: Signs that do not count at both ends of a text.
BLANK = " \t\r\n"

# Depths of boundaries: 0 to 5 are headings of levels 1 to 6.
BLOCK, ITEM, NESTED, LINE, SENTENCE, CLAUSE, WORD = 6, 7, 9, 10, 11, 12, 13

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_HEADING = re.compile(r"#{1,6}(?=[ \t])")
_FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
_ITEM = re.compile(r"([ \t]*)(?:[-*+]|\d{1,3}[.)])[ \t]")
#: Elements of markup that stand as blocks (fixed values).
_TAG = re.compile(r"(?i)<(/?)(p|div|section|article|table|tbody|ul|ol|li|tr|pre|blockquote|h[1-6])\b[^<>]*>|<br ?/?>")
_INNER = {
    SENTENCE: re.compile(r"(?<=[.!?…])[\"'»”)\]]*[ \t]+|(?<=[。！？；])"),
    CLAUSE: re.compile(r"(?<=[,;:，、])\s*|(?<=[}\])])"),
    WORD: re.compile(r"\s+"),
}


def boundaries(text: str, start: int, end: int) -> list[list[int]]:
    """Sorted positions within (start, end) at which a node of each depth down to lines begins."""
    depth: dict[int, int] = {}

    def mark(at: int, d: int) -> None:
        if start < at < end:
            depth[at] = min(d, depth.get(at, d))

    fence, blank, indents, open_tags, at = "", False, [], 0, start
    while at < end:
        line = _LINE.match(text, at, end)
        stop = line.end() if line.end() > at else end
        body = text[at:stop]
        mark(at, LINE)
        sign = _FENCE.match(body)
        if fence:
            # only a fence of the same sign, as long and with nothing behind it, closes
            if sign and sign[1][0] == fence[0] and len(sign[1]) >= len(fence) and not body[sign.end() :].strip():
                fence = ""
                mark(stop, BLOCK)
        elif not body.strip():
            blank = True
        else:
            item, heading = _ITEM.match(body), _HEADING.match(body)
            if sign:
                fence = sign[1]
                mark(at, BLOCK)
            elif heading:
                mark(at, len(heading[0]) - 1)
                indents = []
            elif item:
                width = len(item[1].expandtabs(4))
                while indents and indents[-1] > width:
                    indents.pop()
                if not indents or indents[-1] < width:
                    # a list belongs to the text before it unless a blank line parts them
                    mark(at, BLOCK if blank and not indents else min(NESTED, ITEM + len(indents)))
                    indents.append(width)
                else:
                    mark(at, min(NESTED, ITEM + len(indents) - 1))
            elif blank:
                inner = indents and body[:1] in " \t"  # a paragraph of a list item
                mark(at, min(NESTED, ITEM + len(indents)) if inner else BLOCK)
                indents = indents if inner else []
            for tag in _TAG.finditer(body):
                closing = bool(tag[1])
                open_tags = max(0, open_tags - 1) if closing else open_tags
                d = LINE if tag[2] is None else min(NESTED, BLOCK + open_tags)
                mark(at + (tag.end() if closing or tag[2] is None else tag.start()), d)
                open_tags += not closing and tag[2] is not None
            blank = False
        at = stop
    out: list[list[int]] = [[] for _ in range(LINE + 1)]
    for p in sorted(depth):
        out[depth[p]].append(p)
    return out


def _hard(text: str, start: int, end: int, size: int) -> list[tuple[int, int]]:
    """Cuts where there is no boundary at all, though not before a combining mark or inside CR LF."""
    out = []
    while end - start > size:
        cut = start + size
        while cut > start + size // 2 and (_joined(text[cut]) or text[cut - 1 : cut + 1] == "\r\n" or text[cut - 1] == "‍"):
            cut -= 1
        out.append((start, cut))
        start = cut
    return [*out, (start, end)]


def _joined(sign: str) -> bool:
    n = ord(sign)
    return 0x300 <= n < 0x370 or 0x1AB0 <= n < 0x1B00 or 0x20D0 <= n < 0x2100 or 0xFE00 <= n < 0xFE10 or n == 0x200D or 0x1F3FB <= n <= 0x1F3FF


def _children(text: str, start: int, end: int, depth: int, tree: list[list[int]]) -> list[int]:
    if depth <= LINE:
        return tree[depth][bisect_right(tree[depth], start) : bisect_left(tree[depth], end)]
    return [m.end() for m in _INNER[depth].finditer(text, start, end) if start < m.end() < end]


def _pack(text: str, start: int, end: int, size: int, depth: int, tree: list[list[int]]) -> list[tuple[int, int]]:
    if end - start <= size:
        return [(start, end)]
    cuts: list[int] = []
    while not cuts:
        if depth > WORD:
            return _hard(text, start, end, size)
        cuts = _children(text, start, end, depth, tree)
        depth += 1
    out: list[tuple[int, int]] = []
    for a, b in zip([start, *cuts], [*cuts, end]):
        for p, q in _pack(text, a, b, size, depth, tree):
            if out and q - out[-1][0] <= size:
                out[-1] = (out[-1][0], q)
            else:
                out.append((p, q))
    return out


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, core, end) of each piece: text[core:end] tile the text without blank ends, and
    text[start:core] repeats the ``overlap`` characters before the core. A piece has at most ``limit``
    characters."""
    a = len(text) - len(text.lstrip(BLANK))
    b = len(text.rstrip(BLANK))
    if b - a <= limit:
        return [(0, 0, len(text))]
    tree = boundaries(text, a, b)
    return [(max(a, p - overlap) if p > a else p, p, q) for p, q in _pack(text, a, b, limit - overlap, 0, tree)]


_SPANS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "core", "end")]))


def spans(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """array<struct<start,core,end>> of a text's pieces; one piece, the whole text, where it fits.

    Only oversized texts reach Python. A null text has one empty piece.
    """
    if not 0 <= overlap <= limit // 2:
        raise ValueError("the overlap must lie between nothing and half the limit")

    @F.pandas_udf(_SPANS)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [dict(zip(("start", "core", "end"), p)) for p in pieces_of(t, limit, overlap)])

    big = F.length(F.trim(text, F.lit(BLANK))) > limit
    one = F.struct(F.lit(0).alias("start"), F.lit(0).alias("core"), F.coalesce(F.length(text), F.lit(0)).alias("end"))
    return F.coalesce(cut(F.when(big, text)), F.array(one))


def cut_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, doc_id, chunk_idx, project, source, text, spans): every chunk once, with its pieces' spans.

    Rows of one id are one chunk (only ``similarity`` may differ, which is not kept); of rows that differ
    otherwise the least counts. A row without id is named by a hash of its content.
    """
    key = F.coalesce("id", F.concat(F.lit("anon-"), F.md5(F.to_json(F.struct("doc_id", "chunk_idx", "text")))))
    rest = ["doc_id", "chunk_idx", "project", "source", "text"]
    named = chunks.select(key.alias("id"), *rest).groupBy("id").agg(F.min(F.struct(*rest)).alias("c"))
    return named.select("id", "c.*").withColumn("spans", spans(F.col("text"), limit, overlap))


def oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id): the chunks that come out as several pieces."""
    return chunks.where(F.col("id").isNotNull()).select("id", F.size(spans(F.col("text"), limit, overlap)).alias("n")).where(F.col("n") > 1).select("id").distinct()


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: (id, doc_id, chunk_idx, project, source, from_id, start_pos, core_pos, end_pos, text).

    chunk_idx is dense from 0 within doc_id, in the order of the old chunk_idx, then id; id is
    md5(doc_id:chunk_idx). Positions count characters of the chunk from_id; ``text`` is
    [start_pos, end_pos), its part before core_pos repeats the piece before it. Texts within the limit,
    null, empty and blank ones come out as one piece, unchanged. Other columns, such as query-time
    scores, are dropped. An empty table gives an empty result.
    """
    cut = materialise(cut_chunks(chunks, limit, overlap), "pieces")
    # dense numbers by two prefix sums over ranges of (doc_id, chunk_idx, id), so that the chunks of one document,
    # or those without one, are spread over tasks
    light = cut.select("id", "doc_id", "chunk_idx", F.size("spans").alias("n"))
    ranged = light.repartitionByRange("doc_id", "chunk_idx", "id").withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "order")
    parts = ranged.groupBy("doc_id", "part").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("doc_id", "part", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("base"))
    inner = Window.partitionBy("doc_id", "part").orderBy("chunk_idx", "id").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("id", "doc_id", "part", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("before")).alias("l")
    on = F.col("l.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("l.part") == F.col("b.part"))
    first = local.join(base.alias("b"), on).select("id", (F.col("before") + F.col("base")).alias("first"))
    each = cut.join(first, "id").select("*", F.posexplode("spans").alias("k", "s"))
    idx = (F.col("first") + F.col("k")).cast("int")
    return each.select(
        F.md5(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), idx)).alias("id"),
        "doc_id",
        idx.alias("chunk_idx"),
        "project",
        "source",
        F.col("id").alias("from_id"),
        F.col("s.start").alias("start_pos"),
        F.col("s.core").alias("core_pos"),
        F.col("s.end").alias("end_pos"),
        F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("text"),
    )
