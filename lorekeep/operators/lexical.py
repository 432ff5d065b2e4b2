"""Okapi BM25 over exploded postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import tokens
from lorekeep.sources.tables import materialise

K1, B = 1.5, 0.75
#: Query terms up to this number are sent to all tasks; more are joined by shuffle.
BROADCAST_TERMS = 100_000
#: Documents of a block, asked tokens after which one is closed early, queries of a block that meets it, and bytes of
#: texts whose tokens are found at once.
DOC_BLOCK, BLOCK_TOKENS, QUERY_BLOCK, SLICE = 12_288, 1 << 23, 16_384, 1 << 19


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of every document; a document's own terms are counted before any shuffle."""
    own = docs.select(key, F.explode(tokens(F.col(text))).alias("term"))
    return own.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dl): tokens of every document; 0 for null and empty texts."""
    return docs.select(key, F.coalesce(F.size(tokens(F.col(text))), F.lit(0)).alias("dl"))


def term_stats(posting: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln(1 + (N - n + 0.5) / (n + 0.5)); ``n_docs`` has one row with n."""
    df = posting.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n_docs)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def _query_terms(queries: DataFrame, scope: list[str]) -> DataFrame:
    """(query_id, scope..., term, times) of every query."""
    own = queries.select("query_id", *scope, F.explode(tokens(F.col("query"))).alias("term"))
    return own.groupBy("query_id", *scope, "term").agg(F.count(F.lit(1)).alias("times"))


def bm25_scores(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", scope: list[str] | None = None) -> DataFrame:
    """(query_id, scope..., key, score > 0) of every document that shares a term with a query.

    ``queries`` holds query_id, query (and the scope columns, if any). A repeated query term counts
    each time. Within a ``scope`` (such as the project) document counts and lengths are its own.
    """
    scope = scope or []
    terms = _query_terms(queries, scope)
    split = docs.select(key, *scope, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("toks"))
    split = split.withColumn("dl", F.size("toks"))  # before the explode, which then carries no array along
    lengths = split.select(key, *scope, "dl")
    corpus = lengths.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    # only the queries' terms are counted: the terms reach the tokens before anything is shuffled
    asked = terms.select(*scope, "term").distinct()
    if asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        asked = F.broadcast(asked)
    hit = split.select(key, *scope, "dl", F.explode("toks").alias("term"))
    tf = hit.join(asked, [*scope, "term"]).groupBy(key, *scope, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    stat = df.crossJoin(F.broadcast(corpus)) if not scope else df.join(corpus, scope)
    weighed = stat.select(*scope, "term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = tf.join(weighed, [*scope, "term"]).join(terms, [*scope, "term"]).groupBy("query_id", *scope, key).agg(F.round(F.sum(part * F.col("times")), 6).alias("score"))
    return scored.where(F.col("score") > 0)


def _raw(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 in the fewest bytes each; ``_numbers`` reads them."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}" if n else "u1").astype("int64")


class _Vocabulary:
    """Numbers of stated terms, looked up for many tokens at once.

    A term is a run of words of eight bytes, the last one filled up with zeros. The tokens go word by word through a
    tree of these runs; whole words are compared, so no two terms are taken for one another.
    """

    def __init__(self, terms: list[str]):
        runs = [(i, np.frombuffer(t.encode().ljust(-(-len(t) // 8) * 8, b"\0"), "<u8").tolist()) for i, t in enumerate(terms)]
        self.levels: list[tuple[pa.Array, pa.Array, int, np.ndarray]] = []
        node = dict.fromkeys(range(len(terms)), 0)  # of each term, at the level before
        while runs:
            depth = len(self.levels)
            words = {w: j for j, w in enumerate(sorted({x[depth] for _, x in runs}))}
            codes = {i: node[i] * len(words) + words[x[depth]] for i, x in runs}
            nodes = {c: j for j, c in enumerate(sorted(set(codes.values())))}
            node, ends = {i: nodes[c] for i, c in codes.items()}, np.full(len(nodes), -1)
            for i, x in runs:
                if len(x) == depth + 1:
                    ends[node[i]] = i
            self.levels.append((pa.array(list(words), pa.uint64()), pa.array(list(nodes), pa.int64()), len(words), ends))
            runs = [(i, x) for i, x in runs if len(x) > depth + 1]

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each token, -1 where it is no term."""
        word = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, "u1")]), strides=(1,))
        out, own, node = np.full(len(starts), -1), np.arange(len(starts)), np.zeros(len(starts), "int64")
        for depth, (words, codes, width, terms) in enumerate(self.levels):
            if not len(own):
                break
            left = ends[own] - starts[own] - 8 * depth
            x = word[starts[own] + 8 * depth] & _FIRST_BYTES[np.minimum(left, 8)]
            some, found = _places(x, words)
            own, left, node = own[some], left[some], node[some]
            some, node = _places(node * width + found, codes)
            own, left = own[some], left[some]
            last = left <= 8
            out[own[last]] = terms[node[last]]
            own, node = own[~last], node[~last]
        return out


#: Masks of the first 0 to 8 bytes of a word.
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], "<u8")
_IN_TOKEN = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))


def _places(values: np.ndarray, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in ``known``, and where there."""
    at = pc.fill_null(pc.index_in(pa.array(values, known.type), value_set=known), -1).to_numpy()
    some = np.flatnonzero(at >= 0)
    return some, at[some].astype("int64")


def _doc_blocks(docs: DataFrame, asked: list[str], key: str, text: str) -> DataFrame:
    """(keys, dl, df, doc, tf): documents in blocks, in each by key. df counts the documents of each term of ``asked``;
    doc and tf are those documents (their places in the block) and the term's count in them, term by term."""
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary(asked)
        keys, dl, codes, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal keys, dl, codes, held
            order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i]))
            term, doc = np.divmod(np.concatenate(codes), DOC_BLOCK)
            place = np.empty(len(order), "int64")
            place[order] = np.arange(len(order))
            code = np.sort(term * DOC_BLOCK + place[doc])
            first = np.flatnonzero(np.diff(code, prepend=-1))
            term, doc = np.divmod(code[first], DOC_BLOCK)
            each = np.concatenate(dl)[order], np.bincount(term, minlength=len(asked)), doc, np.diff(first, append=len(code))
            own = pa.array([[keys[i] for i in order]], pa.list_(key_type))
            keys, dl, codes, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([own, *(pa.array([_raw(x)], pa.binary()) for x in each)], ["keys", "dl", "df", "doc", "tf"])

        for b in batches:
            key_type, lo = b.schema.field(0).type, 0
            names, raw = b.column(0).to_pylist(), b.column(1).cast(pa.large_binary())
            bounds = np.frombuffer(raw.buffers()[1], "int64")[raw.offset : raw.offset + len(raw) + 1]
            while lo < len(raw):
                hi = min(max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SLICE))), len(raw), lo + DOC_BLOCK - len(keys))
                at = bounds[lo : hi + 1]
                data = np.frombuffer(raw.buffers()[2], "u1")[at[0] : at[-1]]
                # every text ends outside of a token
                edge = np.flatnonzero(np.diff(_IN_TOKEN[data], prepend=False))
                starts, ends = edge[0::2], edge[1::2]
                n = np.diff(np.searchsorted(starts, at - at[0]))
                number = vocabulary.numbers(data, starts, ends)
                some = np.flatnonzero(number >= 0)
                codes.append(number[some] * DOC_BLOCK + np.repeat(np.arange(len(keys), len(keys) + len(n)), n)[some])
                dl.append(n)
                keys.extend(names[lo:hi])
                held, lo = held + len(some), hi
                if len(keys) == DOC_BLOCK or held > BLOCK_TOKENS:
                    yield block()
        if keys:
            yield block()

    low = docs.select(key, F.concat(F.coalesce(F.lower(F.col(text)), F.lit("")), F.lit("\n")).cast("binary").alias("low"))
    return low.mapInArrow(count, f"keys array<{kind}>, dl binary, df binary, doc binary, tf binary")


def _query_blocks(terms: DataFrame, asked: list[str]) -> DataFrame:
    """(keys, at, term, times): queries in blocks, as in ``_doc_blocks``."""
    kind = terms.schema["query_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(asked)}
        for b in batches:
            for lo in range(0, b.num_rows, QUERY_BLOCK):
                part = b.slice(lo, QUERY_BLOCK)
                own = [sorted((number[x["term"]], x["times"]) for x in q) for q in part.column(1).to_pylist()]
                each = np.array([x for q in own for x in q], "int64").reshape(-1, 2)
                ends = np.cumsum([0, *map(len, own)])
                keys = pa.array([part.column(0).to_pylist()], pa.list_(b.schema.field(0).type))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([_raw(x)], pa.binary()) for x in (ends, each[:, 0], each[:, 1]))], ["qkeys", "qat", "qterm", "qtimes"])

    lists = materialise(terms.groupBy("query_id").agg(F.collect_list(F.struct("term", "times")).alias("own")), "queries")
    parts = -(-lists.count() // QUERY_BLOCK)
    return lists.repartition(max(1, parts)).mapInArrow(pack, f"qkeys array<{kind}>, qat binary, qterm binary, qtimes binary")


def _block_stats(blocks: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents, their tokens, documents of each term)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, size = np.zeros(n_terms, "int64"), 0, 0
        for b in batches:
            for keys, dl, own in zip(*(b.column(i).to_pylist() for i in range(3))):
                df += _numbers(own, n_terms)
                n, size = n + keys, size + int(_numbers(dl, keys).sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int32()), pa.array([n, size, *df[some].tolist()], pa.int64())], ["term", "n"])

    total = {r.term: r.n for r in blocks.select(F.size("keys"), "dl", "df").mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return total.get(-2, 0), total.get(-1, 0), np.array([total.get(i, 0) for i in range(n_terms)], "float64")


class _Block:
    """The weights of a block of documents by term: a row over all documents for frequent terms, else a list."""

    def __init__(self, r: dict, idf: np.ndarray, avgdl: float, frequent: list[int]):
        self.keys = r["keys"]
        self.names = np.asarray(self.keys)
        if self.names.dtype.kind != "i":
            self.names = np.empty(len(self.keys), object)
            self.names[:] = self.keys
        dl, df = _numbers(r["dl"], len(self.keys)), _numbers(r["df"], len(idf))
        self.doc, tf = _numbers(r["doc"], int(df.sum())), _numbers(r["tf"], int(df.sum())).astype("float64")
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[self.doc] / avgdl))
        self.at = np.cumsum([0, *df]).tolist()
        self.rows = {t: self._sum(*self._list(t)) for t in frequent}

    def _sum(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.bincount(docs, weights, len(self.keys)) if len(docs) else np.zeros(len(self.keys))

    def _list(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.at[t], self.at[t + 1])
        return self.doc[own], self.weight[own]

    def scores(self, terms: list[int], times: list[int]) -> np.ndarray:
        """The score of every document: the lists are added up in the order of the terms, then the rows."""
        lists, rows = [], []
        for t, m in zip(terms, times):
            if (row := self.rows.get(t)) is not None:
                rows.append(row if m == 1 else row * m)
            else:
                docs, own = self._list(t)
                lists.append((docs, own if m == 1 else own * m))
        if len(lists) > 1:
            lists = [tuple(map(np.concatenate, zip(*lists)))]
        out = self._sum(*lists[0]) if lists else np.zeros(len(self.keys))
        for row in rows:
            out += row
        return out


class _Tops:
    """The k best documents so far of each query of a block: places of the queries, keys of the documents, scores."""

    def __init__(self, r: dict, k: int):
        self.keys, self.k = r["qkeys"], k
        at = _numbers(r["qat"], len(self.keys) + 1).tolist()
        term, times = (_numbers(r[x], at[-1]).tolist() for x in ("qterm", "qtimes"))
        self.each = [(term[lo:hi], times[lo:hi]) for lo, hi in zip(at, at[1:])]
        self.least = np.full(len(self.keys), 5e-7)  # what may still enter
        self.at, self.found, self.score = np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)

    def add(self, block: _Block) -> None:
        k, at, docs, scores = self.k, [], [], []
        for q, ((term, times), least) in enumerate(zip(self.each, self.least.tolist())):
            score = block.scores(term, times)
            some = np.flatnonzero(score >= least)
            if not len(some):
                continue
            found = score[some]
            if len(some) > 4 * k:
                some = some[found >= np.partition(found, len(some) - k)[len(some) - k] - 1e-6]
                found = score[some]
            if len(some) > 4 * k:  # many of about the same score
                found = np.round(found, 6)
                enter = found >= np.partition(found, len(some) - k)[len(some) - k]
                some, found = some[enter], found[enter]
                first = np.argsort(-found, kind="stable")[:k]
                some, found = some[first], found[first]
            at.append(q)
            docs.append(some)
            scores.append(found)
        if not at:
            return
        new = np.repeat(at, [len(x) for x in docs]), block.names[np.concatenate(docs)], np.round(np.concatenate(scores), 6)
        # of equal scores what is kept already may have the greater keys, so the keys decide
        at, found, score = (np.concatenate(x) for x in zip((self.at, self.found, self.score), new))
        order = np.lexsort((found, -score, at))
        at, found, score = at[order], found[order], score[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        some = (place < k) & (score > 0)
        self.at, self.found, self.score = at[some], found[some], score[some]
        full = place == k - 1
        self.least[at[full]] = np.maximum(5e-7, score[full] - 1e-6)


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, key, score, rank): what ``top_k`` gives of ``bm25_scores``, without a row for every pair.

    The counts of the asked terms of each document become a scratch table of blocks, term by term. Blocks of queries
    meet blocks of documents; a task adds up the weights of all of its documents and passes on k documents a query. Keys that repeat or are null, and more than BROADCAST_TERMS terms, are left to ``bm25_scores``.
    """
    terms = materialise(_query_terms(queries, []), "terms")
    asked = sorted(r.term for r in terms.select("term").distinct().limit(BROADCAST_TERMS + 1).collect())
    blocks = materialise(_doc_blocks(docs, asked, key, text), "postings") if len(asked) <= BROADCAST_TERMS else None
    own = blocks and blocks.select(F.explode("keys").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("x").alias("d")).first()
    if blocks is None or own.n != own.d:
        return top_k(bm25_scores(docs, queries, key, text), k, ["query_id"], tie=key)
    n, size, df = _block_stats(blocks, len(asked))
    idf, avgdl = np.log(1 + (n - df + 0.5) / (df + 0.5)), size / n if size else 1.0
    frequent = np.flatnonzero(df * 4 > n).tolist()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[object, _Tops] = {}
        block = types = None
        for b in batches:
            types = types or [b.schema.field(x).type.value_type for x in ("qkeys", "keys")]
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if block is None or block.keys[0] != r["keys"][0]:
                    block = _Block(r, idf, avgdl, frequent)
                name = r["qkeys"][0]
                if name not in kept:
                    kept[name] = _Tops(r, k)
                kept[name].add(block)
        for own in kept.values():
            queries = [own.keys[i] for i in own.at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(queries, types[0]), pa.array(own.found.tolist(), types[1]), pa.array(own.score, pa.float64())], ["query_id", key, "score"])

    kinds = [f"`{c}` {x.schema[c].dataType.simpleString()}" for x, c in ((terms, "query_id"), (docs, key))]
    pairs = blocks.crossJoin(materialise(_query_blocks(terms, asked), "asked"))
    return top_k(pairs.mapInArrow(best, f"{', '.join(kinds)}, score double"), k, ["query_id"], tie=key)


def top_k(scored: DataFrame, k: int, by: list[str], score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each group with their ``rank`` from 1; ties go to the lesser ``tie``."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def boosts(ranked: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``boost``: the score as a share of the group's best, to four places."""
    return ranked.withColumn("boost", F.round(F.col("score") / F.max("score").over(Window.partitionBy(*by)), 4))
