"""Near-duplicate texts: exact set similarity by tiled comparison of odd sketches.

1. Every text becomes its set of distinct three-word shingles. Texts of a project with equal sets form
   one class (``ref``, a 64-bit hash), so copies cost one row. A class carries its set size n and an
   odd sketch of at least 2n bits: the parity of its shingles per bit. The exclusive-or of two sketches
   is the sketch of the sets' symmetric difference, so its bit count never exceeds that difference.
2. Blocks come from prefix filtering, which loses no pair: sets with a similarity of at least t share
   one of the first n - ceil(t n) + 1 shingles in any fixed order. Rare shingles come first, by a count
   sketch of fixed size over all texts.
3. A shingle that the sketch counts TILE times or more is hot: its classes are never gathered. They are
   counted by (level, bit count), cut into tiles along that order, and only the pairs of tiles whose bit counts
   lie within the radius become blocks. For similarity t the radius is (1-t)/(1+t) of the summed sizes.
4. Inside blocks, sorted by bit count, tiles are compared with exclusive-or and bit counts; rows or
   tiles whose bit counts differ beyond the radius are skipped.
5. Surviving pairs are verified on the sets of their shingles' hashes: first on KEPT bytes of each, and pairs
   that SLACK shingles more or less would decide once more on whole 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.shingles import mix, ordered, project_keys, shingles, text_slices
from lorekeep.operators.components import connected_components
from lorekeep.sources.tables import materialise

#: Similarity limit as a fraction, 3/5.
NUM, DEN = 3, 5
#: Counters of the shingle count sketch and bits of the filter of paired classes, as powers of two.
COUNT_BITS, FILTER_BITS = 22, 24
#: Classes from which a shingle is hot, which are those of a tile between tasks; rows of a tile inside a task.
TILE, ROWS = 2048, 256
PIECE = 4096
#: Bits of the smallest odd sketch, as a power of two; each level has twice as many.
SKETCH_BITS = 8
#: Bytes of each hash in the first test of a pair, and the shared shingles by which it may be wrong: two different
#: shingles agree in five bytes with a chance of 2^-40, so two such accidents in one pair do not happen.
KEPT, SLACK = 5, 1
#: A sort key of sketches is the level above so many bits, which hold the bit count.
LEVEL_AT = 26


def _batches(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(batch, from, to, text index, shingle, per-text counts) for slices of Arrow batches."""
    for b in source:
        texts, projects = b.column("text").to_pylist(), b.column("project").to_pylist()
        for lo, hi in text_slices(texts):
            text, sh = shingles(texts[lo:hi], project_keys(projects[lo:hi]))
            yield b, lo, hi, text, sh, np.bincount(text, minlength=hi - lo)


def _refs(sh: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Class of each text: a hash of its shingle set; 0 for texts without shingles."""
    out = np.zeros(len(n), "uint64")
    some = n > 0
    if some.any():
        out[some] = mix(np.add.reduceat(mix(sh), np.concatenate(([0], np.cumsum(n[some])[:-1]))) + n[some].astype("uint64"))
    return out


def _level(n: np.ndarray) -> np.ndarray:
    """Sketch level of a set size; sizes of similar sets differ by less than a factor of two, so by one level."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(2 * n, 1))).astype("int64") - SKETCH_BITS)


def _odd_sketches(sh: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Parity bits of each text's shingles; the bit is taken from a shingle's low bits, so that the halves
    of a sketch fold into the sketch of half the bits."""
    bits = 1 << (SKETCH_BITS + _level(n))
    start = np.cumsum(bits) - bits
    at = np.repeat(start, n) + (sh & np.repeat(bits - 1, n).astype("uint64")).astype("int64")
    odd = (np.bincount(at, minlength=int(bits.sum())) & 1).astype("uint8")
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[a >> 3 : (a + k) >> 3] for a, k in zip(start.tolist(), bits.tolist())]


def _order(odd: list[bytes], n: np.ndarray) -> np.ndarray:
    """Sort key of sketches: by level, then by bit count."""
    return ((_level(n) << LEVEL_AT) + np.array([int.from_bytes(x).bit_count() for x in odd], "int64")).astype("int32")


_SCAN = "id string, project string, ref bigint, n int, bits int, sketch binary, piece int, counts binary"


def _scan(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class, size and sketch of every row; at the end this task's shingle counts in pieces."""
    counts = np.zeros(1 << COUNT_BITS, "uint32")
    for b, lo, hi, _, sh, n in _batches(source):
        counts += np.bincount((sh >> np.uint64(64 - COUNT_BITS)).astype("int64"), minlength=len(counts)).astype("uint32")
        odd = _odd_sketches(sh, n)
        none = pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())
        yield pa.record_batch([b.column("id")[lo:hi], b.column("project")[lo:hi], pa.array(_refs(sh, n).view("int64")), pa.array(n.astype("int32")), pa.array(_order(odd, n), pa.int32()), pa.array(odd, pa.binary()), *none], names=_names(_SCAN))
    pieces = counts.reshape(-1, PIECE)
    used = np.flatnonzero(pieces.any(axis=1))
    # a piece of small counts takes one byte for each
    raw = [(pieces[i].astype("uint8") if pieces[i].max() < 256 else pieces[i]).tobytes() for i in used]
    k = len(used)
    none = [pa.nulls(k, t) for t in (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary())]
    yield pa.record_batch([*none, pa.array(used.astype("int32")), pa.array(raw, pa.binary())], names=_names(_SCAN))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _merged(pieces: DataFrame, kind: str, join: Callable, total: int) -> np.ndarray:
    """The tasks' partial tables of fixed size, joined piece by piece; the whole has a fixed size."""

    def merge(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in source:
            for p, raw in zip(b.column("piece").to_pylist(), b.column("counts").to_pylist()):
                x = np.frombuffer(raw, "uint32" if len(raw) == 4 * PIECE else "uint8").astype(kind)
                held[p] = join(held[p], x) if p in held else x
        if held:
            yield pa.record_batch([pa.array(held, pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["piece", "counts"])

    out: dict[int, np.ndarray] = {r.piece: np.frombuffer(r.counts, kind) for r in pieces.select("piece", "counts").repartition("piece").mapInArrow(merge, "piece int, counts binary").collect()}
    size = len(next(iter(out.values()))) if out else total
    whole = np.zeros(total, kind)
    for p, x in out.items():
        whole[p * size : (p + 1) * size] = x
    return whole


def _prefix(weights, hot, wanted: bool) -> Callable:
    """Rows (shingle, ref, n_pos) of the prefixes of all classes, of the hot shingles or of the others.

    n_pos packs the set size and the position in its order into 16 bits each; 0 stands for a larger set.
    """

    def prefix(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, frequent = weights.value, hot.value
        for _, _, _, text, sh, n in _batches(source):
            refs = _refs(sh, n)
            first = np.zeros(len(n), bool)
            first[np.unique(refs, return_index=True)[1]] = True
            counter = (sh >> np.uint64(64 - COUNT_BITS)).astype("int64")
            order = ordered(text, w[counter], sh)
            rank = np.arange(len(sh)) - np.repeat(np.cumsum(n) - n, n)
            keep = (rank < (n - -(-NUM * n // DEN) + 1)[text]) & first[text]
            if frequent is not None:
                keep &= (frequent[counter[order] >> 3] >> (counter[order] & 7) & 1 == 1) == wanted
            size, own = n[text][keep], order[keep]
            packed = np.where(size < 1 << 16, size << 16 | rank[keep], 0).astype("uint32").view("int32")
            columns = [sh[own].view("int64"), refs[text][keep].view("int64"), packed]
            yield pa.record_batch([pa.array(c) for c in columns], names=["shingle", "ref", "n_pos"])

    return prefix


def _runs(source: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Columns of a sorted stream, cut so that no run of ``key`` is torn."""
    held: list[dict] = []
    for b in source:
        if not b.num_rows:
            continue
        now = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
        k = now[key]
        if k[0] == k[-1]:
            if held and held[-1][key][-1] != k[0]:
                yield {c: np.concatenate([h[c] for h in held]) for c in now}
                held = []
            held.append(now)
            continue
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1
        held.append({c: v[:cut] for c, v in now.items()})
        yield {c: np.concatenate([h[c] for h in held]) for c in now}
        held = [{c: v[cut:] for c, v in now.items()}]
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}


def _useful(at: np.ndarray, size: np.ndarray, n_pos: np.ndarray) -> np.ndarray:
    """Rows of runs that may have a partner in their run.

    Two similar sets meet at the first shingle they share. What they share lies from there on, so each
    has at least NUM/(NUM+DEN) of the summed sizes left at that position. Runs over 64 rows stay whole.
    """
    n, pos = (n_pos >> 16).astype("int64"), (n_pos & 0xFFFF).astype("int64")
    out = np.repeat(size > 64, size)
    own = np.repeat(np.arange(len(at)), size)
    left = (DEN + NUM) * (n - pos)
    here = np.flatnonzero(~out)
    for d in range(1, 64):
        here = here[here + d < len(own)]
        here = here[own[here] == own[here + d]]
        if not len(here):
            break
        i, j = here, here + d
        ok = np.minimum(left[i], left[j]) >= NUM * (n[i] + n[j])
        ok &= DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j])
        ok |= (n[i] == 0) | (n[j] == 0)
        out[i[ok]] = out[j[ok]] = True
    return out


def _blocks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, ref, side) of shingles that several classes have in their prefix; side 0: all are compared.

    Shingles with the same list of classes give the same block.
    """
    for r in _runs(source, "shingle"):
        new = np.ones(len(r["ref"]), bool)
        new[1:] = (r["shingle"][1:] != r["shingle"][:-1]) | (r["ref"][1:] != r["ref"][:-1])
        s, ref = r["shingle"][new], r["ref"][new]
        at, size = _starts(s)
        use = _useful(at, size, r["n_pos"][new].view("uint32"))
        s, ref = s[use], ref[use]
        if not len(s):
            continue
        at, n = _starts(s)
        block = mix(np.add.reduceat(mix(ref.view("uint64")), at) + n.astype("uint64"))
        keep = np.zeros(len(at), bool)
        keep[np.unique(block, return_index=True)[1]] = True
        rows = np.repeat(keep & (n > 1), n)
        side = np.zeros(int(rows.sum()), "int8")
        columns = [np.repeat(block, n)[rows].view("int64"), ref[rows], side]
        yield pa.record_batch([pa.array(c) for c in columns], names=["block", "ref", "side"])


def _hot_blocks(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(block, ref, side) of hot shingles: pairs of tiles within the radius of each other. side 1 and 2: only
    classes of different sides are compared.

    ``rows`` holds (shingle, ref), ``classes`` (ref, n, bits). A tile has at most 2 * TILE classes, next to each
    other by bit count; equal bit counts of more classes are spread by hash.
    """
    known = rows.select("shingle", "ref").distinct().join(classes.select("ref", "n", "bits"), "ref")
    known = materialise(known, "hot")
    counts = known.groupBy("shingle", "bits").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("shingle").orderBy("bits").rowsBetween(Window.unboundedPreceding, -1)
    at = F.floor(F.coalesce(F.sum("k").over(before), F.lit(0)) / TILE)
    cut = counts.select("shingle", "bits", "k", at.alias("at"))
    many = F.col("k") > TILE
    part = F.when(many, F.pmod(F.hash("ref"), F.ceil(F.col("k") / TILE).cast("int"))).otherwise(-1)
    alone = F.when(many, F.col("bits")).otherwise(-1)
    tiled = known.join(cut, ["shingle", "bits"])
    tiled = materialise(tiled.select("shingle", "ref", "n", "bits", F.xxhash64("shingle", "at", alone, part).alias("tile")), "tiled")
    tiles = tiled.groupBy("shingle", "tile").agg(
        F.min("bits").alias("lo"), F.max("bits").alias("hi"), F.max("n").alias("n"), F.bit_xor(F.xxhash64("ref")).alias("content")
    )
    tiles = materialise(tiles, "tiles")
    a, b = tiles.alias("a"), tiles.alias("b")
    ordered_pair = F.struct("a.lo", "a.tile") <= F.struct("b.lo", "b.tile")
    pairs = a.join(b, F.col("a.shingle") == F.col("b.shingle")).where(ordered_pair & _in_reach())
    block = F.xxhash64("a.content", "b.content").alias("block")
    same = F.col("a.tile") == F.col("b.tile")
    left = pairs.select(F.col("a.tile").alias("tile"), block, F.when(same, 0).otherwise(1).cast("tinyint").alias("side"))
    right = pairs.where(~same).select(F.col("b.tile").alias("tile"), block, F.lit(2).cast("tinyint").alias("side"))
    # shingles of the same classes have the same tiles, whose blocks are one
    return tiled.select("tile", "ref").join(left.union(right), "tile").select("block", "ref", "side").distinct()


def _in_reach() -> Column:
    """Whether tiles a and b, a before b by bit count, may hold a pair: bit counts compare at one level only, and
    similar sets are at most one level apart."""
    level = lambda c: F.shiftright(c, LEVEL_AT)
    radius = F.floor((DEN - NUM) * (F.col("a.n") + F.col("b.n")) / (DEN + NUM))
    apart = level("b.lo") - level("a.hi")
    near = F.col("b.lo") - F.col("a.hi") <= radius
    return F.when(apart <= 0, near).otherwise(apart == 1)


def _starts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and length of each run of equal keys."""
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return at, np.diff(np.append(at, len(key)))


def _xor_counts(sketches: np.ndarray, n: np.ndarray) -> Callable:
    """Function (i, j) -> differing bits of rows' sketches, folded to the smaller of two neighbouring levels."""
    level = _level(n)
    own, at = {}, np.zeros(len(n), "int64")
    for k in np.unique(level):
        rows = np.flatnonzero(level == k)
        own[k] = np.frombuffer(b"".join(sketches[rows]), "uint64").reshape(len(rows), -1)
        at[rows] = np.arange(len(rows))
    folded = {k: x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :] for k, x in own.items() if k - 1 in own}

    def xor(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), "int64")
        least, first = np.minimum(level[i], level[j]), level[i] >= level[j]
        hi, lo = np.where(first, i, j), np.where(first, j, i)
        for k in np.unique(least):
            for up, table in ((0, own), (1, folded)):
                sel = np.flatnonzero((least == k) & (level[hi] == k + up))
                if not len(sel):
                    continue
                for part in np.array_split(sel, len(sel) * own[k].shape[1] // (1 << 20) + 1):
                    out[part] = np.bitwise_count(table[k + up][at[hi[part]]] ^ own[k][at[lo[part]]]).sum(axis=1, dtype="int64")
        return out

    return xor


def _compare(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes of a block whose sketches differ in no more bits than the radius allows, the smaller first."""
    for r in _runs(source, "block"):
        block, n, bits, side, ref = r["block"], r["n"].astype("int64"), r["bits"].astype("int64"), r["side"], r["ref"]
        level, xor = _level(n), _xor_counts(r["sketch"], n)
        at, size = _starts(block)

        def close(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            radius = (DEN - NUM) * (n[i] + n[j]) // (DEN + NUM)
            apart = level[i] - level[j]
            # bit counts can be compared at one level only
            ok = np.where(apart == 0, np.abs(bits[i] - bits[j]) <= radius, np.abs(apart) == 1) & ((side[i] == 0) | (side[i] != side[j]))
            ok &= ref[i] != ref[j]  # several tasks may find the same block
            i, j, radius = i[ok], j[ok], radius[ok]
            ok = xor(i, j) <= radius
            return i[ok], j[ok]

        found = []
        few = np.repeat(size <= 32, size)
        own = np.repeat(np.arange(len(at)), size)
        here = np.flatnonzero(few)
        for d in range(1, 32):
            here = here[here + d < len(own)]
            here = here[own[here] == own[here + d]]
            if not len(here):
                break
            found.append(close(here, here + d))
        for b in np.flatnonzero(size > 32):
            tiles = [np.arange(k, min(k + ROWS, at[b] + size[b])) for k in range(at[b], at[b] + size[b], ROWS)]
            for a, left in enumerate(tiles):
                for right in tiles[a:]:
                    if level[left[0]] == level[right[-1]] and bits[right[0]] - bits[left[-1]] > (DEN - NUM) * (n[left].max() + n[right].max()) // (DEN + NUM):
                        continue  # bit counts rise from tile to tile, sizes need not: later tiles may be in reach again
                    i, j = np.repeat(left, len(right)), np.tile(right, len(left))
                    found.append(close(i[i < j], j[i < j]))
        if found:
            i, j = (np.concatenate(z) for z in zip(*found))
            # the smaller set first, since it is the one that later moves to the other
            turn = (n[i] > n[j]) | ((n[i] == n[j]) & (ref[i] > ref[j]))
            a, b = np.where(turn, ref[j], ref[i]), np.where(turn, ref[i], ref[j])
            new = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), "int64")
            yield pa.record_batch([pa.array(new[:, 0].copy()), pa.array(new[:, 1].copy())], names=["a", "b"])


def _filter_bits(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << FILTER_BITS, bool)
    for b in source:
        for c in ("a", "b"):
            bits[(b.column(c).to_numpy().view("uint64") >> np.uint64(64 - FILTER_BITS)).astype("int64")] = True
    packed = np.packbits(bits).reshape(-1, PIECE)
    used = np.flatnonzero(packed.any(axis=1))
    yield pa.record_batch([pa.array(used.astype("int32")), pa.array([packed[i].tobytes() for i in used], pa.binary())], names=["piece", "counts"])


def _packed(sh: np.ndarray, kept: int) -> np.ndarray:
    """The leading bytes of each hash, most significant first, in the order of the hashes."""
    return sh.astype(">u8").view("uint8").reshape(-1, 8)[:, :kept]


def _unpacked(raw: bytes, kept: int) -> np.ndarray:
    """Distinct sorted hashes of packed ones."""
    wide = np.zeros((len(raw) // kept, 8), "uint8")
    wide[:, :kept] = np.frombuffer(raw, "uint8").reshape(-1, kept)
    out = wide.view(">u8").ravel().astype("uint64")
    return out[np.concatenate(([True], out[1:] != out[:-1]))[: len(out)]]


def _sets(wanted, kept: int) -> Callable:
    """(ref, n, sh): packed shingles of the classes that a filter holds."""

    def sets(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(wanted.value).view(bool)
        for _, _, _, _, sh, n in _batches(source):
            refs = _refs(sh, n)
            some = bits[(refs >> np.uint64(64 - FILTER_BITS)).astype("int64")] & (n > 0)
            first = np.zeros(len(n), bool)
            first[np.unique(refs, return_index=True)[1]] = True
            at, raw = np.cumsum(n) - n, _packed(sh, kept)
            take = np.flatnonzero(some & first)
            packed = pa.array([raw[at[i] : at[i] + n[i]].tobytes() for i in take], pa.binary())
            yield pa.record_batch([pa.array(refs[take].view("int64")), packed], names=["ref", "sh"])

    return sets


def _shared(kept: int) -> Callable:
    """(a, b, n_a, n_b, shared) of pairs with their packed sets."""

    def shared(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            left, right = (batch.column(c).to_pylist() for c in ("sa", "sb"))
            both = [len(np.intersect1d(_unpacked(p, kept), _unpacked(q, kept), assume_unique=True)) for p, q in zip(left, right)]
            sizes = [pa.array([len(x) // kept for x in side], pa.int32()) for side in (left, right)]
            yield pa.record_batch([batch.column("a"), batch.column("b"), *sizes, pa.array(both, pa.int32())], names=["a", "b", "n_a", "n_b", "shared"])

    return shared


def _verified(texts: DataFrame, candidates: DataFrame, kept: int) -> DataFrame:
    """(a, b, n_a, n_b, shared) of candidate pairs, counted on ``kept`` bytes of each hash."""
    wanted = _merged(candidates.mapInArrow(_filter_bits, "piece int, counts binary"), "uint8", np.bitwise_or, 1 << FILTER_BITS >> 3)
    sets = texts.mapInArrow(_sets(texts.sparkSession.sparkContext.broadcast(wanted), kept), "ref bigint, sh binary")
    sets = sets.dropDuplicates(["ref"])
    left = candidates.join(sets.select(F.col("ref").alias("a"), F.col("sh").alias("sa")), "a")
    both = left.join(sets.select(F.col("ref").alias("b"), F.col("sh").alias("sb")), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(_shared(kept), "a bigint, b bigint, n_a int, n_b int, shared int")


def class_pairs(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (id, project, ref, n), one row per chunk id, and pairs (a, b, similarity)
    of classes of one project whose shingle sets have a similarity of at least 3/5, a being the smaller set.

    ``chunks`` needs id, text and project; other columns are ignored. Repeated rows of an id count
    once. Texts that are null, empty or under three words have n = 0 and are in no pair, nor are rows
    without a project. An empty table gives empty results. Two different sets share a ref with a
    chance of 2^-64 per pair.
    """
    spark = chunks.sparkSession
    texts = chunks.where(F.col("id").isNotNull()).select("id", "text", "project")
    paired = texts.where(F.col("project").isNotNull())
    scanned = materialise(texts.mapInArrow(_scan, _SCAN), "scan")
    members = scanned.where(F.col("piece").isNull()).select("id", "project", "ref", "n").dropDuplicates(["id"])
    counts = _merged(scanned.where(F.col("piece").isNotNull()), "uint32", np.add, 1 << COUNT_BITS)
    weights = spark.sparkContext.broadcast(np.minimum(np.log2(counts + 1.0) * 8, 255).astype("uint8"))
    frequent = counts >= TILE
    hot = spark.sparkContext.broadcast(np.packbits(frequent, bitorder="little") if frequent.any() else None)
    found = "shingle bigint, ref bigint, n_pos int"
    rare = paired.mapInArrow(_prefix(weights, hot, False), found).repartition("shingle")
    blocks = rare.sortWithinPartitions("shingle", "ref").mapInArrow(_blocks, "block bigint, ref bigint, side tinyint")
    classes = scanned.where((F.col("n") > 0) & F.col("project").isNotNull())
    classes = classes.select("ref", "n", "sketch", "bits").dropDuplicates(["ref"])
    if frequent.any():
        blocks = blocks.union(_hot_blocks(paired.mapInArrow(_prefix(weights, hot, True), found), classes))
    candidates = blocks.join(classes, "ref").repartition("block").sortWithinPartitions("block", "bits").mapInArrow(_compare, "a bigint, b bigint").distinct()
    candidates = materialise(candidates, "pairs")
    counted = materialise(_verified(paired, candidates, KEPT), "counted")
    # shared >= NUM/DEN of all different ones: (NUM + DEN) * shared >= NUM * (n_a + n_b)
    over = (NUM + DEN) * F.col("shared") - NUM * (F.col("n_a") + F.col("n_b"))
    close = F.abs(over) < (NUM + DEN) * SLACK
    pairs = counted.where((over >= 0) & ~close)
    if not counted.where(close).isEmpty():
        again = materialise(counted.where(close).select("a", "b"), "close")
        pairs = pairs.union(_verified(paired, again, 8).where(over >= 0))
    pairs = pairs.select("a", "b", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("similarity"))
    return members, pairs


def similar_pairs(chunks: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of ids of one project with a similarity of at least 3/5.

    Ids of equal shingle sets are pairs as well.
    """
    members, pairs = class_pairs(chunks)
    ids = members.where((F.col("n") > 0) & F.col("project").isNotNull()).select("ref", "id")
    across = pairs.join(ids.select(F.col("ref").alias("a"), F.col("id").alias("p")), "a").join(ids.select(F.col("ref").alias("b"), F.col("id").alias("q")), "b")
    within = ids.select("ref", F.col("id").alias("p")).join(ids.select("ref", F.col("id").alias("q")), "ref").where(F.col("p") < F.col("q"))
    return across.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")).union(within.select("p", "q"))


def groups(chunks: DataFrame) -> DataFrame:
    """(id, project, group_id, links): one row per chunk id.

    group_id is the least id of all chunks linked by pairs; links counts the classes that the chunk's
    own class is paired with. A chunk without partner has its class alone.
    """
    members, pairs = class_pairs(chunks)
    pairs = materialise(pairs, "links")
    linked = connected_components(pairs, "a", "b")
    count = pairs.select(F.explode(F.array("a", "b")).alias("ref")).groupBy("ref").agg(F.count(F.lit(1)).alias("links"))
    known = members.join(linked.withColumnRenamed("node", "ref"), "ref", "left").join(count, "ref", "left")
    # texts without shingles and rows without project stand alone
    alone = (F.col("n") == 0) | F.col("project").isNull()
    keyed = known.withColumn("c", F.when(alone, F.concat(F.lit("i"), "id")).otherwise(F.coalesce("component", "ref").cast("string")))
    least = keyed.groupBy("c").agg(F.min("id").alias("group_id"))
    return keyed.join(least, "c").select("id", "project", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
