import random
import re

import numpy as np
import pytest

from lorekeep.llm import near_dup, shingles

CHUNK = "id string, text string, project string, ref string, n string, block string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], CHUNK)


def sets(text):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(rows):
    known = {i: (p, sets(t)) for i, t, p in rows if p is not None}
    out = set()
    for a, (p, x) in known.items():
        for b, (q, y) in known.items():
            if a < b and p == q and x and y and 5 * len(x & y) >= 3 * len(x | y):
                out.add((a, b))
    return out


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if i % 3 and rows:
            t = (rnd.choice(rows)[1] or "").split()
            for _ in range(rnd.randrange(6)):
                if t:
                    t[rnd.randrange(len(t))] = rnd.choice(words)
            if rnd.random() < 0.2:
                t = t[len(t) // 2 :] + t[: len(t) // 2]
        else:
            t = [rnd.choice(words) for _ in range(rnd.choice([3, 8, 40, 200, 900]))]
        rows.append((f"c{i:04d}", " ".join(t), rnd.choice(["p", "q"])))
    return rows


def test_shingles_match_plain_sets():
    texts = ["The quick, brown FOX jumps", "", None, "ab", "Müller straße 9 lives", "a b c a b c a b c", "ÅNGström K2 İx y z"]
    keys = shingles.project_keys([None] * len(texts))
    text, sh = shingles.shingles(texts, keys)
    assert np.bincount(text, minlength=len(texts)).tolist() == [len(sets(t)) for t in texts]
    assert (np.lexsort((sh, text)) == np.arange(len(sh))).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = corpus(seed)
    got = [tuple(r) for r in near_dup.similar_pairs(table(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_blocks_cut_into_tiles_lose_nothing(spark, monkeypatch):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rnd.randrange(5)):
            t[rnd.randrange(60)] = f"x{rnd.randrange(500)}"
        rows.append((f"c{i:03d}", " ".join(t), "p"))
    monkeypatch.setattr(near_dup, "TILE", 40)
    monkeypatch.setattr(near_dup, "ROWS", 16)
    assert {tuple(r) for r in near_dup.similar_pairs(table(spark, rows)).collect()} == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{i % 700}x{i // 700}" for i in range(20000))
    rows = [("a", None, "p"), ("b", "", "p"), ("c", "one two", "p"), ("d", "one two three", None), ("e", "one two three", None), ("f", long, "p"), ("g", long + " tail", "p"), ("h", "same text here", "p"), ("i", "same text here", "p"), ("i", "same text here", "p"), ("j", "same text here", "q"), (None, "same text here", "p")]
    assert {tuple(r) for r in near_dup.similar_pairs(table(spark, rows)).collect()} == {("f", "g"), ("h", "i")}
    g = {r.id: (r.group_id, r.links) for r in near_dup.groups(table(spark, rows)).collect()}
    assert g["i"] == ("h", 0) and g["g"] == ("f", 1) and g["a"] == ("a", 0) and g["d"] != g["e"] and len(g) == 10
    assert near_dup.similar_pairs(table(spark, [])).count() == 0 and near_dup.groups(table(spark, [])).count() == 0


def test_hot_shingle_is_cut_along_bit_counts(spark, monkeypatch):
    """One shingle in every text: its tiles stay small, and tiles beyond the radius never meet."""
    rnd = random.Random(7)
    rows = []
    for i in range(300):
        size = rnd.choice([4, 30, 90])
        rows.append((f"h{i:03d}", "all of them " + " ".join(f"y{rnd.randrange(6 * size)}" for _ in range(size)), "p"))
    rows += [(f"k{i:03d}", t + " end", p) for i, (_, t, p) in enumerate(rows[:150])]
    monkeypatch.setattr(near_dup, "TILE", 20)
    df = table(spark, rows)
    assert {tuple(r) for r in near_dup.similar_pairs(df).collect()} == brute(rows)
    schema = "shingle bigint, ref bigint, n int, bits int"
    known = spark.createDataFrame([(1, i, 40, (1 << near_dup.LEVEL_AT) + i // 3) for i in range(900)], schema)
    blocks = near_dup._hot_blocks(known, known.drop("shingle"))
    size = blocks.groupBy("block").count().agg({"count": "max"}).first()[0]
    pairs = blocks.select("block").distinct().count()
    # 45 tiles of 20; the radius of 20 bits spans three of them on either side
    assert size <= 4 * near_dup.TILE and pairs < 45 * 5


def test_pairs_at_the_limit_are_decided_on_whole_hashes(spark, monkeypatch):
    """With one byte of each hash almost every shingle agrees with another one; the second look decides."""
    base = [f"w{i}" for i in range(82)]  # 80 shingles
    rows = [("a", " ".join(base), "p")]
    for k in range(12, 26):
        rows.append((f"b{k}", " ".join(base[:-k] + [f"x{k}y{j}" for j in range(k)]), "p"))
    monkeypatch.setattr(near_dup, "SLACK", 80)
    monkeypatch.setattr(near_dup, "KEPT", 1)
    assert {tuple(r) for r in near_dup.similar_pairs(table(spark, rows)).collect()} == brute(rows)
