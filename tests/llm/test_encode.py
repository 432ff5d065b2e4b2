import random

import pytest

from lorekeep.llm import encode, packing

DOC = "doc_id bigint, text string, k string, ids string, tokens string, shard string"
TRICKY = ["a\n\n\n b", "x   y    z", "don't we'll I'M", "\r\n\t ", "ééé ё 漢字かな", "👩‍💻👍🏽 ok", "1234 5678abc", "!!! ??? ...", "  lead", "trail  ", "_" * 50, " ", "​ "]


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOC)


@pytest.mark.parametrize("leaf", [7, 33, 8192])
def test_equals_whole_encoding(spark, leaf):
    rnd = random.Random(leaf)
    texts = ["".join(rnd.choice(TRICKY) + rnd.choice(["", " ", "\n", " word"]) for _ in range(rnd.randrange(1, 60))) for _ in range(60)] + ["x" * 500, " " * 300, "ab " * 900]
    texts += ["漢字かな" * 200, "aGk5Kx+9/" * 200, '{"a":1,"b":[2,3]}' * 120, "it's'll" * 150, "x1'2'd3" * 150]
    got = {r.doc_id: r.ids for r in encode.encode_texts(table(spark, list(enumerate(texts))), leaf=leaf).collect()}
    enc = encode.encoding()
    assert all(got[i] == enc.encode_ordinary(t) for i, t in enumerate(texts))
    assert all(enc.decode(got[i]) == t for i, t in enumerate(texts))


def test_long_text_without_blanks(spark):
    """Rounds of joins, cut and joined in linear time: 4 million signs of raw payload."""
    rnd = random.Random(9)
    text = "".join(f'{{"k{rnd.randrange(99)}":"{rnd.random()}"}},' for _ in range(140_000))
    got = encode.encode_texts(table(spark, [(1, text), (2, "a b")])).collect()
    assert {r.doc_id: list(r.ids) for r in got}[1] == encode.encoding().encode_ordinary(text)


def test_matches_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encode.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in [*TRICKY, "<|endoftext|> is plain"]:
        assert t.encode(text, add_special_tokens=False).ids == encode.encode_batch([text])[0]


def test_edges(spark):
    got = {r.doc_id: r.ids for r in encode.encode_texts(table(spark, [(1, None), (2, ""), (3, "hi"), (4, "hi")])).collect()}
    assert got[1] is None and got[2] == [] and got[3] == got[4] != []
    assert encode.encode_texts(table(spark, [])).count() == 0


def test_packing(spark):
    rnd = random.Random(4)
    sizes = [(i, rnd.choice([0, None, 1, 50, 300, 999, 1000, 1001, 2000, 5321])) for i in range(400)]
    df = spark.createDataFrame([(i, n, "x", 1, 2) for i, n in sizes], "doc_id bigint, tokens int, container string, piece int, shard int")
    got = packing.pack(df, 1000).collect()
    load, spans = {}, {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.token_to - r.token_from
        spans.setdefault(r.doc_id, []).append((r.token_from, r.token_to))
    assert max(load.values()) <= 1000 and all(load[r.container] == r.container_tokens for r in got)
    for i, n in sizes:
        own = sorted(spans[i])
        assert own[0][0] == 0 and own[-1][1] == (n or 0) and all(a[1] == b[0] for a, b in zip(own, own[1:]))
        assert len(own) == max(1, -(-(n or 0) // 1000))
    total = sum(n or 0 for _, n in sizes)
    assert sum(load.values()) == total and total / 1000 / sum(v > 0 for v in load.values()) > 0.9
    assert packing.pack(df.where("doc_id < 0")).count() == 0


def test_packing_documents(spark):
    got = packing.pack_documents(table(spark, [(1, None), (2, ""), (3, "hello world")]), 10).collect()
    assert sorted((r.doc_id, r.token_to) for r in got) == [(1, 0), (2, 0), (3, 2)]


def test_differencing_is_near_equal():
    import numpy as np

    sizes = np.sort(np.random.default_rng(1).integers(1, 500, 400))[::-1]
    part, sums = packing.difference(sizes, 10)
    assert (np.bincount(part, weights=sizes, minlength=10) == sums).all() and sums.max() - sums.min() < 20
