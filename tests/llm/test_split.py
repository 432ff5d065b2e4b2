import pytest

from lorekeep.llm import split

CHUNK = "id string, text string, source string, similarity double, chunk_idx int, doc_id string, project string, n int, k int, spans string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", 0.5 + n / 100, x, d, "p", 1, 2, "q") for n, (i, t, x, d) in enumerate(rows)], CHUNK)


TEXTS = [
    "# A\n\n" + "Short sentence here. " * 60 + "\n\n## B\n\n" + "- item one two three\n" * 90 + "\n# C\n" + "word " * 500,
    "x" * 9000,
    "{" + ",".join(f'"k{i}":{i}' for i in range(900)) + "}",
    "é" * 1599 + "é" * 4000,
    "  \n" + "line\r\n" * 700 + "\t ",
    "```\n" + "code line\n" * 300 + "```\n\nafter",
    "这是一个句子。" * 400,
]


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_pieces(k):
    text = TEXTS[k]
    pieces = split.pieces_of(text)
    assert "".join(text[c:e] for _, c, e in pieces) == text.strip(split.BLANK)
    assert len(pieces) > 1 and all(e - s <= 1600 for s, _, e in pieces)
    for (s0, c0, e0), (s, c, e) in zip(pieces, pieces[1:]):
        assert c == e0 and c - s == min(160, c - pieces[0][1])


def test_natural_boundaries_first():
    text = TEXTS[0]
    for _, core, _ in split.pieces_of(text)[1:]:
        assert text[core - 1].isspace()
    sections = "# one\n" + "a " * 500 + "\n# two\n" + "b " * 500 + "\n# three\n" + "c " * 300
    assert [sections[c : c + 5] for _, c, _ in split.pieces_of(sections)] == ["# one", "# two", "# thr"]


def test_structure_stays_whole():
    fence = "```py\n" + "".join(f"# comment {i}\nx = {i}\n\n- y\n" for i in range(35)) + "```\n"
    text = "Intro " * 140 + "\n\n" + fence + "\n" + "Outro words. " * 90
    at = text.index("```")
    assert any(c <= at and at + len(fence) <= e for _, c, e in split.pieces_of(text))
    tree = split.boundaries(text, 0, len(text))
    assert not any(tree[d] for d in range(6)) and tree[split.BLOCK] == [at, at + len(fence), at + len(fence) + 1]
    # items are kept with their nested ones, closed elements of markup with what they hold
    items = "".join(f"- item {i} " + "w " * 80 + f"\n    - sub {i} " + "v " * 90 + "\n" for i in range(8))
    assert all(items[c : c + 6] == "- item" for _, c, _ in split.pieces_of(items))
    markup = "<div>" + "".join("<section><p>" + "q " * 250 + "</p><p>" + "r " * 150 + "</p></section>" for _ in range(6)) + "</div>"
    assert all(markup[c : c + 9] in ("<section>", "<div><sec") for _, c, _ in split.pieces_of(markup))
    wrong = "```\n~~~\n# no heading\n``` not closed\n# none\n```\n# one\n"
    assert split.boundaries(wrong, 0, len(wrong))[0] == [wrong.index("# one")]


def test_limit_is_exact():
    assert len(split.pieces_of(" " + "y" * 1600 + "\n")) == 1 and len(split.pieces_of("y" * 1601)) == 2
    assert split.pieces_of("") == [(0, 0, 0)]
    with pytest.raises(ValueError):
        split.spans(None, 100, 60)


def test_table(spark):
    rows = [("a", "short", 0, "d1"), ("b", TEXTS[1], 1, "d1"), ("b", TEXTS[1], 1, "d1"), ("c", None, 2, "d1"), ("e", "", 3, "d1"), ("f", "tie", 3, "d1"), (None, "no id", 0, None), ("g", TEXTS[4], None, "d2"), ("h", "x", 700, "d2")]
    got = split.split_chunks(table(spark, rows)).collect()
    d1 = sorted((r.chunk_idx, r.from_id, r.text) for r in got if r.doc_id == "d1")
    assert [x[0] for x in d1] == list(range(len(d1))) and d1[0][2] == "short" and d1[-3][1:] == ("c", None) and [x[1] for x in d1[-2:]] == ["e", "f"]
    assert sorted(r.chunk_idx for r in got if r.doc_id == "d2") == list(range(sum(r.doc_id == "d2" for r in got)))
    assert any(r.text == "no id" and r.chunk_idx == 0 for r in got)
    assert sorted(r.id for r in split.oversized(table(spark, rows)).collect()) == ["b", "g"]
    assert split.split_chunks(table(spark, [])).count() == 0 and split.oversized(table(spark, [])).count() == 0
