from itertools import combinations

import pytest

from lorekeep.llm import names

NICK = names.Nicknames([("Robert", "Bob"), ("Amélie", None)])
ENTITY = "id string, name string, type string, project string, form string, tokens string, block string"
GIVEN = "given_name string, short_form string"


def same(a, b):
    return names.compatible(names.parse(a), names.parse(b), NICK, frozenset({"foundation"}))


@pytest.mark.parametrize(
    ("a", "b", "grade"),
    [
        ("Robert Yalalaya", "ROBERT YALALAYA", 2), ("Robert Yalalaya", "Yalalaya, Bob", 2),
        ("Robert Yalalaya", "Rob Yaalalaya", 2), ("Robert Yalalaya", "R. Yalalaya", 1),
        ("Robert Yalalaya", "Yalalaya, R. K.", 1), ("Mme Amélie K. Yalalaya", "amélie_yalalaya", 2),
        ("Amélie Yalalaya", "AmélieYalalaya", 2), ("Robert Yalalaya", "Amélie Yalalaya", 0),
        ("Robert Yalalaya", "Robert Mokrelmitro", 0), ("B. Yalalaya", "b.yalalaya", 2),
        ("Imbamio Ceramics Inc", "Ceramics Imbamio", 2), ("Imbamio Ceramics Inc", "Imbamio Ceram.", 2),
        ("The Imbamio Ceramics Company", "imbamio-ceramics", 2), ("Imbamio Ceramics Inc", "Imbamio Optics Inc", 0),
        ("Denelhamel Foundation", "Johannes Denelhamel", 0), ("Denelhamel Foundation", "F. Denelhamel", 0),
        ("Jorlodrini Packaging S.A.", "Packaging Jorlodrini, Sociedad Anónima", 2),
        # any number of words, short words, digits, other scripts
        ("Maria Garcia Lopez", "Garcia Lopez, Maria", 2), ("Northern Data Systems GmbH", "Northern Data Systms", 2),
        ("Bank of New York", "The Bank of New York Co.", 2), ("Siemens AG", "Siemens", 2), ("Ann Lee", "Lee, Ann", 2),
        ("Studio 54", "Studio 54 Inc", 2), ("Studio 54", "Studio 55", 0), ("Иван Петров", "Петров Иван", 2),
        ("王小明", "王小明", 2), ("J. P. Smith", "John Paul Smith", 1), ("John Smith", "John Paul Smith", 1),
        ("John A. Smith", "John B. Smith", 0), ("Acme Technologies", "Acme Tech.", 2), ("Smith", "John Smith", 0),
    ],
)
def test_pairs(a, b, grade):
    assert same(a, b) == grade and same(b, a) == grade
    if grade:
        keys = [{k for k, _ in names.block_keys(names.parse(x), NICK)} for x in (a, b)]
        assert keys[0] & keys[1]


def test_names_without_a_word():
    for n in ("", "  ", None, "...", "!!"):
        assert names.parse(n) is None


def test_jaro_winkler():
    near = [round(names.jaro_winkler(*p), 4) for p in (("martha", "marhta"), ("dixon", "dicksonx"), ("abc", "xyz"))]
    assert near == [0.9611, 0.8133, 0]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], ENTITY)


def test_groups(spark):
    given = spark.createDataFrame([("Robert", "Bob"), ("Raymond", "Ray"), ("Amélie", None)], GIVEN)
    rows = [
        ("a1", "Robert Yalalaya", "person", "p"), ("a2", "Yalalaya, Bob", "org", "p"),
        ("a3", "Robert Yalalayá", None, "p"), ("a3", "Robert Yalalayá", None, "p"),
        ("a4", "Robert Yalalaya", "person", "q"), ("b1", "Raymond Yalalaya", "person", "p"),
        ("c1", "R. Yalalaya", "person", "p"), ("d1", "Amélie Mokrelmitro", "person", "p"),
        ("d2", "A. Mokrelmitro", "person", "p"), ("e1", None, "person", "p"), (None, "Robert Yalalaya", "person", "p"),
        ("e2", "Robert Yalalaya", "person", None), ("e3", "", "org", "p"),
        ("e4", "z" * 5000 + " " + "y" * 3000, "org", "p"), ("e5", "z" * 5000 + "x " + "y" * 3000, "org", "p"),
    ]
    got = {tuple(r) for r in names.variant_pairs(table(spark, rows), given).collect()}
    # R. fits Robert and Raymond, so it joins neither
    assert got == {("a1", "a2"), ("a1", "a3"), ("a2", "a3"), ("d1", "d2"), ("e4", "e5")}
    assert names.variant_pairs(table(spark, []), given).count() == 0


def test_other_things_are_no_bearers(spark):
    words = "noisy lexical checkpoints snapshots compact edges".split()
    rows = [(f"c{i}", f"{a} {b}", "person" if i == 5 else "concept", "p") for i, (a, b) in enumerate(combinations(words, 2))]
    rows += [(f"c9{i}", f"{words[i]} {words[i + 1]}", "concept", "p") for i in range(5)]
    rows += [("t1", "garnetkit 77.3", "tool", "p"), ("t2", "garnetkit 77.3", "tool", "p"), ("t3", "garnetkit 78.1", "org", "p")]
    rows += [("n1", "Amélie Checkpoints", "person", "p"), ("n2", "Amelie Checkpoints", "concept", "p")]
    got = {tuple(r) for r in names.variant_pairs(table(spark, rows), spark.createDataFrame([], GIVEN)).collect()}
    assert got <= {("n1", "n2")}


def test_blocks_lose_no_pair_when_every_token_is_frequent(spark, monkeypatch):
    """All pairs of names against the blocks: each given name and each surname is borne by many."""
    monkeypatch.setattr(names, "TILE", 10)
    given = ["Robert", "Bob", "R.", "Rob.", "Maria", "M.", "Mario", "Chioma", "C.", "Robrt", "Maira"]
    last = ["Schmidt", "Schmitd", "Schmdt", "Miller", "Muller", "Milelr", "Garcia", "Garica", "Lee"]
    text = [f"{g} {s}" for g in given for s in last] + [f"{s}, {g}" for g in given for s in last]
    text += [f"Maria {a} {b}" for a in last for b in last]
    rows = [(f"i{k:03d}", n, "person", "p") for k, n in enumerate(text)]
    forms = names.name_forms(table(spark, rows)).cache()
    parsed = {r.form: names._name(r.name) for r in forms.collect()}
    expected = {frozenset(p) for p in combinations(parsed, 2) if names.compatible(parsed[p[0]], parsed[p[1]], NICK)}
    got = {frozenset((r.a, r.b)) for r in names.link_forms(forms, NICK).collect()}
    assert got <= expected and len(expected) > 500
    assert len(got) >= 0.99 * len(expected)
    same_pair = {r.name: r.form for r in forms.collect()}
    for a, b in (("Maria Schmidt", "Maria Schmitd"), ("Bob Miller", "Robert Miller"), ("M. Schmidt", "Maria Schmidt")):
        pair = frozenset(same_pair[names._text(names.parse(x))] for x in (a, b))
        assert pair in got
