import os

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import pii

DOC = "doc_id bigint, text string, kind string, spans string, features string, p string"


@pytest.fixture(scope="module")
def data():
    """The smallest tables hold too few documents to learn from."""
    return os.environ.get("LOREKEEP_DATA", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def given(spark, data):
    return spark.read.parquet(f"{data}/given_names.parquet")


@pytest.fixture(scope="module")
def corpus(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")


def words(given=("robert", "maria"), common=("the", "please", "ask", "contact", "frau", "items")):
    return pii.Words(pii.hashes(common), pii.hashes(given))


def proposed(text, w=None):
    _, kind, start, end, *_ = pii._read([text], w or words())
    return {(pii.KINDS[k], text[a:b]) for k, a, b in zip(kind, start, end)}


@pytest.mark.parametrize(
    ("text", "span"),
    [
        # names without any known given name: small letters, initials, particles, three and four words
        ("please ask anika brandauer about it", "anika brandauer"), ("so ask m. weber about it", "m. weber"),
        ("weber, maria signed", "weber, maria"), ("then José Núñez Ortega left", "José Núñez Ortega"),
        ("and Nguyen Van An came", "Nguyen Van An"), ("by Ludwig van Beethoven.", "Ludwig van Beethoven"),
        ("Frau von Hagen", "von Hagen"), ("with Anna Maria Weber now", "Anna Maria Weber"), ("J. R. Ewing", "J. R. Ewing"),
        ("Contact: O'BRIEN Keiko", "O'BRIEN Keiko"), ("See Weber, G. H. there", "Weber, G. H."), ("Best,\nAnika", "Anika"),
    ],
)
def test_names_are_proposed_without_a_list(text, span):
    assert ("name", span) in proposed(text)


def test_other_kinds_are_proposed():
    text = "at 12 Kestrel Mews, a.b@mail.example or c-d [at] mail [dot] example; +44 20 7946 0946, SSN 905 17 9668. Remote git@forge:x"
    got = proposed(text)
    for pair in (
        ("address", "12 Kestrel Mews"), ("email", "a.b@mail.example"), ("email", "c-d [at] mail [dot] example"),
        ("phone", "+44 20 7946 0946"), ("id_number", "905 17 9668"), ("email", "git@forge"),
    ):
        assert pair in got
    assert proposed("") == set() and proposed("\n\n") == set()


def test_positions_count_characters_in_batches():
    texts = ["🪴 ab Robert Yalalaya", "", "é\u0301 Robert Yalalaya\r\n", "x" * 100_000 + " Robert Yalalaya"]
    text, kind, start, end, *_ = pii._read(texts, words())
    got = {(int(t), texts[t][a:b]) for t, a, b in zip(text, start, end) if b - a > 8}
    assert got == {(t, "Robert Yalalaya") for t in (0, 2, 3)}


def test_given_names_are_learned_from_the_corpus(spark, corpus, given):
    some = given.where("given_name not in ('Robert', 'Ingrid', 'Farid', 'Olivia')")
    w = pii.learn_words(corpus, some)
    got = [pii._in(pii.hashes([x]), w.given)[0] for x in ("farid", "olivia")]  # ingrid is a code name here as well
    assert all(got) and not pii._in(pii.hashes(["contact", "the", "frau", "monsieur"]), w.given).any()


def test_held_out_accuracy(spark, corpus, given):
    """On documents that the trees were not fitted on, accepted spans of every kind agree with the sure labels."""
    scored, limits = pii.scored_spans(corpus, given, sample=600)
    n = scored.where("not fitted and label is not null").groupBy("kind", "label", F.round("p", 2).alias("p")).count().collect()
    for kind, limit in limits.items():
        hit = sum(r["count"] for r in n if r.kind == kind and r.label == 1 and r.p >= limit)
        wrong = sum(r["count"] for r in n if r.kind == kind and r.label == 0 and r.p >= limit)
        missed = sum(r["count"] for r in n if r.kind == kind and r.label == 1 and r.p < limit)
        assert hit > 20 and hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.95


def test_names_are_found_by_their_surroundings(spark, corpus, given):
    """Names whose words no list holds, in sentences of the corpus: in some documents all given names are others."""
    tails = "|".join(r.given_name[1:] for r in given.collect())
    text = F.when(F.col("doc_id") % 9 == 0, F.regexp_replace("text", rf"\b[A-Z]({tails})\b", "Quo$1")).otherwise(F.col("text"))
    changed = corpus.select("doc_id", text.alias("text"))
    pattern = rf"Quo(?:{tails}) (?:[A-Z][.] )?[A-Z][a-z]{{5,}}"
    spans = pii.found(changed, given).where("kind = 'name'").join(changed, "doc_id")
    found = spans.where(F.expr("substring(text, start_pos + 1, 40)").rlike("^" + pattern)).count()
    expected = changed.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))).first()[0]
    assert expected > 20 and found >= 0.8 * expected


def test_redaction(spark, corpus, given):
    texts = [
        (900001, "Contact: Robert Yalalaya <robert.yalalaya@mail.example>, +44 20 7946 0946\n\nThe Jasper cluster runs build 2026.1.381. Pinned memkit@6.9.4 in the lock file."),
        (900002, "user: call me back on (202) 555-0104 please, I live at 294 Kestrel Rd. Short Street is only a code name.\nFrau Safropatel hat SSN 905 17 9668 gemeldet."),
        (900003, None),
        (900004, ""),
        (900005, "🪴 no person here, scores were 805 94 6784 across three shards. " * 300),
    ]
    extra = spark.createDataFrame([(*t, "a", "b", "c", "d") for t in texts], DOC)
    docs = corpus.select("doc_id", "text", *[F.lit("x").alias(c) for c in ("kind", "spans", "features", "p")]).unionByName(extra)
    got = {r.doc_id: (r.text, r.n) for r in pii.redact(docs, given).where("doc_id > 900000").collect()}
    assert got[900001][0] == "Contact: [NAME] <[EMAIL]>, [PHONE]\n\nThe Jasper cluster runs build 2026.1.381. Pinned memkit@6.9.4 in the lock file."
    assert got[900002][0] == "user: call me back on [PHONE] please, I live at [ADDRESS]. Short Street is only a code name.\nFrau [NAME] hat SSN [ID_NUMBER] gemeldet."
    assert got[900003] == (None, 0) and got[900004] == ("", 0) and got[900005] == (texts[4][1], 0)


def test_overlaps():
    spans = [dict(kind=k, start_pos=a, end_pos=b, p=p) for k, a, b, p in (("name", 0, 5, 0.7), ("name", 3, 9, 0.9), ("email", 9, 20, 0.8), ("phone", 10, 12, 0.8))]
    assert pii._resolve(spans) == [("name", 3, 9), ("email", 9, 20)]


def test_empty(spark, given):
    none = spark.createDataFrame([], DOC)
    assert pii.found(none, given).count() == 0 and pii.redact(none, given).count() == 0
