"""Personal information in free text: candidate spans, boosted trees, typed placeholders.

1. One pass over all documents counts words, and which capitalised words stand before rare ones: words of at
   least COMMON of the documents are common, frequent first words of names join the given names.
2. Generous generators propose overlapping spans of five kinds, with features of their format and hashes of the
   words around them. Names need no list: any capitalised, initialled or rare small words in a row are proposed.
3. Rules that look at a span's format (and, for identity numbers, at the public names of such numbers) label part
   of the spans. From the labels of all documents each surrounding word gets its odds, kind by kind, so what
   announces or follows a span is learned, not listed.
4. Gradient-boosted trees learn from the labelled spans of a bounded sample of documents. Each name is shown a
   second time as if no word of it were a known given name, so that format and surroundings must do.
5. The trees score every span; the threshold of each kind is set on the labelled spans of all documents that the
   trees were not fitted on. Of overlapping accepted spans the likeliest wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.names import SHORT, TITLES
from lorekeep.llm.pages import BLANK, DIGIT, LINE, Page, hashes
from lorekeep.llm.shingles import mix
from lorekeep.sources.tables import materialise

KINDS = ("email", "phone", "id_number", "address", "name")
#: Documents that the trees are fitted on, at most: three quarters of so many.
SAMPLE_DOCS = 4000
TREES, DEPTH = 20, 5
#: Share of the documents from which a word is common; at most 1 / COMMON times a document's mean words are.
COMMON = 0.005
#: Different rare words that a given name stands before, at least, and the share of its capitalised uses that do.
FOLLOWERS, SHARE = 5, 0.4
#: Share of a kind's labelled spans from which a surrounding word has odds of its own.
NOTED = 1 / 2000
SLOTS = 4
WORDS_OF_NAME = 4

# Public names of identity numbers, particles of surnames, and words for what is no person.
ID_WORDS = """
ssn nif dni nie nino nir insee iban passport passeport pasaporte reisepass pass ausweis personalausweis steuer
security insurance sozialversicherungsnummer seguridad identity identidad identité ni tax national id sécu sécurité
""".split()
PARTICLES = "von van de der den del della di da dos du la le el al bin ben ter ten zu zur y e".split()
SYSTEMS = "cluster server node build release version module service system project team code".split()
AT_WORDS, DOT_WORDS = ("at", "arroba", "a", "ät"), ("dot", "punto", "punkt", "point", "ponto")
STREETS = re.compile(
    r"(?i)\b(?:street|st|road|rd|avenue|ave|av|avda|avenida|lane|ln|boulevard|blvd|bd|drive|dr|court|ct|terrace|way|close"
    r"|place|pl|square|sq|row|crescent|parkway|circle|hill|mews|rue|chemin|allée|impasse|quai|route|cours|passage|calle"
    r"|paseo|plaza|pza|camino|ronda|carretera|travesía|straße|strasse|str|gasse|allee|weg|platz|ring|damm|ufer|steig|pfad"
    r"|markt|am|an der|im|in der|auf dem|zum|zur|unter den)\b|(?<!\w)c/|\w(?:straße|strasse|str\.|gasse|allee|weg|platz|ring"
    r"|damm|ufer|steig|pfad|markt)"
)

_CAP = r"(?:[A-ZÀ-ÖØ-ÞŠŽ](?:[^\W\d_]|['’-](?=[^\W\d_]))+)"
_DOT = r"(?:\.|\s?(?:\[dot\]|\(dot\)|\bdot\b|\bpunto\b|\bpunkt\b|\bpoint\b)\s?)"
_LOCAL, _DOMAIN = re.compile(r"(?<![\w.+-])[\w.+-]*\w\Z"), re.compile(r"[\w-]+(?:\.[\w-]+)*")
_SPELLED = [
    re.compile(
        r"(?i)(?<![\w.+-])[\w.+-]*\w\s?(?:\[at\]|\(at\)|\{at\}|\(a\)|\(arroba\))\s?[\w-]+(?:" + _DOT + r"[\w-]+)+"
    ),
    re.compile(r"(?i)(?<![\w.+-])[\w.+-]*\w (?:at|arroba) [\w-]+(?: (?:dot|punto|punkt|point) [\w-]+)+"),
]
#: Signs of a line before and behind each digit in which formats with digits are looked for.
BEFORE, BEHIND = 80, 120
#: Formats of numbers and addresses.
PATTERNS: dict[str, list[re.Pattern]] = {
    "phone": [
        re.compile(r"(?<![\w.+/-])(?:\+|\(\+?)?\d[\d() ./-]{5,18}\d(?![\w]|[.:-]\d)"),
    ],
    "id_number": [
        re.compile(
            r"(?=[A-Z\d])(?:"
            r"(?<![\w.-])\d{3}[ -]\d{2}[ -]\d{4}(?![\w]|[.-]\d)"
            r"|(?<![\w-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z](?!\w)"
            r"|(?<![\w-])(?:\d{8}|[XYZ]\d{7})[ -]?[A-Z](?!\w)"
            r"|(?<![\w.+-])\d{2} ?\d{3} ?\d{3} ?\d{3}(?![\w]|[ .-]\d)"
            r"|(?<![\w.+-])\d ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}(?![\w]|[ .-]\d)"
            r"|(?<![\w-])[A-Z]{1,2}\d{6,9}(?!\w)"
            r"|(?<![\w-])[A-Z]\d{2}[A-Z]\d{5}(?!\w)"
            r"|(?<![\w.+-])\d{9,11}(?![\w]|[.-]\d)"
            r")"
        ),
    ],
    "address": [
        re.compile(
            r"\b\d{1,5}[A-Za-z]?,? (?:(?:[A-Z][\w'’-]*) ){1,3}(?i:street|st|road|rd|avenue|ave|lane|ln"
            r"|boulevard|blvd|drive|dr|court|ct|terrace|way|close|place|pl|square|sq|row|crescent|parkway"
            r"|circle|hill)\b"
        ),
        re.compile(
            r"(?<![\w-])[A-ZÄÖÜ][\wäöüß-]*(?:(?i:straße|strasse|str\.|gasse|allee|weg|platz|ring|damm"
            r"|ufer|steig|pfad|markt)|(?:[ -](?i:straße|strasse|str\.|gasse|allee|weg|platz|ring"
            r"|damm)))\s?\d{1,4}(?: ?[a-zA-Z](?!\w))?"
        ),
        re.compile(
            r"\b(?:(?:Am|An der|Im|In der|Auf dem|Zum|Zur"
            r"|Unter den) (?:[A-ZÄÖÜ][\wäöüß-]+ ?){1,3})\d{1,4}(?: ?[a-z](?!\w))?"
        ),
        re.compile(
            r"\b\d{1,5}(?: ?[a-z](?=[, ]))?(?:,? (?:bis|ter|quater))?,? (?i:rue|avenue|av\.|boulevard|bd"
            r"|chemin|place|allée|impasse|quai|route|cours|square|passage)(?: (?i:de la|de l['’]|des|du"
            r"|de|d['’]|la|le|les))? ?[A-ZÀ-Þ][\w'’À-ÿ-]*(?: [A-ZÀ-Þ][\w'’À-ÿ-]*)*"
        ),
        re.compile(
            r"(?<!\w)(?i:calle|c/|avda\.?|avenida|av\.|paseo|p\.º|plaza|pza\.?|camino|ronda|carretera"
            r"|travesía)(?: (?i:de las|de los|de la|del|de|la"
            r"|el))? ?[A-ZÁÉÍÓÚÑ][\wáéíóúñÁÉÍÓÚÑ'-]*(?: [A-ZÁÉÍÓÚÑ][\wáéíóúñÁÉÍÓÚÑ'-]*)*,? (?:(?:nº|n\.º"
            r"|núm\.|no\.|n°) ?)?\d{1,4}"
        ),
        # a number and capitalised words, or the other way round, without any word for a street
        re.compile(rf"(?<![\w.,:-])\d{{1,4}}[A-Za-z]?,? {_CAP}(?:[ -]{_CAP}){{0,2}}"),
        re.compile(rf"(?<![\w'’-]){_CAP}(?:[ -]{_CAP}){{0,2}},? \d{{1,4}}(?: ?[a-z](?!\w))?(?![\w.:%-])"),
    ],
}

#: Patterns of addresses with a word for a street.
TYPED = len(PATTERNS["address"]) - 2
_ID_SHAPE = re.compile(
    r"(?:\d{3}[ -]\d{2}[ -]\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|(?:\d{8}|[XYZ]\d{7})[ -]?[A-Z]|\d{2} ?\d{3} ?\d{3} ?\d{3}"
    r"|\d ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}|[A-Z]{1,2}\d{6,9}|[A-Z]\d{2}[A-Z]\d{5})$"
)
_PHONE_SHAPE = re.compile(
    r"(?:\+\d|\(\+?\d{1,4}\) ?\d|\d{3}[-.]\d{3}[-.]\d{4}$|00\d|0\d{2,5}[ /]\d|\d{2}(?:\.\d{2}){4}$|0\d{9,10}$)"
)
_NO_PHONE = re.compile(r"(?:\d{3}[ -]\d{2}[ -]\d{4}$|(?:19|20)\d\d[.-]\d{1,2}[.-]\d+|\d{1,3}(?:\.\d{1,3}){3}$|[1-9]\d*$)")
_ADDRESS_MARK = re.compile(r"(?i)(?:@|\s?[\[({]?(?:at|arroba|a)[\])}]?\s?)[a-z0-9][a-z0-9-]*(?:" + _DOT + r"[a-z0-9-]+)*" + _DOT + r"[a-z]{2,}$")

NAME_WIDTH, SPAN_WIDTH = 24, 22
WIDTH = len(KINDS) + NAME_WIDTH + SPAN_WIDTH + SLOTS
#: Places of the features of known given names in a name's features, and of its rare words.
_GIVEN_AT, _RARE_AT = (5, 6, 7), 9
_KIND = {k: i for i, k in enumerate(KINDS)}
_CANDIDATE = "kind tinyint, start_pos bigint, end_pos bigint, f array<float>, c array<bigint>, label double"
_COLUMNS = [x.split()[0] for x in _CANDIDATE.split(", ")]


class Words:
    """Hashes of the words that generators and features know."""

    def __init__(self, common: np.ndarray, given: np.ndarray):
        self.common, self.given = np.sort(common), np.sort(given)
        self.title, self.particle, self.system = hashes(TITLES), hashes(PARTICLES), hashes(SYSTEMS)
        self.id = hashes([*ID_WORDS, "pass-nr", "steuer-id", "id-nr", "tax-id"])
        self.at, self.dot = hashes(AT_WORDS), hashes(DOT_WORDS)


def _in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(values.shape, bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


class Marks:
    """A page's words as seen by the generators."""

    def __init__(self, page: Page, w: Words):
        self.page, h = page, page.hash
        self.known, self.title = _in(h, w.given), _in(h, w.title)
        self.common = _in(h, w.common) & ~self.known
        self.rare = ~self.known & ~self.common & (page.size >= 3)
        self.particle, self.system, self.id = _in(h, w.particle) & page.lower, _in(h, w.system), _in(h, w.id)
        before, after = page.codes[np.maximum(page.start - 1, 0)], page.codes[np.minimum(page.end, len(page.codes) - 1)]
        glue = np.array([ord(c) for c in "_@/\\`$#"])
        digit = lambda at: (page.kind[np.clip(at, 0, len(page.kind) - 1)] & DIGIT) > 0
        self.glued = np.isin(before, glue) | np.isin(after, glue) | digit(page.start - 1) | digit(page.end)
        self.dotted = page.dot & (page.size == 1) & ~self.glued
        self.link = page.blank | self.dotted | page.comma
        self.ends = np.flatnonzero((page.kind & LINE) > 0)
        self.word_line = np.searchsorted(self.ends, page.start)

    def line(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at)


def _name_runs(m: Marks) -> Iterator[tuple[np.ndarray, int]]:
    """(first words, number of words) of the names proposed."""
    p = m.page
    n = len(p.start)
    single = p.initial | (p.lower & m.dotted)
    titled = np.zeros(n, bool)
    titled[1:] = m.title[:-1] & (p.blank | p.dot)[:-1]
    minor = p.lower & (m.known | (m.rare & (p.size >= 4)))
    fit = (p.cap | p.initial | m.particle | minor | single) & ~m.glued
    for k in range(2, WORDS_OF_NAME + 1):
        if n < k:
            break
        i = np.flatnonzero(fit[: n - k + 1] & m.link[: n - k + 1])
        for t in range(1, k):
            i = i[fit[i + t] & (m.link[i + t] & ~p.comma[i + t] if t < k - 1 else True)]
        at = i[:, None] + np.arange(k)
        outer = ~m.particle[at[:, -1]] & (~m.particle[i] | titled[i])  # a surname with its particle after a title
        large = (p.cap | p.initial)[at] | m.particle[at]
        upper = large.all(axis=1) & outer & p.cap[at].any(axis=1)
        small = minor[at] | m.particle[at] | single[at]
        lower = small.all(axis=1) & outer & (m.rare[at] & (p.size >= 4)[at]).any(axis=1) & ~p.cap[at].any(axis=1)
        yield i[upper | lower], k
    # one word: after a title, or the last of its text
    last = np.zeros(n, bool)
    final = np.searchsorted(p.start, p.last, "left") - 1
    for t, w in enumerate(final.tolist()):
        if w >= 0 and p.start[w] >= p.first[t] and not p.text[p.end[w] : p.last[t]].strip():
            last[w] = True
    yield np.flatnonzero(p.cap & ~m.glued & ~m.title & (titled | last)), 1


def _names(m: Marks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, features, label) of name spans."""
    p = m.page
    n = len(p.start)
    out = []
    clip = lambda x: np.clip(x, 0, max(n - 1, 0))
    for i, k in _name_runs(m):
        if not len(i):
            continue
        at = i[:, None] + np.arange(k)
        j = i + k - 1
        before, after = clip(i - 1), clip(j + 1)
        tied = (i > 0) & (p.blank | p.dot | p.comma)[before]
        close = (i > 0) & (p.blank | m.dotted)[before]
        next_tied = (j + 1 < n) & p.blank[j]
        single = (p.size == 1)[at]
        end = p.end[j] + (single[:, -1] & (p.codes[np.minimum(p.end[j], len(p.codes) - 1)] == ord(".")))
        start = p.start[i]
        text = p.text_of(start)
        line_start = (i == 0) | (m.word_line[before] < m.word_line[i])
        line_end = (j + 1 >= n) | (m.word_line[after] > m.word_line[j])
        text_end = (j + 1 >= n) | (p.start[after] >= p.last[text])
        prev, nxt = p.codes[np.maximum(start - 1, 0)], p.codes[np.minimum(end, len(p.codes) - 1)]
        known, common = m.known[at], m.common[at] & ~single
        rare, title = m.rare[at], m.title[at].any(axis=1)
        titled = (i > 0) & m.title[before] & (p.blank | p.dot)[before]
        comma = p.comma[at[:, :-1]].any(axis=1)
        longer = close & (m.known | (p.initial & ~m.glued))[before] & ~comma
        extends = next_tied & (p.cap & m.rare)[after]
        f = np.stack(
            [
                np.full(len(i), k), single.sum(axis=1), comma, p.lower[i], p.all_upper[at].sum(axis=1),
                known[:, 0], known[:, -1], known.sum(axis=1), common.sum(axis=1), rare.sum(axis=1),
                title, p.size[at].max(axis=1), longer, extends, titled, next_tied & m.system[after],
                line_start, line_end, text_end, np.isin(prev, [34, 39, 40, 60, 61, 124]), np.isin(nxt, [34, 39, 41, 60, 124]),
                close & (p.cap & m.rare)[before], m.particle[at].sum(axis=1), common[:, 0],
            ],
            axis=1,
        ).astype("float32")
        label = np.full(len(i), np.nan)
        clean = ~title & ~common.any(axis=1) & ~longer & ~extends
        if k == 1:
            label[titled & rare[:, 0]] = 1
            label[text_end & known[:, 0] & ~tied] = 1
            label[text_end & known[:, 0] & tied & p.comma[before]] = 1
            label[common[:, 0] & ~titled] = 0
        else:
            first = known[:, 0] & (rare | single | m.particle[at])[:, 1:].all(axis=1) & rare.any(axis=1) & ~comma
            turned = comma & rare[:, 0] & (known | single)[:, 1:].all(axis=1)
            loud = known[:, -1] & rare[:, 0] & p.all_upper[i] & ~p.all_upper[j] & (k == 2)
            letters = single[:, 0] & ~single[:, -1] & (single | rare)[:, 1:].all(axis=1) & ~comma
            label[clean & (first | turned | loud | (letters & ~p.lower[i]))] = 1
            label[titled & m.particle[i] & clean & rare.any(axis=1)] = 1
            wrong = title | longer | extends | (next_tied & m.system[after])
            wrong |= common.any(axis=1) & ~(known[:, 0] & (k == 2))
            label[wrong & ~titled] = 0
            label[titled & (title | common.any(axis=1) | extends)] = 0
        out.append((start, end, f, label))
    if not out:
        return np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros((0, NAME_WIDTH), "float32"), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _mails(m: Marks, w: Words) -> Iterator[tuple[int, int]]:
    p, text = m.page, m.page.text
    for at in np.flatnonzero(p.codes == ord("@")).tolist():
        left = _LOCAL.search(text, max(0, at - 80), at)
        right = _DOMAIN.match(text, at + 1)
        if left and right:
            yield left.start(), right.end()
    signs = _in(p.hash, w.at)
    if not signs.any():
        return
    bracket = np.isin(p.codes[np.maximum(p.start - 1, 0)], [ord(c) for c in "[({"])
    spelled = np.zeros(len(p.start), bool)
    dots = _in(p.hash, w.dot)
    for k in range(2, 6):
        spelled[: max(len(spelled) - k, 0)] |= dots[k:]
    for i in np.flatnonzero(signs & (bracket | spelled)).tolist():
        lo, hi = max(0, int(p.start[i]) - 80), int(p.end[i]) + 160
        for pattern in _SPELLED:
            for x in pattern.finditer(text, lo, hi):
                if x.start() < p.start[i] < x.end():
                    yield x.span()


def _numbers(m: Marks) -> Iterator[tuple[str, int, int, int]]:
    """(kind, start, end, place of the pattern) of phones, identity numbers and addresses."""
    p = m.page
    digit = np.flatnonzero((p.kind & DIGIT) > 0)
    if not len(digit):
        return
    # what surrounds each digit within its line, from a blank on
    cuts = np.flatnonzero((p.kind & (BLANK | LINE)) > 0)
    line = np.searchsorted(m.ends, digit)
    lo, hi = np.append(0, m.ends + 1)[line], np.append(m.ends, len(p.codes))[line]
    back = np.searchsorted(cuts, digit - BEFORE, "right") - 1
    lo = np.maximum(lo, np.where(back >= 0, cuts[np.maximum(back, 0)], 0))
    hi = np.minimum(hi, digit + BEHIND) + 1
    new = np.append(True, lo[1:] > np.maximum.accumulate(hi)[:-1])
    lo, hi = lo[new], np.maximum.reduceat(hi, np.flatnonzero(new))
    hi = np.minimum(hi, len(p.codes))
    lines = [p.text[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
    joined = "\n".join(lines)
    at = np.concatenate(([0], np.cumsum(hi - lo + 1)))
    for kind, patterns in PATTERNS.items():
        for k, pattern in enumerate(patterns):
            for x in pattern.finditer(joined):
                a, b = x.span()
                i = int(np.searchsorted(at, a, "right")) - 1
                if b >= at[i + 1]:
                    continue
                if kind == "phone":
                    b -= joined[b - 1] == "("
                    if not 7 <= sum(c.isdigit() for c in joined[a:b]) <= 15:
                        continue
                move = int(lo[i] - at[i])
                yield kind, a + move, b + move, k


def _span_features(kind: str, s: str, prev: str, nxt: str, named: int, common: int) -> list[float]:
    """Format of an email, a number or an address."""
    groups = [len(g) for g in re.findall(r"\d+", s)] or [0]
    letters = sum(c.isalpha() for c in s)
    return [
        len(s), sum(groups), letters, len(groups), groups[0], groups[-1], max(groups), s[0] == "+", s[0] == "(", s[:2] == "00",
        s[0] == "0", "-" in s, "." in s, "/" in s, " " in s, s[0].isalpha(), s[-1].isalpha(),
        prev.isalnum() or prev in "_/", nxt.isalnum() or nxt in "_:/=",
        bool(_ADDRESS_MARK.search(s)) if kind == "email" else bool(STREETS.search(s)) if kind == "address" else 0,
        named, common,
    ]


def _span_label(kind: str, s: str, k: int, nxt: str, announced: bool, named: int, common: int) -> float:
    if kind == "email":
        return float(bool(_ADDRESS_MARK.search(s)) and nxt not in ":/")
    if kind == "phone":
        if announced or _NO_PHONE.match(s) or sum(c.isdigit() for c in s) < 8:
            return 0.0
        return 1.0 if _PHONE_SHAPE.match(s) else np.nan
    if kind == "id_number":
        shaped = bool(_ID_SHAPE.match(s))
        return 1.0 if announced and shaped else np.nan if announced else 0.0
    # a word for a street needs a name beside it, or in the same word
    if not named or common and k >= TYPED:
        return 0.0
    return 1.0 if k < TYPED or STREETS.search(s) else np.nan


def _spans(m: Marks, w: Words) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, start), end, features, label of the spans that are no names."""
    p, text = m.page, m.page.text
    found: dict[tuple[str, int, int], int] = {}
    for a, b in _mails(m, w):
        found.setdefault(("email", a, b), 0)
    for kind, a, b, k in _numbers(m):
        found.setdefault((kind, a, b), k)
    keys = list(found)
    a = np.array([x[1] for x in keys], "int64")
    b = np.array([x[2] for x in keys], "int64")
    first, last = np.searchsorted(p.start, a), np.searchsorted(p.start, b)
    line, f, label = m.line(a), [], []
    for x, (kind, lo, hi) in enumerate(keys):
        s, prev, nxt = text[lo:hi], text[lo - 1] if lo else "\n", text[hi]
        own = slice(first[x], last[x])
        common = named = 0
        announced = False
        if kind == "address":
            words = range(first[x], last[x])
            other = p.cap[own] & ~np.array([bool(STREETS.fullmatch(text[p.start[i] : p.end[i]])) for i in words], bool)
            named, common = int(other.sum()), int((m.common[own] & other).sum())
        elif kind != "email":
            near = [i for i in range(max(first[x] - 3, 0), first[x]) if m.id[i] and m.word_line[i] == line[x]]
            announced = bool(near) and not any(c.isdigit() for c in text[p.end[near[-1]] : lo])
        f.append(_span_features(kind, s, prev, nxt, named, common))
        label.append(_span_label(kind, s, found[kind, lo, hi], nxt, announced, named, common))
    shape = np.array(f, "float32").reshape(len(keys), SPAN_WIDTH)
    return [x[0] for x in keys], np.stack([a, b], 1), shape, np.array(label, "float64")


def _context(m: Marks, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the word before, the two before, the word behind and the two behind, within the line."""
    p = m.page
    n = len(p.start)
    if not n:
        return np.ones((len(a), SLOTS), "int64")
    line, stop = m.line(a), m.line(b)
    left, right = np.searchsorted(p.end, a, "right") - 1, np.searchsorted(p.start, b, "left")

    def word(i: np.ndarray, at: np.ndarray) -> np.ndarray:
        ok = (i >= 0) & (i < n)
        i = np.clip(i, 0, n - 1)
        return np.where(ok & (m.word_line[i] == at), p.hash[i], np.uint64(1))

    p1, p2, n1, n2 = word(left, line), word(left - 1, line), word(right, stop), word(right + 1, stop)
    both = lambda x, y: mix(x * np.uint64(31) + y)
    return np.stack([p1, both(p1, p2), n1, both(n1, n2)], 1).view("int64")


def _read(texts: list[str], w: Words) -> tuple[np.ndarray, ...]:
    """(text index, kind, start, end, features, context, label) of all spans of some texts."""
    page = Page(texts)
    m = Marks(page, w)
    start, end, name, label = _names(m)
    kinds, at, shape, other = _spans(m, w)
    kind = np.array([_KIND[k] for k in kinds] + [_KIND["name"]] * len(start), "int8")
    a, b = np.concatenate([at[:, 0], start]), np.concatenate([at[:, 1], end])
    f = np.zeros((len(kind), WIDTH - SLOTS), "float32")
    f[np.arange(len(kind)), kind] = 1
    f[len(kinds) :, len(KINDS) : len(KINDS) + NAME_WIDTH] = name
    f[: len(kinds), len(KINDS) + NAME_WIDTH :] = shape
    text = page.text_of(a)
    inside = b <= page.last[text]
    part = text, kind, a - page.first[text], b - page.first[text], f, _context(m, a, b), np.concatenate([other, label])
    return tuple(x[inside] for x in part)


def _slices(texts: list, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (what, a, b, n) of each batch: w documents with word a, c capitals of word a, p word a before b."""
    for batch in batches:
        texts = batch.text.to_list()
        for lo, hi in _slices(texts):
            p = Page(texts[lo:hi])
            own = np.unique(mix(p.hash + p.text_of(p.start).astype("uint64")), return_index=True)[1]
            word, docs = np.unique(p.hash[own], return_counts=True)
            cap, many = np.unique(p.hash[p.cap], return_counts=True)
            i = np.flatnonzero(p.cap[:-1] & p.cap[1:] & p.blank[:-1] & (p.size[:-1] > 2) & (p.size[1:] > 3))
            both, times = np.unique(np.stack([p.hash[i], p.hash[i + 1]], 1), axis=0, return_counts=True)
            rows = [("w", word, 0 * word, docs), ("c", cap, 0 * cap, many), ("p", both[:, 0], both[:, 1], times)]
            rows.append(("d", np.zeros(1, "uint64"), np.zeros(1, "uint64"), np.array([hi - lo])))
            yield pd.concat([pd.DataFrame({"what": x, "a": a.view("int64"), "b": b.view("int64"), "n": n}) for x, a, b, n in rows])


#: Short forms that are everyday words as well (fixed values).
_EVERYDAY = {"will", "pat", "dot", "den", "fran", "nat", "may", "sue", "art", "rich", "bill", "rob", "ray", "drew"}


def learn_words(docs: DataFrame, given_names: DataFrame) -> Words:
    """The common words of the corpus and its given names.

    Given names are those of the small fixed table, common short forms, and words that stand before FOLLOWERS or
    more different rare capitalised words in at least SHARE of their capitalised uses. Both lists are bounded by
    shares of the documents, so they may go to every task.
    """
    table = [x for r in given_names.select("given_name", "short_form").collect() for x in r if x]
    table += [*SHORT, *(s for v in SHORT.values() for s in v.split() if len(s) > 2 and s not in _EVERYDAY)]
    known = hashes(table)
    counts = docs.select("text").where("text is not null").mapInPandas(_count, "what string, a bigint, b bigint, n bigint")
    counts = materialise(counts.groupBy("what", "a", "b").agg(F.sum("n").alias("n")), "words")
    total = counts.where("what = 'd'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = counts.where("what = 'w'").where(F.col("n") >= max(2, COMMON * total)).select("a")
    spark = docs.sparkSession
    fixed = spark.createDataFrame([(int(x),) for x in np.concatenate([known, hashes(TITLES)]).view("int64")], "a bigint")
    pairs = counts.where("what = 'p'").select("a", "b", "n").join(common.withColumnRenamed("a", "b"), "b", "left_anti")
    pairs = pairs.join(fixed.withColumnRenamed("a", "b"), "b", "left_anti").join(fixed, "a", "left_anti")
    leads = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("followers"), F.sum("n").alias("used"))
    leads = leads.where(F.col("followers") >= max(FOLLOWERS, COMMON / 10 * total))
    caps = counts.where("what = 'c'").select("a", F.col("n").alias("caps"))
    more = leads.join(caps, "a").where(F.col("used") >= SHARE * F.col("caps")).select("a")
    column = lambda df: np.array([r.a for r in df.collect()], "int64").view("uint64")
    return Words(column(common), np.union1d(known, column(more)))


def candidates(docs: DataFrame, words: Words) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos, f, c, label) of all candidate spans, kind as place in KINDS.

    Texts that are null or empty have none. Positions count characters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def find(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id")
            for lo, hi in _slices(texts):
                text, kind, start, end, f, c, label = _read(texts[lo:hi], shared.value)
                numbers = [pa.array(kind), pa.array(start), pa.array(end), _lists(f), _lists(c)]
                labels = pa.array(label, mask=np.isnan(label))
                yield pa.record_batch([ids[lo:hi].take(pa.array(text)), *numbers, labels], names=["doc_id", *_COLUMNS])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_CANDIDATE}"
    return docs.select("doc_id", "text").where("text is not null and text <> ''").mapInArrow(find, schema)


def _lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    offsets = np.arange(len(rows) + 1, dtype="int32") * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(-1, width)


def context_odds(spans: DataFrame) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By kind and slot: hashes of surrounding words and the logarithm of their odds, from all labelled spans.

    A word needs NOTED of its kind's labelled spans, so that each list has at most 1 / NOTED words.
    """
    known = spans.where("label is not null").select("kind", "label", F.posexplode("c").alias("slot", "h"))
    n = known.groupBy("kind", "slot", "h").agg(F.sum("label").alias("yes"), F.sum(1 - F.col("label")).alias("no"))
    n = materialise(n, "odds")
    total = n.groupBy("kind", "slot").agg(F.sum(F.col("yes") + F.col("no")).alias("total"))
    some = n.join(total, ["kind", "slot"]).where(F.col("yes") + F.col("no") >= F.greatest(F.lit(5.0), NOTED * F.col("total")))
    out = {}
    for key, g in some.select("kind", "slot", "h", "yes", "no").toPandas().groupby(["kind", "slot"]):
        h = g.h.to_numpy("int64")
        order = np.argsort(h)
        out[key] = h[order], np.log((g.yes.to_numpy() + 0.5) / (g.no.to_numpy() + 0.5))[order]
    return out


def with_features(spans: DataFrame, odds: dict, hide: bool = False) -> DataFrame:
    """Spans with ``features`` in place of f and c. With ``hide`` names look as if no word of theirs were known."""
    shared = spans.sparkSession.sparkContext.broadcast(odds)
    kept = [c for c in spans.columns if c not in ("f", "c")]

    def fill(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            f, c = _matrix(b.column("f"), WIDTH - SLOTS), _matrix(b.column("c"), SLOTS)
            kind, every = b.column("kind").to_numpy(), np.zeros((len(f), WIDTH))
            every[:, : WIDTH - SLOTS] = f
            for (k, slot), (h, value) in shared.value.items():
                rows = np.flatnonzero(kind == k)
                at = np.minimum(np.searchsorted(h, c[rows, slot]), len(h) - 1)
                every[rows, WIDTH - SLOTS + slot] = np.where(h[at] == c[rows, slot], value[at], 0)
            if hide:
                given, rare = [len(KINDS) + x for x in _GIVEN_AT], len(KINDS) + _RARE_AT
                every[:, rare] += every[:, given[-1]]
                every[:, given] = 0
            yield pa.record_batch([*[b.column(x) for x in kept], _lists(every)], names=[*kept, "features"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spans.schema if f.name in kept)
    return spans.mapInArrow(fill, schema + ", features array<double>").withColumn("vector", array_to_vector("features"))


def fit(spans: DataFrame, odds: dict) -> GBTClassificationModel | None:
    """Trees from the labelled spans; None without labels of both sorts."""
    known = spans.where("label is not null")
    rows = with_features(known, odds).unionByName(with_features(known.where(F.col("kind") == _KIND["name"]), odds, True))
    train = materialise(rows.select("features", "label").repartition(4), "train").withColumn("vector", array_to_vector("features"))
    if train.select("label").distinct().count() < 2:
        return None
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=32)
    return trees.fit(train)


def thresholds(scored: DataFrame) -> dict[int, float]:
    """By kind: of the scores at which the labelled spans accepted are right in 99 of 100 cases, or of all if there
    is none such, the one of the best F1, then the nearest to 0.5. ``scored`` holds kind, label and p."""
    n = scored.where("label is not null").groupBy("kind", "label", F.round("p", 2).alias("p")).count().toPandas()
    out = {}
    for kind in range(len(KINDS)):
        h = n[n.kind == kind]
        total = h[h.label == 1]["count"].sum()
        good = {}
        for t in sorted(x for x in set(h.p) if 0.3 <= x <= 0.9):
            above = h[h.p >= t]
            good[t] = above[above.label == 1]["count"].sum(), above["count"].sum()
        sure = [t for t, (g, k) in good.items() if k and g / k >= 0.99] or list(good)
        best = max(sure, key=lambda t: (2 * good[t][0] / (good[t][1] + total), -abs(t - 0.5)), default=0.5)
        out[kind] = float(best if total else 0.5)
    return out


def scored_spans(docs: DataFrame, given_names: DataFrame, sample: int = SAMPLE_DOCS) -> tuple[DataFrame, dict[int, float]]:
    """(spans with label, score p and whether the trees were fitted on their document, threshold of each kind)."""
    spans = materialise(candidates(docs, learn_words(docs, given_names)), "spans")
    odds = context_odds(spans)
    # the trees' documents: at most ``sample`` in the order of a hash, but for a fourth of them
    ids = docs.where("text is not null and text <> ''").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ids = materialise(ids.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) > 0).distinct(), "sample")
    model = fit(spans.join(ids, "doc_id", "left_semi"), odds)
    if model is None:
        none = spans.where(F.lit(False)).select("doc_id", "kind", "start_pos", "end_pos", "label")
        return none.withColumn("p", F.lit(0.0)).withColumn("fitted", F.lit(False)), dict.fromkeys(range(len(KINDS)), 0.5)
    p = model.transform(with_features(spans, odds)).withColumn("p", F.round(vector_to_array("probability")[1], 4))
    marked = p.select("doc_id", "kind", "start_pos", "end_pos", "label", "p").join(ids.withColumn("fitted", F.lit(True)), "doc_id", "left")
    scored = materialise(marked.withColumn("fitted", F.coalesce("fitted", F.lit(False))), "scored")
    return scored, thresholds(scored.where("not fitted"))


def _resolve(spans: list) -> list[tuple[str, int, int]]:
    """Spans without overlaps: the likeliest first, of equals the longer, then the earlier."""
    taken: list[tuple[int, int]] = []
    out = []
    for s in sorted(spans, key=lambda s: (-round(s["p"], 2), s["start_pos"] - s["end_pos"], s["start_pos"])):
        a, b = s["start_pos"], s["end_pos"]
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            out.append((s["kind"], a, b))
    return sorted(out, key=lambda x: x[1])


def found_spans(docs: DataFrame, given_names: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, spans): the accepted spans of every document that has any, in order, without overlaps.

    ``doc_id`` must be unique; other columns than doc_id and text are ignored. An empty table, or one
    without labelled candidates, gives an empty result.
    """
    scored, limits = scored_spans(docs, given_names, sample)
    limit = F.element_at(F.create_map(*[F.lit(x) for kt in limits.items() for x in kt]), F.col("kind").cast("int"))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind").cast("int") + 1).alias("kind")
    kept = scored.where(F.round("p", 2) >= limit).select("doc_id", F.struct(name, "start_pos", "end_pos", "p").alias("s"))

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            best = [[dict(zip(("kind", "start_pos", "end_pos"), x)) for x in _resolve(s)] for s in b.s]
            yield pd.DataFrame({"doc_id": b.doc_id, "spans": best})

    kind = docs.schema["doc_id"].dataType.simpleString()
    each = kept.groupBy("doc_id").agg(F.collect_list("s").alias("s"))
    return each.mapInPandas(resolve, f"doc_id {kind}, spans array<struct<kind:string,start_pos:bigint,end_pos:bigint>>")


def found(docs: DataFrame, given_names: DataFrame) -> DataFrame:
    """(doc_id, kind, start_pos): one row for each place."""
    each = found_spans(docs, given_names).select("doc_id", F.explode("spans").alias("s"))
    return each.select("doc_id", "s.kind", "s.start_pos")


def redact(docs: DataFrame, given_names: DataFrame) -> DataFrame:
    """(doc_id, text, n): every text with its places replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS]
    or [NAME]; all else unchanged. Null texts stay null."""
    spans = found_spans(docs, given_names)
    joined = docs.select("doc_id", "text").join(spans, "doc_id", "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(state: Column, s: Column) -> Column:
        kept = F.substring("text", (state["at"] + 1).cast("int"), (s["start_pos"] - state["at"]).cast("int"))
        return F.struct(F.concat(state["out"], kept, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), s["end_pos"].alias("at"))

    text = F.aggregate("spans", start, step, lambda st: F.concat(st["out"], F.substring("text", (st["at"] + 1).cast("int"), F.lit(2147483647))))
    return joined.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(text).alias("text"), F.coalesce(F.size("spans"), F.lit(0)).alias("n"))
