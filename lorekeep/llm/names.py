"""Linking variant spellings of person and organisation names inside a project.

1. Names are reduced to content tokens (accents, titles, legal forms, order and case do not count),
   abbreviated tokens and initials. Names of any number of words, with digits, and of any script are taken.
2. Which names belong to persons or organisations is read from the tokens: each token's rows of either sort
   are counted over the whole table, so that a wrong ``type`` of one row does not matter.
3. Blocks are phonetic codes of pairs of sorted tokens: both tokens are coded by their beginning, their end,
   their letters and their nickname class, and a block is a code of one with a code of the other. A frequent
   token so never makes a block of its own, and two spellings meet as long as each token keeps one code.
   Names with initials or abbreviations meet full names by a code of one token and the first letter of another.
4. Inside a block, tokens are aligned by Jaro-Winkler similarity, a nickname table, initials and abbreviations.
5. Accepted pairs are clustered by connected components; a name with initials only joins a component of full
   names where just one fits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import permutations

import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.components import connected_components
from lorekeep.sources.tables import materialise

# Words around names that do not tell bearers apart.
TITLES = """
mr mrs ms miss mme mlle dr prof professor sir herr frau hr fr sr sra srta don dona senor senora
monsieur madame mademoiselle ing dipl
""".split()
LEGAL = """
inc incorporated corp corporation llc llp ltd limited plc gmbh ag kg ohg se sa sl srl sas sarl bv nv
oy ab as group grp gruppe holding company co the sociedad limitada anonima societe anonyme
aktiengesellschaft gesellschaft mbh and und et y
""".split()
#: Common short forms (fixed values), besides those of the given_names table.
SHORT = {
    "christopher": "chris kit topher", "charlotte": "lottie charlie", "lawrence": "larry lars",
    "dorothy": "dolly dot dottie", "patricia": "patty pat tricia trish", "ignacio": "nacho",
    "stephanie": "steffi steph stefanie", "samuel": "sam sammy", "william": "bill will billy liam",
    "richard": "rick dick rich richie", "zachary": "zach zack", "florence": "flo florrie flossie",
    "natalia": "natasha tasha nat talia", "deniz": "den", "jasper": "jas", "robert": "rob bob bobby robbie bert",
    "elizabeth": "liz beth betty lisa eliza", "katherine": "kate kathy katie kat",
    "margaret": "peggy maggie meg greta", "thomas": "tom tommy", "michael": "mike mick micha",
    "alexandra": "alex sandra lexi sasha", "susanne": "susi sanne sue", "edward": "ned ed ted eddie",
    "frederick": "fred freddy fritz", "jennifer": "jenny jen", "nicholas": "nick nico klaus", "benjamin": "ben benny",
    "daniel": "dan danny", "andrew": "drew andy", "victoria": "vicky tori", "gregory": "greg", "raymond": "ray",
    "leonard": "len leo lenny", "matthias": "matze matt", "valentina": "tina vale", "isabella": "bella isa",
    "penelope": "penny", "theodora": "thea dora", "wilhelmina": "mina willa", "henrietta": "hettie etta",
    "harold": "hal harry", "francisco": "paco paquito pancho fran", "josefina": "pepa pepita fina",
    "dolores": "lola lolita", "emmanuel": "manu manny", "konstantin": "kostja", "mercedes": "merche",
    "rosalind": "roz rosa", "ulrich": "uli", "yolanda": "yoli", "bernadette": "bernie", "cornelius": "corey neil",
    "gabriele": "gabi", "jacqueline": "jackie", "johannes": "hannes hans jo", "olivia": "liv livvy",
}
_DROP = {*TITLES, *LEGAL}
#: Joined letters of a legal form, as "S.A." or "G.m.b.H."
_DOTTED = re.compile(
    r"(?i)(?<![a-z])(?:s\.(?:a\.|l\.|r\.l\.|a\.s\.)|g\.m\.b\.h\.|a\.g\.|l\.l\.c\.|b\.v\.)?(?=\W|$)"
)
_LETTERS = {"ß": "ss", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "æ": "ae", "đ": "d"}
#: Types whose rows bear names.
BEARERS = ("person", "org")
#: Logarithm of the odds below which the tokens of a name speak against a bearer, about 1 to 12.
AGAINST = -2.5
#: Rows of a tile of a block; a greater block is compared as pairs of tiles.
TILE = 1000
#: Words up to this number are aligned in every order; longer names are aligned greedily.
EVERY_ORDER = 4
#: Tokens of a name whose codes are all paired; of more, neighbours in sorted order are.
PAIRED = 8
#: Letters up to which words are compared by similarity; longer ones differ by one slip at most.
LONG = 64

Name = tuple[list[str], list[str], list[str]]


def fold(text: str) -> str:
    """Text without accents; letters without a decomposition are spelled out."""
    t = "".join(_LETTERS.get(c, c) for c in text)
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def parse(name: str | None) -> Name | None:
    """(content tokens, initials, abbreviated tokens) of a name; None for a name without a word."""
    if not name:
        return None
    plain = _DOTTED.sub(" ", fold(name.strip())).strip()
    if " " not in plain:
        plain = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", plain)
    spaced = " " in plain
    tokens, initials, short = [], [], []
    for w in regex.findall(r"[\p{L}\p{N}]+\.?", re.sub("['\u2019]", "", plain)):
        bare = w.rstrip(".").lower()
        if bare in _DROP and not (len(bare) == 1 and w.endswith(".")):
            continue
        if len(bare) == 1 and bare.isalpha() and bare < "\u2e80":
            initials.append(bare)
        elif w.endswith(".") and spaced and not bare.isdigit():
            short.append(bare)
        else:
            tokens.append(bare)
    if not tokens:
        tokens, short = short, []
    return (sorted(tokens), initials, short) if tokens else None


@lru_cache(maxsize=1 << 17)
def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    other = [c for c, u in zip(b, used) if u]
    t = sum(x != y for x, y in zip(mine, other)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


#: Signs that sound alike (fixed values); vowels share one sign, letters of other scripts stay.
_SOUND = str.maketrans("abcdefghijklmnopqrstuvwxyz", "apktafkhahklmnapklstaffsas")


def sound(letters: str) -> str:
    """Phonetic code: sound classes, repeated signs once."""
    return re.sub(r"(.)\1+", r"\1", letters.translate(_SOUND))


def _one_slip(a: str, b: str) -> bool:
    """One letter added, left out, changed, or swapped with its neighbour; words of repeated syllables
    have a low similarity then."""
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if a[i + 1 :] in (b[i + 1 :], b[i:]) or a[i:] == b[i + 1 :]:
        return True
    return a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]


def near(a: str, b: str) -> bool:
    """Spellings of one word: some slips of the pen apart. Words with digits must be equal."""
    if a == b:
        return True
    least = min(len(a), len(b))
    if least < 4 or abs(len(a) - len(b)) > 2 or not (a.isalpha() and b.isalpha()):
        return False
    return least <= LONG and jaro_winkler(a, b) >= 0.9 or least >= 6 and _one_slip(a, b)


class Nicknames:
    """Full names and their short forms. ``of(word)`` gives the full names that a word may stand for."""

    def __init__(self, rows: Iterable[tuple[str | None, str | None]]):
        self.full: dict[str, set[str]] = {}
        given = [(fold(g).lower(), fold(s).lower()) for g, s in rows if g and s]
        for name, shorts in [*SHORT.items(), *given]:
            for s in shorts.split():
                self.full.setdefault(s, {s}).add(name)
                self.full.setdefault(name, {name})
        self.coded: dict[str, set[str]] = {}
        for word in self.full:
            for c in codes(word):
                self.coded.setdefault(c, set()).add(word)
        self.known: dict[str, set[str]] = {}

    def of(self, word: str) -> set[str]:
        out = self.full.get(word) or self.known.get(word)
        if out is None:
            some = {k for c in codes(word) for k in self.coded.get(c, ())} if 5 <= len(word) <= LONG else ()
            best = max(some, key=lambda k: (jaro_winkler(word, k), k), default=word)
            out = self.full[best] if best != word and jaro_winkler(word, best) >= 0.92 else {word}
            if len(self.known) > 1 << 16:
                self.known.clear()
            self.known[word] = out
        return out

    def letters(self, word: str) -> set[str]:
        """First letters of a word and of the full names it is short for."""
        return {n[0] for n in self.full.get(word, ())} | {word[0]}


def codes(token: str) -> list[str]:
    """Phonetic codes of both ends of a token, and its letters in order: a slip at one end leaves the other,
    and swapped letters leave the letters. Words whose lengths differ by one have ends of one length."""
    if len(token) <= 3:
        return ["f:" + sound(token)]
    ends = (2,) if len(token) < 6 else (2, 3) if len(token) == 6 else (3,)
    both = [c for n in ends for c in (f"f{n}:{sound(token[:n])}", f"l{n}:{sound(token[-n:])}")]
    return [*both, "s:" + "".join(sorted(token))]


def block_keys(name: Name, nick: Nicknames) -> list[tuple[str, int]]:
    """(block, side) of a name. Side 0: every two names of the block are compared; 1 for full names and 2 for
    those with initials or abbreviations: pairs of full names are left to other blocks."""
    tokens, initials, short = name
    coded = [codes(t) for t in tokens]
    out: dict[tuple[str, int], None] = {}
    if len(tokens) == 1 and not initials and not short:
        return [("1 " + c, 0) for c in coded[0]]
    classes = [c + ["n:" + n for n in nick.of(t) if n != t or t in nick.full] for t, c in zip(tokens, coded)]
    n = len(tokens)
    for i in range(n):
        for j in range(i + 1, n if n <= PAIRED else min(n, i + 3)):
            out.update(dict.fromkeys((" ".join(sorted((x, y))), 0) for x in classes[i] for y in classes[j]))
    for i in range(n):
        for j in range(n):
            if i != j:
                letters = sorted({sound(x) for x in nick.letters(tokens[j])})
                out.update(dict.fromkeys((f"{c} i:{x}", 1) for c in coded[i] for x in letters))
    for x in {sound(w[0]) for w in [*initials, *short]}:
        out.update(dict.fromkeys((f"{c} i:{x}", 2) for own in coded for c in own))
    return list(out)


def compatible(a: Name, b: Name, nick: Nicknames, organisation: frozenset[str] = frozenset()) -> int:
    """2: the names mean one bearer; 1: they do if only one full name fits; 0: they don't.

    Arguments are results of ``parse``; words of ``organisation`` are no given names.
    """
    na, nb = len(a[0]) + len(a[2]), len(b[0]) + len(b[2])
    if na > nb:
        a, b, na, nb = b, a, nb, na
    (ta, ia, sa), (tb, ib, sb) = a, b
    if na == 1 and nb == 1:
        return 2 * (near(ta[0], tb[0]) and ia[:1] == ib[:1])
    if na == nb:
        if ia and ib and not {*ia} & {*ib}:
            return 0  # other middle names
        if len(sa) + len(sb) > 1:
            return 2 * (sa == sb and _aligned(ta, tb, nick))
        if sa or sb:
            return 2 * _abbreviated(ta, sa, tb, sb)
        return 2 * _aligned(ta, tb, nick)
    if sa or sb:
        return 0
    missing = nb - na
    left = _left_over(ta, tb)
    if left is None:
        return 0
    if len(ia) < missing:  # a middle name left out, of a person's full name
        return int(not ia and na >= 2 and missing == 1 and not {*tb} & organisation)
    if {*left} & organisation or ia[missing:] and ib and not {*ia[missing:]} & {*ib}:
        return 0
    firsts = ia[:missing]
    for order in permutations(left) if missing <= EVERY_ORDER else [left]:
        if all(c in nick.letters(w) for c, w in zip(firsts, order)):
            return 1
    return 0


def _left_over(few: list[str], many: list[str]) -> list[str] | None:
    """Words of ``many`` that no word of ``few`` stands for; None if a word of ``few`` stands for none."""
    left = list(many)
    for w in few:
        fits = [x for x in left if near(w, x)]
        if not fits:
            return None
        left.remove(max(fits, key=lambda x: (jaro_winkler(w, x), x)))
    return left


def _aligned(ta: list[str], tb: list[str], nick: Nicknames) -> bool:
    """Whether two equally long lists hold spellings of the same words; one of them may be a short form."""
    if ta == tb:
        return True
    if len(ta) != len(tb):
        return False
    if len(ta) <= EVERY_ORDER:
        return any(_fits(ta, order, nick) for order in permutations(tb))
    left, order = list(tb), []
    for w in ta:
        order.append(max(left, key=lambda x: (x == w, near(w, x), x)))
        left.remove(order[-1])
    return _fits(ta, order, nick)


def _fits(ta: Iterable[str], tb: Iterable[str], nick: Nicknames) -> bool:
    slips, other = [], []
    for a, b in zip(ta, tb):
        if a != b:
            (slips if near(a, b) else other).append((a, b))
            if len(other) > 1:
                return False
    if other:
        a, b = other[0]
        return len(slips) <= 1 and bool(nick.of(a) & nick.of(b))
    # several slips at once are likely only where the words stay very close
    if len(slips) <= 1 or all(_one_slip(a, b) for a, b in slips):
        return True
    return sum(jaro_winkler(a, b) for a, b in slips) >= 0.935 * len(slips)


def _abbreviated(ta: list[str], sa: list[str], tb: list[str], sb: list[str]) -> bool:
    """Whether one abbreviation stands for the word left over by the other words."""
    few, many, cut = (ta, tb, sa) if sa else (tb, ta, sb)
    left = _left_over(few, many)
    return bool(left) and left[0].startswith(cut[0])


def _text(name: Name) -> str:
    return ";".join("|".join(part) for part in name)


@lru_cache(maxsize=1 << 14)
def _name(text: str) -> Name:
    return tuple(part.split("|") if part else [] for part in text.split(";"))


def name_forms(entities: DataFrame) -> DataFrame:
    """(id, project, form, name, organisation): the parsed name of every id that may be a bearer.

    ``name`` is the parsed name as text, ``organisation`` its tokens that organisations have more often than
    persons. A token's rows of bearers and of others are counted over all entities; a name is a bearer's unless the
    odds of its tokens together speak against it. Rows of one id are one entity, the least of them counts.
    """

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = [parse(n) for n in b.name]
            keep = [x is not None for x in p]
            out = b.loc[keep, ["id", "project", "type"]].reset_index(drop=True)
            yield out.assign(name=[_text(x) for x in p if x])

    known = entities.where("id is not null and project is not null and name is not null")
    once = known.groupBy("id").agg(F.min(F.struct("project", "name", "type")).alias("e")).select("id", "e.*")
    parsed = materialise(once.mapInPandas(forms, "id string, project string, type string, name string"), "parsed")
    words = F.array_distinct(F.flatten(F.transform(F.slice(F.split("name", ";"), 1, 1), lambda p: F.split(p, r"\|"))))
    each = parsed.groupBy("project", "name").agg(
        F.count_if(F.col("type") == BEARERS[0]).alias("person"),
        F.count_if(F.col("type") == BEARERS[1]).alias("org"),
        F.count_if(~F.col("type").isin(*BEARERS)).alias("other"),
    )
    each = materialise(each.select("project", "name", "person", "org", "other", words.alias("words")), "forms")
    token = each.select(F.explode("words").alias("t"), "person", "org", "other").groupBy("t")
    token = token.agg(*[F.sum(c).alias(c) for c in ("person", "org", "other")])
    odds = F.log((F.col("person") + F.col("org") + 0.5) / (F.col("other") + 0.5))
    stat = token.select("t", odds.alias("odds"), (F.col("org") > F.col("person")).alias("org"))
    of = each.select("project", "name", F.explode("words").alias("t")).join(stat, "t").groupBy("project", "name")
    taken = of.agg(F.sum("odds").alias("odds"), F.collect_set(F.when(F.col("org"), F.col("t"))).alias("organisation"))
    taken = taken.where(F.col("odds") >= AGAINST).select(
        "project", "name", F.array_join(F.sort_array("organisation"), "|").alias("organisation")
    )
    joined = parsed.select("id", "project", "name").join(taken, ["project", "name"])
    return joined.select("id", "project", F.xxhash64("project", "name").alias("form"), "name", "organisation")


def link_forms(forms: DataFrame, nick: Nicknames) -> DataFrame:
    """(a, b, grade): accepted pairs of forms; a full name is ``b`` where the grade is 1."""
    distinct = forms.select("project", "form", "name", "organisation").distinct()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (xxhash.xxh3_64_intdigest(f"{p}/{k}") - (1 << 63), f, side)
                for p, f, n in zip(b.project, b.form, b.name)
                for k, side in block_keys(_name(n), nick)
            ]
            yield pd.DataFrame(rows, columns=["block", "form", "side"])

    blocks = materialise(distinct.mapInPandas(keys, "block bigint, form bigint, side tinyint"), "blocks")
    # a block beyond TILE names is cut into pairs of tiles, each compared by a task of its own
    count = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("side").alias("side"))
    size = count.where("n > 1 and side <> 1").select("block", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.hash("form"), F.col("tiles"))
    pair = lambda j: F.struct(F.least(tile, j).alias("i"), F.greatest(tile, j).alias("j"))
    spread = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), pair)
    cut = blocks.join(size, "block").withColumn("at", F.explode(spread))
    cut = cut.select("block", "at.i", "at.j", tile.alias("tile"), "form", "side")
    named = cut.join(distinct.select("form", "name", "organisation"), "form")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()  # names often meet in several blocks of a task
        for frame in _whole_blocks(batches):
            out = []
            names = [_name(n) for n in frame.name]
            orgs = [frozenset(o.split("|")) for o in frame.organisation]
            form, tile, side = frame.form.to_list(), frame.tile.to_list(), frame.side.to_list()
            key = list(zip(frame.block, frame.i, frame.j))
            starts = [0, *(k for k in range(1, len(key)) if key[k] != key[k - 1]), len(key)]
            for lo, hi in zip(starts, starts[1:]):
                cross = key[lo][1] != key[lo][2]
                for x in range(lo, hi):
                    if side[x] == 1:
                        continue
                    for y in range(lo, hi):
                        if side[y] == side[x] and y >= x or cross and tile[x] == tile[y] or form[x] == form[y]:
                            continue
                        pair = (form[x], form[y]) if form[x] < form[y] else (form[y], form[x])
                        if pair not in seen:
                            seen.add(pair)
                            grade = compatible(names[x], names[y], nick, orgs[x] | orgs[y])
                            if grade:
                                a, b = (x, y) if len(names[x][0]) <= len(names[y][0]) else (y, x)
                                out.append((form[a], form[b], grade))
            if len(seen) > 1 << 20:
                seen.clear()
            yield pd.DataFrame(out, columns=["a", "b", "grade"])

    ordered = named.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")
    return ordered.mapInPandas(compare, "a bigint, b bigint, grade int").distinct()


def _whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of a sorted stream that hold whole blocks only; a block has at most two tiles of rows."""
    held = None
    for b in batches:
        frame = b if held is None else pd.concat([held, b], ignore_index=True)
        if not len(frame):
            continue
        last = frame[["block", "i", "j"]].eq(frame[["block", "i", "j"]].iloc[-1]).all(axis=1)
        cut = int(last.to_numpy().argmax())
        held = frame.iloc[cut:].reset_index(drop=True)
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def name_groups(entities: DataFrame, given_names: DataFrame) -> DataFrame:
    """(id, project, group_id): one row per id whose name reads as a person's or an organisation's.

    group_id is the least id of the linked group. ``given_names`` (given_name, short_form) is a small
    fixed table. Copies of an id count once; null names, ids and projects are left out. Equal names of a
    project are one bearer. An empty table gives an empty result; other columns are ignored.
    """
    rows = given_names.select("given_name", "short_form").collect()
    nick = Nicknames((r.given_name, r.short_form) for r in rows)
    forms = materialise(name_forms(entities), "names")
    links = materialise(link_forms(forms, nick), "links")
    sure = connected_components(links.where("grade = 2"), "a", "b")
    nodes = forms.select(F.col("form").alias("node")).distinct()
    comp = nodes.join(sure, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    weak = links.where("grade = 1")
    for end, name in (("a", "from"), ("b", "to")):
        weak = weak.join(comp.select(F.col("node").alias(end), F.col("component").alias(name)), end)
    # initials that fit several full names stay alone
    fits = weak.where(F.col("from") != F.col("to")).groupBy("from").agg(F.min("to").alias("to"), F.max("to").alias("last"))
    single = materialise(fits.where("to = last").select("from", "to"), "initials")
    top = connected_components(single, "from", "to").select(F.col("node").alias("component"), F.col("component").alias("top"))
    final = comp.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("c"))
    ids = forms.join(final, forms.form == final.node).select("id", "project", "c")
    return ids.join(ids.groupBy("c").agg(F.min("id").alias("group_id")), "c").select("id", "project", "group_id")


def variant_pairs(entities: DataFrame, given_names: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of ids of each linked group."""
    g = materialise(name_groups(entities, given_names), "groups")
    a, b = g.select("group_id", F.col("id").alias("id_a")), g.select("group_id", F.col("id").alias("id_b"))
    return a.join(b, "group_id").where(F.col("id_a") < F.col("id_b")).select("id_a", "id_b")
