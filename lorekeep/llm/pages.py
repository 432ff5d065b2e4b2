"""Words of many texts at once, as numpy arrays over one joined string."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from lorekeep.llm.shingles import mix

BASE = 0x9E3779B97F4A7C15
LETTER, UPPER, LOWER, DIGIT, MARK, BLANK, LINE, JOINER = (1 << k for k in range(8))
#: Between two texts; no word, number or blank run crosses it.
GAP = "\n\x00\n"
_PLAIN = {"ß": "s", "ø": "o", "ł": "l", "æ": "a", "đ": "d"}


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(class bits, folded letter) of every code point of the basic plane."""
    kind, fold = np.zeros(1 << 16, "uint8"), np.arange(1 << 16, dtype="uint32")
    for n in range(1 << 16):
        c = chr(n)
        cat = unicodedata.category(c)
        if cat[0] == "L":
            kind[n] = LETTER | (UPPER if cat in ("Lu", "Lt") else LOWER if cat == "Ll" else 0)
            low = c.lower()
            fold[n] = ord(_PLAIN.get(low[0]) or unicodedata.normalize("NFD", low)[0])
        elif cat == "Nd":
            kind[n] = DIGIT
        elif cat == "Mn":
            kind[n] = MARK
        elif cat == "Zs" or c == "\t":
            kind[n] = BLANK
        elif c in "\n\r\x00\x0b\x0c\x85  ":
            kind[n] = LINE
        elif c in "'-\u2019":
            kind[n] = JOINER
    return kind, fold


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "uint32")


def word_hash(word: str) -> int:
    """The hash that ``Page`` gives a word: letter case and accents do not count."""
    kind, fold = _tables()
    at = np.minimum(_codes(word), 0xFFFF)
    f = fold[at[(kind[at] & MARK) == 0]].astype("uint64") + np.uint64(1)
    return int(mix((f * _powers(len(f))[0][: len(f)]).sum(dtype="uint64", keepdims=True))[0])


def hashes(words) -> np.ndarray:
    return np.array(sorted({word_hash(w) for w in words}), "uint64")


_POWERS = [np.ones(1, "uint64"), np.ones(1, "uint64")]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(n, base, "uint64")
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS


class Page:
    """Texts joined by GAP, with their words.

    A word is a run of letters; apostrophes and hyphens between letters belong to it. ``start`` and ``end`` are
    positions in ``text``; ``hash`` ignores case and accents. ``cap`` marks words with a capital first letter (but
    CamelCase), ``initial`` single capitals, ``lower`` words with a small first letter. Between a word and the next
    one ``blank``, ``comma`` and ``dot`` tell whether there are blanks only, a comma and blanks, a dot and blanks.
    """

    def __init__(self, texts: list[str]):
        self.text = GAP.join(texts) + GAP
        length = np.array([len(t) for t in texts], "int64")
        self.first = np.concatenate(([0], np.cumsum(length + len(GAP))[:-1])) if len(texts) else np.zeros(0, "int64")
        self.last = self.first + length
        kind, fold = _tables()
        at = np.minimum(_codes(self.text), 0xFFFF)
        self.codes, self.kind = at, kind[at]
        k = self.kind
        n = len(at)
        letter = (k & (LETTER | MARK)) > 0
        joiner = (k & JOINER) > 0
        joiner[1:-1] &= letter[:-2] & letter[2:]
        inside = np.zeros(n + 1, bool)
        np.logical_or(letter, joiner, out=inside[1:])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        # marks take no place in a hash
        plain = (k & MARK) == 0
        a, b, of = self.start, self.end, at
        if not plain.all():
            place = np.concatenate(([0], np.cumsum(plain)))
            a, b, of = place[a], place[b], at[plain]
        power, inverse = _powers(len(of) + 1)
        total = np.zeros(len(of) + 1, "uint64")
        np.cumsum((fold[of] + np.uint64(1)) * power[: len(of)], out=total[1:])
        self.hash = mix((total[b] - total[a]) * inverse[a])
        self.size = self.end - self.start
        firsts = k[self.start]
        upper, parts, single = (firsts & UPPER) > 0, self._inside(joiner), self.size == 1
        self.uppers = self._inside((k & UPPER) > 0)
        self.all_upper = upper & (self.uppers >= self.size - parts) & ~single
        self.initial = upper & single
        self.cap = upper & ~single & ((self.uppers <= 1 + parts) | self.all_upper)
        self.lower = (firsts & LOWER) > 0
        m = max(len(self.start) - 1, 0)
        stop, gap = self.end[:m], np.zeros(m, "int64")
        if m:
            dark = (k & BLANK) == 0
            gap = np.add.reduceat(dark, np.stack([stop, self.start[1:]], 1).ravel(), dtype="int64")[::2]
        sign, none = at[stop], np.zeros(len(self.start) - m, bool)
        self.blank = np.append(gap == 0, none)
        self.comma = np.append((gap == 1) & (sign == ord(",")), none)
        self.dot = np.append((gap == 1) & (sign == ord(".")), none)

    def _inside(self, mask: np.ndarray) -> np.ndarray:
        """How many signs of a mask each word has."""
        if not len(self.start):
            return np.zeros(0, "int64")
        ends = np.stack([self.start, self.end], 1).ravel()
        return np.add.reduceat(mask, ends, dtype="int64")[::2]  # the text ends behind the last word

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """Index of the text that holds a position."""
        return np.searchsorted(self.first, at, "right") - 1
