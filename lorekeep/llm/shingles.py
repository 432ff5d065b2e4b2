"""Word shingles of many texts at once, as numpy arrays inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Multipliers of the rolling word hash and of the three words of a shingle (any odd numbers do).
BASE = 0x9E3779B97F4A7C15
WORDS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Characters handled at once; bounds the arrays to some 100 MB.
SLICE = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True
_POWERS = [np.ones(1, "uint64"), np.ones(1, "uint64")]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(n, base, "uint64")
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS


def text_slices(texts: list) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` with about SLICE characters each; a longer text is alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > SLICE:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def ordered(text: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """Order by text, then by the arrays of ``by`` (a byte array first, if there are two).

    One sort of a packed key does it; the full sort follows only where packed keys tie.
    """
    key = by[-1] >> np.uint64(20 + 8 * (len(by) - 1))
    if len(by) > 1:
        key |= by[0].astype("uint64") << np.uint64(36)
    key |= text.astype("uint64") << np.uint64(44)
    order = np.argsort(key)
    tie = key[order[1:]] == key[order[:-1]]
    if (tie & (by[-1][order[1:]] != by[-1][order[:-1]])).any() or (len(text) and text[-1] >= 1 << 20):
        return np.lexsort((*by[::-1], text))
    return order


def shingles(texts: list, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the distinct three-word shingles of each text, sorted by both.

    Words are maximal runs of a-z0-9 of the lower-cased text; a text's ``keys`` entry (uint64) is
    mixed into its hashes, so that texts of different projects share none.
    """
    flat = pa.array([(t or "").lower() + "\n" for t in texts], pa.large_string())
    ends = np.frombuffer(flat.buffers()[1], "int64")[: len(texts) + 1]
    raw = np.frombuffer(flat.buffers()[2], "uint8")[: ends[-1]]
    word = np.zeros(len(raw) + 1, bool)
    word[1:] = _WORD[raw]
    edge = np.flatnonzero(word[1:] != word[:-1])  # every text ends with a line end, so edges come in pairs
    first, last = edge[::2], edge[1::2]
    power, inverse = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, "uint64")
    np.cumsum((raw.astype("uint64") + np.uint64(1)) * power[: len(raw)], out=total[1:])
    hashed = mix((total[last] - total[first]) * inverse[first])
    text = np.searchsorted(ends, first, "right") - 1
    if len(hashed) < 3:
        return np.zeros(0, "int64"), np.zeros(0, "uint64")
    three = hashed[:-2] * np.uint64(WORDS[0]) + hashed[1:-1] * np.uint64(WORDS[1]) + hashed[2:] * np.uint64(WORDS[2])
    inside = text[:-2] == text[2:]
    text, three = text[:-2][inside], mix(three[inside] ^ keys[text[:-2][inside]])
    order = ordered(text, three)
    text, three = text[order], three[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (three[1:] != three[:-1])
    return text[new], three[new]


def project_keys(projects: list) -> np.ndarray:
    cache = {p: xxhash.xxh64_intdigest(p or "") for p in set(projects)}
    return np.array([cache[p] for p in projects], "uint64")
