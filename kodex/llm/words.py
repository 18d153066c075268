"""Text as numpy arrays: folded code points, words, 64-bit rolling word hashes, k-grams and winnowing."""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import groupby

import numpy as np

MARK = np.uint32(0xFFFFFFFF)
#: Characters handled at a time, so that a worker's arrays stay small.
SLICE_CHARS = 2_000_000
#: Odd multipliers of the rolling hashes (the 64-bit golden ratio and two splitmix constants).
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@cache
def fold_table() -> np.ndarray:
    """Per code point: its letter or digit without case and diacritics, MARK for a combining mark, 0 for all else."""
    table = np.zeros(0x110000, np.uint32)
    for c in [*range(0xD800), *range(0xE000, 0x32400), *range(0xE0100, 0xE01F0)]:
        ch = chr(c)
        kind = unicodedata.category(ch)[0]
        if kind == "M":
            table[c] = MARK
        elif kind in "LN":
            base = [x for x in unicodedata.normalize("NFKD", ch.casefold()) if unicodedata.category(x)[0] != "M"]
            table[c] = ord(base[0]) if len(base) == 1 else c
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Spread bits (splitmix64's finish)."""
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def slices(texts: list[str]) -> list[tuple[int, int]]:
    """Ranges of texts of about SLICE_CHARS each; a longer text is a range of its own."""
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]) // SLICE_CHARS
    return [(g[0], g[-1] + 1) for g in (list(x) for _, x in groupby(range(len(texts)), key=lambda i: at[i]))]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each followed by a line feed, as one array; where each text starts."""
    cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[:-1]])]).astype(np.int64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word, and for each text the first word's index (with the total at the end).

    A word is an unbroken run of letters and digits; case, diacritics and combining marks are disregarded.
    """
    cp, starts = code_points(texts)
    f = fold_table()[np.minimum(cp, 0x10FFFF)]
    at = np.flatnonzero(f != MARK)
    f = f[at]
    inside = f > 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    counts = np.searchsorted(at[first], np.append(starts, len(cp)))
    if not len(first):
        return np.zeros(0, np.uint64), counts
    lengths = last - first
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(lengths.sum()) - np.repeat(begin, lengths)
    values = mix(f[inside].astype(np.uint64) + M1) * powers(M1, int(lengths.max()))[place]
    return mix(np.add.reduceat(values, begin)), counts


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, in order."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n, p = len(h) - k + 1, powers(M1, k)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += h[j : j + n] * p[j]
    return mix(total)


def winnow(h: np.ndarray, bounds: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes that winnowing keeps: of each `window` consecutive k-grams of one text the least, the last of equals.

    Two texts that share k + window - 1 consecutive words share a kept hash.
    """
    g = kgrams(h, k)
    n = len(g) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, where = g[:n].copy(), np.arange(n)
    for j in range(1, window):
        nearer = g[j : j + n] <= least
        least[nearer] = g[j : j + n][nearer]
        where[nearer] = np.flatnonzero(nearer) + j
    text = np.searchsorted(bounds, np.arange(n), "right")
    whole = np.arange(n) + k + window - 1 <= bounds[np.minimum(text, len(bounds) - 1)]
    kept = np.unique(where[whole])
    return kept, g[kept]
