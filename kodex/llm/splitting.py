"""Cut long texts at natural boundaries into overlapping pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kodex.llm.tokens import BYTES, FOLDER, prefix
from kodex.session import widened

LIMIT, OVERLAP = 2048, 128
# What ends a sentence and a clause, and what may follow it at once.
SENTENCE, CLAUSE, CLOSING = (np.array([ord(c) for c in x], np.uint32) for x in (".!?…", ";:,", "\"'“”»)]"))
SPACES = np.array([c for c in range(0x10000) if chr(c).isspace()], np.uint32)
#: No hard cut before these: combining marks, joiners, variation selectors; nor within \r\n.
CLINGING = re.compile(r"[̀-ͯ᪰-᫿⃐-⃿‍︀-️]|(?<=\r)\n")


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted places to cut, the best kind first: after a blank line, a line, a sentence, a clause, a word.

    Each is the start of a word, so that white space stays with the piece before it.
    """
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.isin(cp, SPACES)
    at = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    last = np.maximum.accumulate(np.where(space, 0, np.arange(len(cp))))[at - 1]
    lines = np.cumsum(cp == 10)
    breaks = lines[at - 1] - lines[last]
    end = cp[np.where(np.isin(cp[last], CLOSING), np.maximum(last - 1, 0), last)]
    kind = np.select([breaks > 1, breaks == 1, np.isin(end, SENTENCE), np.isin(end, CLAUSE)], [0, 1, 2, 3], 4)
    return [at[kind == k] for k in range(5)]


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = BYTES, folder: str = FOLDER) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece, in characters.

    Prefix sums give each position's token offset. A piece ends at the last of the best kind of boundary that leaves it at
    least half full and within the limit, found by binary search; failing all, at the last position within the limit. The
    next piece starts `overlap` tokens before that, or up to three more where that would fall within a character.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    sums, free = prefix(text, tokenizer, folder)
    total = int(sums[-1])
    if total <= limit:
        return [(0, len(text), total)] if text else []
    allowed = np.zeros(len(text) + 1, bool)
    allowed[free] = True
    allowed[[m.start() for m in CLINGING.finditer(text)]] = False
    places = [p[allowed[p]] for p in boundaries(text)] + [np.flatnonzero(allowed), free]
    # each kind of place with its token offsets, the hard cuts last
    levels = [(p, sums[p]) for p in places]
    free_sums = levels[-1][1]
    out, start = [], 0
    while True:
        base = int(sums[start])
        if total - base <= limit:
            out.append((start, len(text), total - base))
            return out
        half = base + limit // 2
        for at, offsets in levels:
            i = np.searchsorted(offsets, base + limit, "right") - 1
            if i >= 0 and offsets[i] > half:
                end = int(at[i])
                break
        else:  # one token run of several characters fills more than half: cut after what fits
            end = int(free[max(np.searchsorted(free_sums, base + limit, "right") - 1, np.searchsorted(free, start, "right"))])
        out.append((start, end, int(sums[end]) - base))
        if end == len(text):
            return out
        back, after = np.searchsorted(free_sums, sums[end] - overlap, "right") - 1, np.searchsorted(free, start, "right")
        start = int(free[max(back, after)])


def pieces(documents: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = BYTES, folder: str = FOLDER, oversized_only: bool = False, with_text: bool = True) -> DataFrame:
    """(key, piece_no, char_start, char_end, n_tokens[, piece]); pieces of a text are numbered from 0.

    A text within the limit is one piece (none with oversized_only); an empty or null text, or a
    row without a key, gives none. Sizes are counted in
    the tokens of the whole text. Map-only: no shuffle but of a table too small to fill the cores by its own splits, one row at a time, whole texts.
    """
    schema = f"{key} {dict(documents.dtypes)[key]}, piece_no int, char_start int, char_end int, n_tokens int" + ", piece string" * with_text
    rows = documents.filter(F.col(key).isNotNull()).select(key, F.col(text).alias("_text"))
    # no byte-level tokenizer has more tokens than the text has bytes
    rows = rows.filter(F.octet_length("_text") > (limit if oversized_only else 0))

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = []
            for k, t in zip(pdf[key].tolist(), pdf["_text"].tolist()):
                got = cuts(t, limit, overlap, tokenizer, folder)
                if len(got) > oversized_only:
                    found += [(k, i, a, b, n) + ((t[a:b],) if with_text else ()) for i, (a, b, n) in enumerate(got)]
            yield pd.DataFrame(found, columns=[key, "piece_no", "char_start", "char_end", "n_tokens"] + ["piece"] * with_text)

    return widened(rows).mapInPandas(batches, schema)
