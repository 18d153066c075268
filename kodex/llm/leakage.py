"""Evaluation passages in training text, by winnowed fingerprints and extension of the hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kodex.llm.words import slices, winnow, word_hashes
from kodex.session import is_small, lookup, sized_broadcast, stage, widened

#: A shared run of this many words is a leak.
RUN_WORDS = 16
#: Words in a fingerprinted k-gram. RUN_WORDS - K + 1 k-grams make a window.
K = 8


def fingerprints(texts: DataFrame, key: str, text: str, run: int = RUN_WORDS, k: int = K) -> DataFrame:
    """(key, pos, h): the winnowed k-grams of each text; null keys, null texts and texts shorter than `run` words give none."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts_, keys = pdf["_text"].tolist(), pdf["_key"].to_numpy()
            for a, b in slices(texts_):
                h, bounds = word_hashes(texts_[a:b])
                at, g = winnow(h, bounds, k, run - k + 1)
                of = np.searchsorted(bounds, at, "right") - 1
                yield pd.DataFrame({"_key": keys[a:b][of], "pos": (at - bounds[of]).astype(np.int32), "h": g.view(np.int64)})

    rows = texts.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return widened(rows).mapInPandas(batches, f"_key {dict(texts.dtypes)[key]}, pos int, h long").withColumnRenamed("_key", key)


def _runs(pdf: pd.DataFrame, run: int) -> pd.DataFrame:
    """The longest-possible shared runs of at least `run` words of each row's texts, along the diagonals of its hits."""
    docs, doc_at = word_hashes(pdf["_text"].tolist())
    items, item_at = word_hashes(pdf["_item"].tolist())
    out = []
    for i, (doc, item, diagonals) in enumerate(zip(pdf["doc_id"].tolist(), pdf["item_id"].tolist(), pdf["diagonals"])):
        a, b = docs[doc_at[i] : doc_at[i + 1]], items[item_at[i] : item_at[i + 1]]
        for d in sorted({int(x) for x in diagonals}):
            lo, hi = max(0, -d), min(len(b), len(a) - d)
            same = np.concatenate([[False], a[lo + d : hi + d] == b[lo:hi], [False]])
            edge = np.flatnonzero(same[1:] != same[:-1])
            first, length = edge[::2], edge[1::2] - edge[::2]
            long = length >= run
            out += [(doc, item, n, lo + d + f, lo + f) for n, f in zip(length[long].tolist(), first[long].tolist())]
    return pd.DataFrame(out, columns=["doc_id", "item_id", "words", "doc_word", "item_word"])


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN_WORDS, k: int = K) -> DataFrame:
    """(doc_id, item_id, words, doc_word, item_word): every run of at least `run` words that a document shares with an item.

    Runs can't be made longer at either end; doc_word and item_word are the places of their first words, from 0. Winnowing
    keeps a fingerprint of every shared run of `run` words, so none is missed. The items' fingerprints are broadcast if
    they are small, else joined by a shuffle; a hit is then extended word by word. Repeated texts each count; null texts
    and rows without an id never match. Other columns are not looked at.
    """
    tests = stage(fingerprints(items, "item_id", "text", run, k).withColumnRenamed("pos", "item_pos"))
    prints = fingerprints(documents, "doc_id", "text", run, k)
    if not is_small(tests):
        # hot fingerprints are counted, which must not read the texts twice
        prints = stage(prints)
    found = lookup(prints, tests, ["h"])
    hits = stage(found.select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct().groupBy("doc_id", "item_id").agg(F.collect_list("diagonal").alias("diagonals")))
    pairs = documents.select("doc_id", F.col("text").alias("_text")).join(sized_broadcast(hits), "doc_id")
    pairs = lookup(pairs, stage(items.filter("item_id is not null").select("item_id", F.col("text").alias("_item"))), ["item_id"], counted=hits)

    def verify(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for a, b in slices(pdf["_text"].tolist()):
                yield _runs(pdf.iloc[a:b], run)

    columns = pairs.select("doc_id", "item_id", "diagonals", "_text", "_item")
    return columns.mapInPandas(verify, "doc_id long, item_id long, words int, doc_word int, item_word int")
