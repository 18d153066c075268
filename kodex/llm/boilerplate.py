"""Lines that recur across one court's decisions, found by content-defined chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kodex.llm.words import M1, M2, code_points, mix, powers, slices
from kodex.session import lookup, stage, widened

#: A line recurs if so many decisions of its court, and this share of them, hold it.
LEAST_DOCUMENTS, LEAST_SHARE = 4, 0.05
#: Characters the rolling hash looks at, and the mean length of a chunk between two of its cuts.
WINDOW, MEAN_CHUNK = 12, 64


def line_form(text: Column) -> Column:
    """A text's lines as they are compared: lower case, digit runs as 0, runs of spaces and tabs as one space, none at the ends."""
    text = F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{Nd}+", "0"), r"[ \t]+", " ")
    return F.regexp_replace(text, r"(?m)(?:^ | $)", "")


def flat_form(text: Column) -> Column:
    """A text as it is compared wherever its lines break: as line_form, line breaks being spaces too."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{Nd}+", "0"), r"\s+", " "))


def chunk(texts: list[str], window: int = WINDOW, mean: int = MEAN_CHUNK) -> tuple[np.ndarray, ...]:
    """(text, line, place, hash) of each chunk; line is 0-based, place that of the chunk in its line."""
    return sized_chunks(texts, window, mean)[:4]


def sized_chunks(texts: list[str], window: int = WINDOW, mean: int = MEAN_CHUNK) -> tuple[np.ndarray, ...]:
    """chunk with the length of each chunk in characters.

    A chunk ends where the hash that rolls over the last `window` characters is 0 modulo `mean`, or with its line; the
    window stays within its line, so that a line has the same chunks wherever it stands. Blank lines have no chunk.
    """
    cp, starts = code_points(texts)
    values = mix(cp.astype(np.uint64) + M1)
    p = powers(M2, window)
    rolled = values * p[0]
    for j in range(1, window):
        rolled[j:] += values[:-j] * p[j]
    newline = cp == 10
    at = np.arange(len(cp))
    head = np.maximum.accumulate(np.where(np.concatenate([[True], newline[:-1]]), at, 0))
    # the window must lie within its line
    end = ((mix(rolled) % np.uint64(mean) == 0) & (at - head >= window - 1)) | newline
    ends = np.flatnonzero(end)
    # characters of chunks, their line feed left out
    begin = np.concatenate([[0], ends[:-1] + 1])
    stop = ends + ~newline[ends]
    full = stop > begin
    line_of = np.concatenate([[0], np.cumsum(newline)])
    begin, stop = begin[full], stop[full]
    if not len(begin):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    lengths = stop - begin
    inside = np.repeat(begin - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    place = inside - np.repeat(begin, lengths)
    h = mix(np.add.reduceat(values[inside] * powers(M1, int(lengths.max()))[place], np.concatenate([[0], np.cumsum(lengths)[:-1]])))
    text = np.searchsorted(starts, begin, "right") - 1
    line = line_of[begin] - line_of[starts[text]]
    first = np.concatenate([[True], (text[1:] != text[:-1]) | (line[1:] != line[:-1])])
    order = np.arange(len(first))
    return text, line, order - np.maximum.accumulate(np.where(first, order, 0)), h, lengths


def chunked_lines(rows: DataFrame, key: str, text: str, window: int = WINDOW, mean: int = MEAN_CHUNK, form: Callable[[Column], Column] = line_form) -> DataFrame:
    """(key, line_no, line_hash, chunks array<long>, ends array<int>) of every line that isn't blank; line_no is 1-based, null texts have none.

    ends says where each chunk ends within the line, in characters of its form. With flat_form a text is one line.
    """

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts, keys = pdf["_text"].tolist(), pdf[key].to_numpy()
            for a, b in slices(texts):
                of, line, place, h, size = sized_chunks(texts[a:b], window, mean)
                at = np.flatnonzero(place == 0)
                if len(at):
                    # a line's hash is made of its chunks' hashes in order
                    whole = np.add.reduceat(h * powers(M1, int(place.max()) + 1)[place], at)
                    yield pd.DataFrame({key: keys[a:b][of[at]], "line_no": (line[at] + 1).astype(np.int32), "line_hash": mix(whole).view(np.int64), "chunks": np.split(h.view(np.int64), at[1:]), "ends": [np.cumsum(x) for x in np.split(size.astype(np.int32), at[1:])]})

    lines = rows.filter(F.col(text).isNotNull()).select(key, form(F.col(text)).alias("_text"))
    return lines.mapInPandas(batches, f"{key} {dict(rows.dtypes)[key]}, line_no int, line_hash long, chunks array<long>, ends array<int>")


def recurring(counted: DataFrame, group: str, what: str, totals: DataFrame, least: int, share: float) -> DataFrame:
    """(group, what, documents) of what is in at least `least` documents of its group and in that share of them."""
    sums = counted.groupBy(group, what).agg(F.count("*").alias("documents")).filter(F.col("documents") >= least)
    return lookup(sums, totals, [group]).filter(F.col("documents") >= F.lit(share) * F.col("total")).select(group, what, "documents")


def _courts(paragraphs: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc, court_code) of every decision that has paragraphs, (court_code, total)), both staged; doc stands for ecli."""
    courts = decisions.filter("court_code is not null").groupBy("ecli").agg(F.max("court_code").alias("court_code"))
    holders = paragraphs.filter("ecli is not null").groupBy("ecli").count().select("ecli").join(courts, "ecli")
    numbered = stage(holders.select(F.xxhash64("ecli").alias("doc"), "court_code"))
    return numbered, stage(numbered.groupBy("court_code").agg(F.count("*").alias("total")))


def _lines(paragraphs: DataFrame, mean: int, form: Callable[[Column], Column] = line_form) -> DataFrame:
    """(para_id, doc, line_no, line_hash, chunks, ends) of every line, staged."""
    rows = paragraphs.filter("ecli is not null").select("body", F.struct("para_id", F.xxhash64("ecli").alias("doc")).alias("_key"))
    found = chunked_lines(widened(rows), "_key", "body", mean=mean, form=form)
    # ends are for cutting by chunks alone
    return stage(found.select("_key.*", "line_no", "line_hash", "chunks", *(["ends"] if form is flat_form else [])))


def _recurring_chunks(lines: DataFrame, numbered: DataFrame, totals: DataFrame, least: int, share: float) -> DataFrame:
    seen = lines.select("doc", F.explode("chunks").alias("chunk")).distinct()
    return recurring(lookup(seen, numbered, ["doc"]), "court_code", "chunk", totals, least, share)


def recurring_chunks(paragraphs: DataFrame, decisions: DataFrame, least: int = LEAST_DOCUMENTS, share: float = LEAST_SHARE, mean: int = MEAN_CHUNK) -> DataFrame:
    """(court_code, chunk, documents) of every content-defined chunk of whole texts that recurs in its court, by the chunk's hash.

    Chunks know no lines: a notice that is wrapped otherwise has the same ones.
    """
    numbered, totals = _courts(paragraphs, decisions)
    return _recurring_chunks(_lines(paragraphs, mean, flat_form), numbered, totals, least, share)


def without_chunks(paragraphs: DataFrame, decisions: DataFrame, least: int = LEAST_DOCUMENTS, share: float = LEAST_SHARE, mean: int = MEAN_CHUNK) -> DataFrame:
    """(para_id, chunks, cut, kept) of every paragraph of a court: its number of chunks, of those that recur, and its flat_form without them.

    A recurring chunk of fewer than WINDOW characters, which texts may share by chance, goes only beside a longer one. A blank text has no chunk; null bodies and paragraphs without a decision or court give no row.
    """
    numbered, totals = _courts(paragraphs, decisions)
    texts = _lines(paragraphs, mean, flat_form)
    hot = stage(_recurring_chunks(texts, numbered, totals, least, share).select("court_code", "chunk"))
    held = lookup(texts.select("para_id", "doc", F.posexplode("chunks").alias("place", "chunk")), numbered, ["doc"])
    cut = stage(lookup(held, hot, ["court_code", "chunk"], "left_semi").groupBy("para_id").agg(F.collect_set("place").alias("_cut")))
    known = lookup(paragraphs.filter("ecli is not null and body is not null").select("para_id", F.xxhash64("ecli").alias("doc"), flat_form(F.col("body")).alias("_text")), numbered.select("doc").distinct(), ["doc"], "left_semi")
    rows = known.join(texts.select("para_id", "doc", "ends"), ["para_id", "doc"], "left").join(cut, "para_id", "left")
    none = F.array().cast("array<int>")
    rows = rows.select("para_id", "_text", F.coalesce("ends", none).alias("_ends"), F.coalesce("_cut", none).alias("_cut"))
    begin = lambda i: F.when(i > 0, F.get("_ends", i - 1)).otherwise(0)
    long = lambda i: F.array_contains("_cut", i) & (F.get("_ends", i) - begin(i) >= WINDOW)
    goes = lambda i: F.array_contains("_cut", i) & (long(i) | long(i - 1) | long(i + 1))
    rows = rows.withColumn("_goes", F.transform("_ends", lambda e, i: F.coalesce(goes(i), F.lit(False))))
    pieces = F.transform("_ends", lambda e, i: F.when(F.get("_goes", i), "").otherwise(F.substring(F.col("_text"), begin(i) + 1, e - begin(i))))
    return rows.select("para_id", F.size("_ends").alias("chunks"), F.size(F.filter("_goes", lambda g: g)).alias("cut"), F.array_join(pieces, "").alias("kept"))


def recurring_lines(paragraphs: DataFrame, decisions: DataFrame, least: int = LEAST_DOCUMENTS, share: float = LEAST_SHARE, mean: int = MEAN_CHUNK) -> DataFrame:
    """(para_id, line_no, court_code, line_hash, documents) of every line that recurs in its court.

    Chunks first: distinct decisions are counted per court and chunk; a line that recurs has only recurring chunks, so
    lines with another are out. The lines that stay are then counted themselves, which makes the result exact (up to
    equal 64-bit hashes). Counts are of distinct ecli, made distinct before they are shuffled, so that one decision with
    a large part of all rows weighs as one. Paragraphs without a decision or court belong to no court; null bodies have
    no lines; repeated rows change no count. Totals hold one row per court.
    """
    numbered, totals = _courts(paragraphs, decisions)
    lines = _lines(paragraphs, mean)
    hot = stage(_recurring_chunks(lines, numbered, totals, least, share).select("court_code", "chunk"))
    at_court = lines.select("para_id", "doc", "line_no", "line_hash", F.col("chunks")[0].alias("chunk"), "chunks")
    candidates = lookup(lookup(at_court, numbered, ["doc"]), hot, ["court_code", "chunk"], "left_semi")
    rest = candidates.select("court_code", "line_hash", F.explode(F.array_distinct("chunks")).alias("chunk")).distinct()
    dead = stage(lookup(rest, hot, ["court_code", "chunk"], "left_anti").select("court_code", "line_hash").distinct())
    alive = stage(lookup(candidates.drop("chunk", "chunks"), dead, ["court_code", "line_hash"], "left_anti"))
    found = stage(recurring(alive.select("court_code", "line_hash", "doc").distinct(), "court_code", "line_hash", totals, least, share))
    return lookup(alive, found, ["court_code", "line_hash"]).select("para_id", "line_no", "court_code", "line_hash", "documents")


def line_texts(found: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(court_code, line, documents, occurrences) of each recurring line, as its first occurrence by para_id says it."""
    first = found.groupBy("court_code", "line_hash").agg(F.max("documents").alias("documents"), F.count("*").alias("occurrences"), F.min(F.struct("para_id", "line_no")).alias("_f"))
    first = stage(first.select("court_code", "documents", "occurrences", "_f.*"))
    bodies = lookup(paragraphs.select("para_id", "body"), first, ["para_id"])
    return bodies.select("court_code", F.get(F.split("body", "\n"), F.col("line_no") - 1).alias("line"), "documents", "occurrences")


def without_lines(found: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(para_id, body) of every paragraph, its recurring lines cut out; a body of nothing else is empty, a null one null."""
    cut = stage(found.groupBy("para_id").agg(F.collect_set("line_no").alias("_cut")))
    rows = lookup(paragraphs.select("para_id", "body"), cut, ["para_id"], "left")
    kept = F.filter(F.split("body", "\n"), lambda line, i: ~F.array_contains("_cut", i + 1))
    return rows.select("para_id", F.when(F.col("_cut").isNull(), F.col("body")).otherwise(F.array_join(kept, "\n")).alias("body"))
