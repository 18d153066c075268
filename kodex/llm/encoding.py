"""Text decoded with the wrong character encoding: found and restored through the garbled forms of the corpus's own words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kodex.session import is_small, lookup, sized_broadcast, stage

#: Encodings in which Central European text is stored, and those with which it is read by mistake.
STORED = ("utf-8", "cp1250", "iso8859_2", "cp852", "mac_latin2")
READ_AS = ("cp1252", "latin_1", "cp1250", "iso8859_2", "cp852", "mac_latin2", "mac_roman", "cp437")
#: Second misreadings, of text that was already misread once and stored again as UTF-8.
AGAIN = ("cp1252", "latin_1", "cp1250", "iso8859_2")
#: Characters that are often lost after a misreading: controls and the soft hyphen.
LOST = dict.fromkeys([*range(0x80, 0xA0), 0xAD])
#: Letters of the corpus's own language; a token with any other character outside ASCII may be garbled.
OWN = "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ"
#: A token: ASCII letters, digits and everything beyond ASCII, as no misreading turns a letter into ASCII punctuation.
TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
ODD = rf"[\x{{80}}-\x{{10FFFF}}&&[^{OWN}]]"
#: A row without this has no token of two or more characters that may be garbled: a section sign by itself isn't one.
ODD_ROW = rf"[\x{{80}}-\x{{10FFFF}}&&[^{OWN}§]]|§(?:[^\x00-\x2F]|(?<=[^\x00-\x2F]§))"
#: Characters that no clean word has: control and format characters, odd spaces, combining marks, the replacement character.
UNCLEAN = r"[\x{80}-\x{A0}\x{AD}\x{FFFD}\p{M}\p{Cf}\p{Z}]"
#: Of several originals of one garbled form, one is taken if it is so many times as frequent as any other.
CLEAR = 20


@cache
def _reading(name: str) -> tuple[str, ...]:
    """The character of each byte; a byte without one stays as the control character of that number."""
    return tuple(bytes([b]).decode(name, "ignore") or chr(b) for b in range(256))


@cache
def _unreading(name: str) -> dict[str, int]:
    return {ch: b for b, ch in enumerate(_reading(name))}


def misread(data: bytes, name: str) -> str:
    table = _reading(name)
    return "".join([table[b] for b in data])


def chains() -> list[tuple[str, ...]]:
    """Each chain: stored as, read as[, stored again as UTF-8 and read as]; the reading utf-8 replaces what it can't decode."""
    single = [(s, r) for s in STORED for r in (*READ_AS, "utf-8") if s != r]
    return [*single, ("utf-8", "ascii"), *(("utf-8", r, "utf-8", a) for r in AGAIN for a in AGAIN)]


@cache
def _tables() -> list[tuple[str, bool, dict[int, str]]]:
    """(chain, stored as UTF-8, what becomes of each character beyond ASCII) of the chains that turn characters one by one.

    These are all but the readings as UTF-8. A character that an encoding lacks becomes NUL.
    """
    out = []
    letters = [chr(c) for c in (*range(0xA0, 0x250), *range(0x370, 0x460), *range(0x2010, 0x2040), 0x20AC, 0x2122)]
    for chain in chains():
        if chain[1] == "utf-8":
            continue
        table = {}
        for ch in letters:
            form = ch
            try:
                for stored, read in zip(chain[::2], chain[1::2]):
                    data = form.encode(stored)
                    form = data.decode(read, "replace") if read == "ascii" else misread(data, read)
            except UnicodeEncodeError:
                form = "\0"
            table[ord(ch)] = form
        out.append((">".join(chain), chain[0] == "utf-8", table))
    return out


def garblings(word: str) -> Iterator[tuple[str, str]]:
    """(form, chain) of every chain, for those that leave characters that are often LOST also without these.

    Words that an encoding lacks have no form in it; a form is no word of one character, but for the replacement one.
    """
    for stored in STORED[1:]:
        try:
            form = word.encode(stored).decode("utf-8", "replace")
        except UnicodeEncodeError:
            continue
        if form != word and (len(form) > 1 or form == "\ufffd"):
            yield form, f"{stored}>utf-8"
    for chain, wide, table in _tables():
        form = word.translate(table)
        if "\0" in form or form == word:
            continue
        if len(form) > 1:
            yield form, chain
        if wide and (bare := form.translate(LOST)) not in (form, word) and len(bare) > 1 and not bare.isascii():
            yield bare, chain


def garble(word: str) -> dict[str, str]:
    """Each garbled form of a word, with the first chain that gives it."""
    return dict(reversed(list(garblings(word))))


def ungarble(form: str, chain: str) -> str | None:
    """The word that a chain turned into form, or none if the chain loses characters or can't have made it."""
    steps = chain.split(">")
    try:
        for stored, read in reversed(list(zip(steps[::2], steps[1::2]))):
            if read in ("utf-8", "ascii"):
                return None
            table = _unreading(read)
            form = bytes([table[ch] for ch in form]).decode(stored)
    except (KeyError, UnicodeDecodeError):
        return None
    return form


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def vocabulary(rows: DataFrame) -> DataFrame:
    """(token, n): every distinct token that has a character beyond ASCII, with its count over the distinct values of `text`."""
    # copies share the weight 1, so that no text has to be shuffled to leave the others out
    copies = stage(rows.groupBy(F.xxhash64("text").alias("_h")).agg(F.count("*").alias("_copies")).filter("_copies > 1"))
    texts = lookup(rows.select("text", F.xxhash64("text").alias("_h")), copies, ["_h"], "left")
    # explode_outer, as a plain explode is preceded by a filter that splits every text a second time
    words = texts.select("_copies", F.explode_outer(F.filter(tokens(F.col("text")), lambda t: F.length(t) != F.octet_length(t))).alias("token"))
    per = words.filter("token is not null").groupBy("token", F.coalesce("_copies", F.lit(1)).alias("_copies")).agg(F.count("*").alias("n"))
    # whole numbers: each copy of a text adds as much
    return per.groupBy("token").agg(F.sum(F.expr("n div _copies")).alias("n"))


def skeleton(token: Column) -> Column:
    """A token's ASCII characters in order, which every chain keeps."""
    return F.regexp_replace(token, r"[^\x00-\x7F]+", "")


def garbled_forms(words: DataFrame, every_chain: bool = False) -> DataFrame:
    """(token, original, chain, n_original, seen): the garbled forms of (original, n_original, seen), each with one chain or all."""
    columns = ["token", "original", "chain", "n_original", "seen"]

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for word, n, seen in zip(pdf["original"], pdf["n_original"], pdf["seen"]):
                out += [(form, word, chain, n, seen) for form, chain in (garblings(word) if every_chain else garble(word).items())]
                if len(out) > 100_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    return words.select("original", "n_original", "seen").mapInPandas(batches, "token string, original string, chain string, n_original long, seen boolean")


def dictionary(vocab: DataFrame) -> DataFrame:
    """(token, original, chain, how): the corpus tokens that are garbled forms of its own clean words (how: word), or made of such parts (how: parts).

    Clean words also count with their first letter in the other case. Only those with the skeleton of some suspect token
    are garbled, as the forms of the others can't match. Verified: the clean word must be at least as frequent as the
    garbled form, so that a correct foreign word isn't taken for the garbled form of some rarity. original is null where
    several words have the form and none is clearly the one, and where only the parts of a word are known (by_runs).
    """
    parts = int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    suspects = stage(vocab.filter(F.col("token").rlike(ODD) & (F.length("token") > 1)).withColumn("skeleton", skeleton(F.col("token"))))
    first, rest = F.left("token", F.lit(1)), F.substr("token", F.lit(2))
    cases = F.array_distinct(F.array("token", F.concat(F.lower(first), rest), F.concat(F.upper(first), rest)))
    clean = vocab.filter(~F.col("token").rlike(UNCLEAN)).select("token", F.col("n").alias("n_original"), F.explode(cases).alias("original"))
    clean = clean.withColumn("seen", F.col("token") == F.col("original")).withColumn("skeleton", skeleton(F.col("original")))
    clean = lookup(clean, stage(suspects.select("skeleton").distinct()), ["skeleton"], "left_semi").repartition(parts, "original")
    forms = garbled_forms(clean)
    # where the suspects are few, the forms are matched as they are made, without a shuffle; else they are written once, as
    # the forms that very many words share, such as the replacement character, have to be counted and split
    pairs = lookup(forms if is_small(suspects) else stage(forms), suspects, ["token"]).filter(F.col("n_original") >= F.col("n"))
    pairs = pairs.groupBy("token", "original").agg(F.max("seen").alias("seen"), F.max("n_original").alias("n"), F.min("chain").alias("chain"))
    per = pairs.groupBy("token").agg(F.max(F.struct("seen", "n", "original", "chain")).alias("best"), F.sum(F.when(F.col("seen"), F.col("n"))).alias("_seen"), F.sum("n").alias("_all"))
    others = F.when(F.col("best.seen"), F.col("_seen")).otherwise(F.col("_all")) - F.col("best.n")
    clear = F.col("best.n") >= CLEAR * others
    found = stage(per.select("token", F.when(clear, F.col("best.original")).alias("original"), F.col("best.chain").alias("chain"), F.lit("word").alias("how")))
    return found.unionByName(by_runs(suspects.join(sized_broadcast(found), "token", "left_anti"), vocab))


def by_runs(suspects: DataFrame, vocab: DataFrame) -> DataFrame:
    """(token, original null, chain, how) of suspects without a clean twin, such as rare names, by their parts beyond ASCII.

    Such a token is garbled if under one chain each of its parts is a garbled form of a part of the corpus's own words.
    Only forms that can't be letters by themselves count: of UTF-8, in several characters, or with replaced bytes.
    """
    runs = lambda c: F.regexp_extract_all(c, F.lit(r"[^\x00-\x7F]+"), F.lit(0))
    own = vocab.filter(F.col("token").rlike(rf"^[0-9A-Za-z{OWN}]+$")).select("n", F.explode(runs(F.col("token"))).alias("original"))
    own = own.groupBy("original").agg(F.sum("n").alias("n_original")).withColumn("seen", F.lit(True))
    forms = stage(garbled_forms(own, every_chain=True).filter(F.col("chain").startswith("utf-8") | F.col("token").contains("\ufffd")).groupBy(F.col("token").alias("run"), "chain").agg(F.max("n_original").alias("n_original")))
    parts = suspects.select("token", "n", F.array_distinct(runs(F.col("token"))).alias("_r")).withColumn("parts", F.size("_r")).select("token", "n", "parts", F.explode("_r").alias("run"))
    hits = lookup(parts, forms, ["run"]).filter(F.col("n_original") >= F.col("n")).groupBy("token", "parts", "chain").agg(F.count("*").alias("_n")).filter("_n = parts")
    return hits.groupBy("token").agg(F.min("chain").alias("chain")).select("token", F.lit(None).cast("string").alias("original"), "chain", F.lit("parts").alias("how"))


def suspect_tokens(rows: DataFrame) -> DataFrame:
    """(keys of rows, token): the distinct tokens of each row that may be garbled."""
    odd = rows.filter(F.col("text").rlike(ODD_ROW))
    found = F.array_distinct(F.filter(tokens(F.col("text")), lambda t: t.rlike(ODD) & (F.length(t) > 1)))
    return odd.select(*[c for c in rows.columns if c != "text"], F.explode_outer(found).alias("token"))


def garbled_rows(rows: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """(table_name, row_id, words array<struct<token, original, chain, how>>) of each row of (table_name, row_id, text) with garbled words.

    `corpus` gives the clean words; it is `rows` itself by default. Null and empty texts hold no words; repeated rows
    of one id give one row, rows without an id none. Other columns are not looked at. Tokens are counted before the
    shuffle; the dictionary is broadcast if small, else joined.
    """
    rows = rows.select("table_name", "row_id", "text").filter("row_id is not null")
    words = stage(dictionary(stage(vocabulary(rows if corpus is None else corpus))))
    hits = lookup(suspect_tokens(rows), words, ["token"]).distinct()
    return hits.groupBy("table_name", "row_id").agg(F.array_sort(F.collect_list(F.struct("token", "original", "chain", "how"))).alias("words"))


def restored(rows: DataFrame) -> DataFrame:
    """(table_name, row_id, text, restored, replaced, left, decoded): each garbled row with its words put right where that is possible.

    replaced counts the words put right, decoded those of them that no verified original gave, left those that stay.

    A word with a verified original gets it. A suspect word that isn't in the dictionary, such as a rare name, is decoded by
    the chains found in the same row, if that gives letters of the corpus's language; else it stays. Words of its letters
    alone may be garbled too: those between two garbled words are decoded if the chain can have made every one of them.
    Texts are handled whole.
    """
    token, odd, own = re.compile("[0-9A-Za-z\x80-\U0010ffff]+"), re.compile(f"[^\x00-\x7f{OWN}]"), re.compile(f"[0-9A-Za-z{OWN}„“‚‘–…§°]+")

    def decode(t: str, tried: list[str]) -> str | None:
        return next((w for chain in tried if (w := ungarble(t, chain)) and own.fullmatch(w)), None)

    def restore(text: str, words: list) -> tuple[str, int, int, int]:
        known, tried = {w["token"]: w["original"] for w in words}, sorted({w["chain"] for w in words})
        found = [m for m in token.finditer(text) if not m.group().isascii()]
        put: list[str | None] = [None] * len(found)
        before, left = None, 0
        for i, m in enumerate(found):
            t = m.group()
            if t not in known and (len(t) < 2 or not odd.search(t)):
                continue
            put[i] = known.get(t) or decode(t, tried)
            left += t in known and put[i] is None
            if put[i] and before is not None:
                between = [decode(found[k].group(), tried) for k in range(before + 1, i)]
                if all(between):
                    put[before + 1 : i] = between
            if put[i]:
                before = i
        out, at = [], 0
        for m, w in zip(found, put):
            if w is not None:
                out += [text[at : m.start()], w]
                at = m.end()
        return "".join([*out, text[at:]]), sum(w is not None for w in put), left, sum(w is not None and w != known.get(m.group()) for m, w in zip(found, put))

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [restore(text, words) for text, words in zip(pdf["text"], pdf["words"])]
            yield pd.concat([pdf.drop(columns="words"), pd.DataFrame(out, columns=["restored", "replaced", "left", "decoded"], index=pdf.index)], axis=1)

    rows = rows.select("table_name", "row_id", "text").filter("row_id is not null")
    found = stage(garbled_rows(rows))
    joined = rows.join(sized_broadcast(found), ["table_name", "row_id"])
    return joined.select("table_name", "row_id", "text", "words").mapInPandas(batches, "table_name string, row_id long, text string, restored string, replaced int, left int, decoded int")
