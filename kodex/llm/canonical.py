"""One form for text that looks the same."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts and the Latin letters that they look like.
LOOK_ALIKES = {
    # Cyrillic
    **dict(zip("асеһіјкӏморԛѕтухѵԝԁ", "acehijklmopqstuxvwd")), "у": "y", "ё": "ë", "ї": "ï", "в": "b", "н": "h", "г": "r", "п": "n", "и": "u", "б": "6", "ү": "y",
    **dict(zip("АВСЕНІЈКМОРЅТХУЅԚԜҮ", "ABCEHIJKMOPSTXYSQWY")), "Ё": "Ë", "Ї": "Ï", "З": "3", "Ӏ": "I",
    # Greek
    **dict(zip("αβγεηικνορστυχω", "abyenikvopotuxw")), "ς": "s",
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX")),
    # Armenian
    **dict(zip("օոսհԼՕ", "onuhLO")),
}
HYPHENS = dict.fromkeys(map(ord, "‐‑−﹣－˗"), "-")
#: Other punctuation that looks like ASCII.
PUNCTUATION = {ord("․"): ".", ord("∕"): "/", ord("∶"): ":", ord("ʼ"): "'", ord("∙"): "·"}
INVISIBLE = re.compile("[\xad͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U000e0000-\U000e0fff]")
WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
# Characters that are ordinary wherever they stand, for the test in the JVM: precomposed Latin letters without compatibility
# ones, and common typographic signs. The range comes first in the test, so that ASCII is decided at once.
SIGNS = "¡-¬®-¶¸-ıĴ-ľŁ-ňŊ-žƀ-ƿǍ-ǰǴ-ɏ‘-‟‒-―†-•…‰‹›€™"
NOT_PLAIN = rf"[\x{{7F}}-\x{{10FFFF}}&&[^{SIGNS}]]|[\x00-\x08\x0B\x0C\x0E-\x1F]"


@cache
def _mapped(ch: str) -> str:
    """One character's ordinary form: compatibility letters, digits, full-width signs and spaces are mapped, signs stay."""
    kind, how = unicodedata.category(ch), unicodedata.decomposition(ch)
    if kind == "Zs":
        return " "
    if kind in ("Zl", "Zp"):
        return "\n"
    if kind == "Nd":
        return str(unicodedata.decimal(ch))
    wide = how.startswith(("<wide>", "<narrow>", "<small>"))
    letter = kind[0] == "L" or kind == "Nl"
    if wide or letter and ch != "µ" and how.startswith(("<compat>", "<font>")):
        return unicodedata.normalize("NFKC", ch)
    return ch


def _latin(m: re.Match) -> str:
    """A word with Latin letters gets Latin ones only; a word wholly in another script stays."""
    w = m.group()
    if w.isascii() or not any(c in LOOK_ALIKES for c in w) or not any("LATIN" in unicodedata.name(c, "") for c in w):
        return w
    return "".join([LOOK_ALIKES.get(c, c) for c in w])


def ordinary(text: str) -> str:
    """Precomposed letters, Latin letters in Latin words, ASCII digits, spaces and hyphens, nothing invisible; case stays.

    Typographic quotes, dashes, ellipses, signs, superscripts, fractions, line breaks and tabs stay as well.
    """
    if text.isascii():
        return text
    text = INVISIBLE.sub("", text).translate(HYPHENS).translate(PUNCTUATION)
    text = "".join([c if c < "\x80" else _mapped(c) for c in text])
    text = WORD.sub(_latin, unicodedata.normalize("NFC", text))
    return unicodedata.normalize("NFC", text)


def comparable(text: str) -> str:
    """The form for comparisons: ordinary, compatibility-composed, fully case-folded, white-space runs as one space."""
    folded = unicodedata.normalize("NFKC", ordinary(text).casefold())
    return " ".join(unicodedata.normalize("NFC", folded).split())


def _per_distinct(values: pd.Series, f) -> pd.Series:
    """f of each distinct value of a batch, once; null stays null."""
    known = {v: f(v) for v in values.unique() if isinstance(v, str)}
    return values.map(known).astype(object).where(values.notna(), None)


@F.pandas_udf(T.StringType())
def _ordinary(values: pd.Series) -> pd.Series:
    return _per_distinct(values, ordinary)


@F.pandas_udf(T.StringType())
def _comparable(values: pd.Series) -> pd.Series:
    return _per_distinct(values, comparable)


def is_plain(text: Column) -> Column:
    """Whether a text has only characters that are ordinary wherever they stand; decided in the JVM."""
    return ~text.rlike(NOT_PLAIN)


def ordinary_form(text: Column) -> Column:
    """`ordinary` of each text; plain ones don't leave the JVM's row, null stays null, empty stays empty."""
    return F.when(is_plain(text), text).otherwise(_ordinary(text))


def comparison_key(text: Column) -> Column:
    """`comparable` of each text, in Python for all but ASCII ones without control characters."""
    ascii_key = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(~text.rlike(r"[^\t\n\r\x20-\x7E]"), ascii_key).otherwise(_comparable(text))


def differing(rows: DataFrame) -> DataFrame:
    """(table_name, row_id, text, form) of the rows of (table_name, row_id, text) whose text isn't in its ordinary form.

    Null and empty texts are in theirs. Other columns are not looked at. Map-only; only rows with a character that isn't
    plain reach Python.
    """
    odd = rows.select("table_name", "row_id", "text").filter(F.col("text").isNotNull() & ~is_plain(F.col("text")))
    return odd.withColumn("form", _ordinary("text")).filter("form <> text")


def links(aliases: DataFrame, references: DataFrame) -> DataFrame:
    """(key, aliases, decisions, citations) for each form of an alias: how many rows it has, of how many decisions, and how many distinct citations look the same.

    A citation's opening words (`č. j.`, `sp. zn.`) aren't part of the alias. Both sides are counted per key before they
    are joined, so that an alias with a large part of all rows is one row; null aliases and citations are left out.
    """
    named = aliases.filter("alias is not null").groupBy("alias", "ecli").agg(F.count("*").alias("n"))
    named = named.withColumn("key", comparison_key(F.col("alias"))).groupBy("key").agg(F.sum("n").alias("aliases"), F.count_distinct("ecli").alias("decisions"))
    cited = references.filter("raw_text is not null and kind <> 'provision'").groupBy("raw_text").agg(F.count("*").alias("n"))
    cited = cited.withColumn("key", F.regexp_replace(comparison_key(F.col("raw_text")), r"^(?:č\. ?j\.|sp\. ?zn\.) ?", "")).groupBy("key").agg(F.sum("n").alias("citations"))
    return named.join(cited, "key")
