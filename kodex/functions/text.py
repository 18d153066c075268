"""Text kernel: Column -> Column, no UDF. Null in gives null out unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kodex.functions.regex import let, located, sums

#: Fixed value: every Unicode white space, with the separators FS..US that Python's str.split() also takes.
SPACE = r"[\s\x{85}\p{Z}\x1c-\x1f]+"
#: Fixed value: Czech letters with diacritics, and the same without.
ACCENTED = "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ"
PLAIN = "acdeeinorstuuyzACDEEINORSTUUYZ"
#: Fixed value: tokens that end in a full stop without ending a sentence.
ABBREVIATIONS = "sp. zn. č. j. odst. písm. pís. zák. sb. čl. resp. tj. tzv. např. mj. str. obč. obch. tr. usn. roz. pl. atd. apod. s. ř. z. o. sr."
_MARK = "\x01"
#: Fixed value: ASCII white space, which ends a sentence after its full stop.
_BLANK = " \t\n\x0b\f\r"


def squeeze(text: Column) -> Column:
    """Each white-space run as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def alias_form(text: Column) -> Column:
    """The form in which aliases are stored and looked up: squeezed, lower case (ß stays, unlike with full case folding)."""
    return F.lower(squeeze(text))


def unaccented(text: Column) -> Column:
    """Squeezed, lower case, without Czech diacritics, precomposed or combining."""
    return F.lower(squeeze(F.translate(F.regexp_replace(text, r"\p{M}", ""), ACCENTED, PLAIN)))


def despaced(text: Column) -> Column:
    return F.replace(unaccented(text), F.lit(" "), F.lit(""))


def paragraphs(text: Column) -> Column:
    """Squeezed, non-blank paragraphs: parts between blank lines, or the lines if there is at most one such part."""
    parts = lambda by: F.filter(F.transform(F.split(text, by), squeeze), lambda p: p != "")
    blocks, lines = parts(r"\R[ \t\x{A0}]*\R"), parts(r"\R")
    return F.when(F.size(blocks) > 1, blocks).when(F.size(lines) > F.size(blocks), lines).otherwise(blocks)


def sentences(text: Column) -> Column:
    """array<struct<start, sentence>>: sentences with 0-based offsets; no break after abbreviations and numerals.

    A break is white space after . ! or ?, unless the token before is in ABBREVIATIONS or a numeral with a full stop. The
    text is cut at every such white space, put together again with marks at the true breaks, and cut there.
    """
    clean = F.translate(text, _MARK, " ")
    pieces = F.split(F.regexp_replace(clean, r"(?<=[.!?])(\s+)", rf"$1{_MARK}"), _MARK)

    def closed(piece: Column) -> Column:
        token = F.substring_index(F.translate(F.rtrim(piece, F.lit(_BLANK)), _BLANK, " " * len(_BLANK)), " ", -1)
        goes_on = let(token, lambda t: F.lower(t).isin(ABBREVIATIONS.split()) | t.rlike(r"^[0-9IVXivx]+\.$"))
        return F.when(goes_on, piece).otherwise(F.concat(piece, F.lit(_MARK)))

    def located(whole: Column) -> Column:
        lengths = F.transform(whole, F.length)
        entry = lambda s, at: F.struct((at - F.length(s)).alias("start"), F.rtrim(s, F.lit(_BLANK)).alias("sentence"))
        return F.filter(let(sums(lengths), lambda at: F.transform(whole, lambda s, i: entry(s, F.get(at, i)))), lambda s: s["sentence"] != "")

    return F.when(text.isNotNull(), let(F.split(F.array_join(F.transform(pieces, closed), ""), _MARK), located))


def contains_any(text: Column, phrases: list[str]) -> Column:
    """Whether the squeezed, lower-case text contains one of the phrases."""
    # one alternation, so that the text is folded and read once
    return alias_form(text).rlike("|".join(re.escape(p) for p in phrases))


def first_phrase(text: Column, phrases: list[str]) -> Column:
    """The first of the phrases, in their order, that the text contains; null if none."""
    folded = alias_form(text)
    return F.coalesce(*[F.when(folded.contains(p), F.lit(p)) for p in phrases])


def is_verbatim(span: Column, context: Column) -> Column:
    """Whether a span that isn't blank occurs in the context, white space squeezed, all else as it is. Null gives false."""
    s = squeeze(span)
    return F.coalesce((s != "") & F.contains(squeeze(context), s), F.lit(False))


def occurrences(text: Column, needle: Column) -> Column:
    """How often the needle occurs in the text, white space squeezed and case disregarded; 0 for a blank needle."""
    h, n = alias_form(text), alias_form(needle)
    return F.when(F.length(n) > 0, ((F.length(h) - F.length(F.replace(h, n, F.lit("")))) / F.length(n)).cast("int")).otherwise(0)


def locate(text: Column, needle: Column) -> Column:
    """array<struct<raw, start, end>> of every place of the needle, white space of any length between its words, case disregarded.

    Offsets are code points of the text as it is; a blank or null needle is nowhere, in a null text nothing can be.
    """
    words = F.transform(F.split(squeeze(needle), " "), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.concat(F.lit("(?iu)"), F.array_join(words, SPACE))
    found = let(F.split(F.regexp_replace(F.translate(text, "\x01\x02", "  "), pattern, F.lit("\x01$0\x02")), "\x01"), located)
    return F.when(text.isNotNull(), F.when(F.coalesce(squeeze(needle), F.lit("")) != "", found).otherwise(F.array().cast("array<struct<raw:string,start:int,end:int>>")))


def citation_sentence(paragraph: Column, citation: Column) -> Column:
    """The first sentence of a paragraph that holds the citation; null if none does."""
    return F.when(squeeze(citation) != "", cited(sentences(paragraph), citation))


def cited(said: Column, citation: Column) -> Column:
    """citation_sentence of sentences that were split already."""
    return let(alias_form(citation), lambda c: F.get(F.filter(said, lambda s: F.contains(alias_form(s["sentence"]), c)), F.lit(0))["sentence"])


def marked_sentence(text: Column, phrases: list[str], also: Column | None = None) -> Column:
    """The first sentence with one of the phrases (and, if given, with one of the strings of array `also`); null if none."""
    # a text without any of the phrases isn't split
    return F.when(contains_any(text, phrases), marked(sentences(text), phrases, also))


def marked(said: Column, phrases: list[str], also: Column | None = None) -> Column:
    """marked_sentence of sentences that were split already."""
    def fits(form: Column) -> Column:
        any_of = form.rlike("|".join(re.escape(p) for p in phrases))
        return any_of if also is None else any_of & F.exists(also, lambda x: (x != "") & F.contains(form, x))

    return F.get(F.filter(said, lambda s: let(alias_form(s["sentence"]), fits)), F.lit(0))["sentence"]


def truncated(text: Column, limit: int = 120) -> Column:
    s = squeeze(text)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.left(s, F.lit(limit)), F.lit("...")))


def render(template: str, **values: Column) -> Column:
    """A template's {{names}} filled in; a null value or a name left over is an error."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value, F.raise_error(F.lit(f"no value for {name}"))))
    return F.when(out.contains("{{"), F.raise_error(F.lit("a name is left over"))).otherwise(out)


def json_object(text: Column) -> Column:
    """From the first { to the last }; null if there are none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
