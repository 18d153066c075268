"""HTML pages as paragraphs, and the parts of a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kodex.functions.legal import czech_date, split_ref_no
from kodex.functions.regex import let
from kodex.functions.text import SPACE, despaced, squeeze
from kodex.session import hot_keys, lookup, salted_join, stage

# The named entities that court pages use.
ENTITIES = {"nbsp": "\xa0", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "sect": "§", "ndash": "–", "mdash": "—", "aacute": "á", "eacute": "é", "iacute": "í", "oacute": "ó", "uacute": "ú", "yacute": "ý", "amp": "&"}
#: Paragraphs in which the Constitutional Court's verdict opens, and letters that tell how a paragraph begins.
VERDICT_DEPTH, HEAD_LETTERS = 6, 16


def unescaped(text: Column) -> Column:
    """Text with its named entities as characters."""
    for name, ch in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(ch))
    return text


def plain_lines(html: Column) -> Column:
    """array of the squeezed, non-blank lines of a page's body: br and closed blocks end a line, scripts, styles and comments go."""
    s = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>", "")
    s = F.regexp_replace(s, r"[\r\n]+", " ")
    s = F.regexp_replace(s, r"(?i)<br\s*/?>|</(?:p|div|tr|li|h[1-6]|table|blockquote|title)\s*>", "\n")
    s = F.regexp_replace(s, r"<[^<>]*>", "")
    return F.filter(F.transform(F.split(unescaped(s), "\n"), squeeze), lambda p: p != "")


def paragraphs(pages: DataFrame, key: str, html: str, min_length: int = 1) -> DataFrame:
    """(key, idx, body): the lines of each page of at least min_length characters, numbered from 1. Empty pages have none."""
    long = F.filter(plain_lines(F.col(html)), lambda p: F.length(p) >= min_length)
    return pages.select(key, F.posexplode(long).alias("p", "body")).select(key, (F.col("p") + 1).alias("idx"), "body")


def has_layout(ecli: Column) -> Column:
    """Whether a decision is of a court whose pages' layout is known; of any other no verdict should be guessed."""
    return ecli.rlike("^(?:nalus|ECLI:CZ:US|ECLI:CZ:NSS):")


def verdict_bounds(rows: DataFrame) -> DataFrame:
    """(ecli, start, stop): where each decision's verdict is announced and where it ends (null: with the decision), as idx.

    As each court's pages are laid out, the opener is: of the Constitutional Court the last of the first six paragraphs that
    ends with `takto:` or is `výrok`; of the Supreme Administrative Court the first paragraph that begins with `takto`; of
    any other the first that is one of these. Starts are told by the first letters whatever the spaces between them, ends by
    the whole paragraph. The stop is the next paragraph that begins the reasons or, but for the Constitutional Court, a
    numbered one. Positions alone are shuffled, no text.
    """
    # the first letters with what stands between them: enough for the longest opener or closer
    head = despaced(F.regexp_extract("body", rf"^(?:(?:{SPACE}|\p{{M}})*+[^\p{{M}}]){{0,{HEAD_LETTERS}}}", 0))
    us, nss = F.col("ecli").rlike("^(?:nalus|ECLI:CZ:US):"), F.col("ecli").startswith("ECLI:CZ:NSS:")
    flat = rows.select("ecli", "idx", "body", head.alias("_f"), us.alias("_us"), nss.alias("_nss"))
    ends = F.when(F.col("body").contains(":"), despaced(F.col("body")).endswith("takto:")).otherwise(False)
    begins, label = F.col("_f").startswith("takto"), F.col("_f") == "vyrok"
    flags = flat.select("ecli", "idx", "_us", F.coalesce(F.when(F.col("_us"), label | ends).when(F.col("_nss"), begins).otherwise(begins | label | ends), F.lit(False)).alias("_o"), F.coalesce(F.col("_f").startswith("oduvodneni") | (~F.col("_us") & F.col("body").rlike(r"^\[\d+\]")), F.lit(False)).alias("_c"))
    depth = flags.filter("_us").withColumn("_r", F.row_number().over(Window.partitionBy("ecli").orderBy("idx"))).filter(F.col("_r") <= VERDICT_DEPTH)
    starts = flags.filter("_o and not _us").groupBy("ecli").agg(F.min("idx").alias("start")).unionByName(depth.filter("_o").groupBy("ecli").agg(F.max("idx").alias("start")))
    closers = flags.filter("_c").groupBy("ecli", "idx").agg(F.lit(1).alias("_n")).drop("_n")
    stops = salted_join(closers, starts, ["ecli"], hot=hot_keys(rows, ["ecli"])).filter("idx > start").groupBy("ecli").agg(F.min("idx").alias("stop"))
    return starts.join(stops, "ecli", "left")


def verdicts(rows: DataFrame) -> DataFrame:
    """(ecli, verdict_text): the paragraphs after the opener, up to the stop of verdict_bounds.

    Only the paragraphs between the two are gathered, so that a decision with a large part of all rows isn't.
    """
    bounds = stage(verdict_bounds(rows))
    inside = lookup(rows.select("ecli", "idx", "body"), bounds, ["ecli"], counted=rows.select("ecli")).filter("idx > start and (stop is null or idx < stop)")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "body"))), lambda x: x["body"]), "\n")
    return inside.groupBy("ecli").agg(F.trim(text).alias("verdict_text")).filter("verdict_text <> ''")


def cached_verdicts(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(ecli, verdict_text): the bold passage of a decision's page (ecli, html) where it has one, else `verdicts` of its paragraphs.

    Only decisions of courts with a known layout have one; only the Constitutional Court sets it in bold.
    """
    bold = pages.filter(F.col("ecli").rlike("^(?:nalus|ECLI:CZ:US):")).groupBy("ecli").agg(F.max(bold_verdict(F.col("html"))).alias("_bold"))
    marked = verdicts(rows.filter(has_layout(F.col("ecli"))))
    return marked.join(bold.filter("_bold is not null"), "ecli", "full").select("ecli", F.coalesce("_bold", "verdict_text").alias("verdict_text"))


def numbered(rows: DataFrame) -> DataFrame:
    """(ecli, no, para_id): the first paragraph with each number [N], for decisions with at least three of them and a [1]."""
    n = F.regexp_extract("body", r"^\[(\d{1,9})\]", 1).try_cast("int")
    first = rows.filter(F.col("body").rlike(r"^\[\d{1,9}\]")).withColumn("no", n).filter("no >= 1").groupBy("ecli", "no").agg(F.min_by("para_id", F.struct("idx", "para_id")).alias("para_id"))
    ok = first.groupBy("ecli").agg(F.count("*").alias("_n"), F.min("no").alias("_least")).filter("_n >= 3 and _least = 1").select("ecli")
    return first.join(ok, "ecli", "left_semi")


def table_rows(pages: DataFrame, key: str, html: str, columns: int) -> DataFrame:
    """(key, row, cells array<string>): the rows of the page's tables that have at least `columns` cells."""
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), lambda c: squeeze(unescaped(F.regexp_replace(c, r"<[^<>]*>", ""))))
    found = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(0))).alias("row", "_r"))
    return found.select(key, "row", cells(F.col("_r")).alias("cells"), "_r").filter(F.size("cells") >= columns).select(key, "row", "cells", F.regexp_extract("_r", DOCUMENT_LINK, 1).alias("link"))


# The places of the columns of the administrative court's result table, how many there are, the shape of an ecli and of a document's link.
RESULT_COLUMNS = {"decided_on": 2, "ref_no": 3, "court_panel": 4, "document_kind": 5, "outcome": 6, "parties": 7, "ecli": 8}
COLUMN_COUNT = 11
ECLI_SHAPE = r"^ECLI:CZ:[A-Z]{2,5}:\d{4}:[A-Za-z0-9._-]+$"
DOCUMENT_LINK = r"/DokumentOriginal/(?:Html|Text|Index)/(\d+)"


def result_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row, ecli, decided_on, case_no, ref_no, court_panel, document_kind, outcome, parties, document_id) of result pages.

    A row without an ecli of the published shape, a document's link or a day is left out; nothing of it is made up.
    """
    at = lambda c: F.get("cells", F.lit(RESULT_COLUMNS[c]))
    blank = lambda c: F.nullif(at(c), F.lit("")).alias(c)
    rows = table_rows(pages, key, html, COLUMN_COUNT).filter(at("ecli").rlike(ECLI_SHAPE) & (F.col("link") != "")).withColumn("decided_on", czech_date(at("decided_on"))).filter("decided_on is not null")
    return rows.withColumn("_n", split_ref_no(at("ref_no"))).select(key, "row", at("ecli").alias("ecli"), "decided_on", "_n.case_no", "_n.ref_no", at("court_panel").alias("court_panel"), blank("document_kind"), blank("outcome"), blank("parties"), F.col("link").alias("document_id"))


def bold_verdict(html: Column) -> Column:
    """The first bold passage that begins with one of the page's first six paragraphs, leading labels Výrok left out; null if there is none."""
    inner = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<b>(.*?)</b>"), F.lit(1)), plain_lines)
    unlabelled = lambda lines: F.filter(lines, lambda x, i: F.exists(F.slice(lines, 1, i + 1), lambda y: despaced(y) != "vyrok"))
    heads = F.transform(F.slice(plain_lines(html), 1, VERDICT_DEPTH), despaced)
    fits = lambda head: F.filter(F.transform(inner, unlabelled), lambda lines: F.array_contains(head, despaced(F.get(lines, F.lit(0)))))
    return F.when(html.contains("<b>"), F.array_join(F.get(let(heads, fits), F.lit(0)), "\n"))


def leading(rows: DataFrame, first: int) -> DataFrame:
    """(ecli, idx, body, rank): the first paragraphs of each decision.

    The rank filter becomes a limit per group that is applied before the shuffle, so a long decision sends few rows.
    """
    w = Window.partitionBy("ecli").orderBy("idx")
    return rows.select("ecli", "idx", "body").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= first)


def joined(rows: DataFrame) -> DataFrame:
    """(ecli, heading): few paragraphs of each decision in one line."""
    return rows.groupBy("ecli").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "body"))), lambda x: x["body"]), " ").alias("heading"))


def headings(rows: DataFrame, first: int = 4) -> DataFrame:
    """(ecli, heading, dated_on): the first paragraphs of each decision joined, and the last date that a paragraph gives."""
    dated = rows.select("ecli", "idx", czech_date(F.col("body")).alias("_d")).filter("_d is not null").groupBy("ecli").agg(F.max_by("_d", "idx").alias("dated_on"))
    return joined(leading(rows, first)).join(dated, "ecli", "left")
