"""Queries of the training-text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kodex.llm import boilerplate, canonical, encoding, leakage, mixing, splitting
from kodex.session import sized_broadcast, stage, union_all, widened
from kodex.sources.tables import table


def _texts(spark: SparkSession, d: str, *columns: tuple[str, str, str]) -> DataFrame:
    """(table_name, row_id, text) of some text columns, each given as table, id, text."""
    return widened(union_all([table(spark, d, t).select(F.lit(t).alias("table_name"), F.col(i).alias("row_id"), F.col(c).alias("text")) for t, i, c in columns]))


BODIES, PAGES = ("decision_paragraph", "para_id", "body"), ("cached_page", "page_id", "text")
ALIASES, CITATIONS = ("decision_alias", "alias_id", "alias"), ("reference_span", "ref_id", "raw_text")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_rows(_texts(spark, d, BODIES, PAGES)).select("table_name", "row_id")


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled rows with their text put right."""
    return encoding.restored(_texts(spark, d, BODIES, PAGES))


def p1_by_method(spark: SparkSession, d: str) -> DataFrame:
    """How many rows were found by whole words of the corpus, and how many only by parts of such words."""
    rows = encoding.garbled_rows(_texts(spark, d, BODIES, PAGES))
    how = F.when(F.exists("words", lambda w: w["how"] == "word"), "word").otherwise("parts")
    return rows.groupBy("table_name", how.alias("how")).agg(F.count("*").alias("n"))


def _unlike(spark: SparkSession, d: str) -> DataFrame:
    """Rows that aren't in their ordinary form, without those that are garbled.

    Only rows that differ are looked at for garbled words; the clean words are those of the whole corpus.
    """
    unlike = stage(canonical.differing(_texts(spark, d, BODIES, ALIASES, CITATIONS)))
    bodies = unlike.filter(F.col("table_name") == BODIES[0])
    garbled = encoding.garbled_rows(bodies, _texts(spark, d, BODIES, PAGES)).select("table_name", "row_id")
    return unlike.join(sized_broadcast(stage(garbled)), ["table_name", "row_id"], "left_anti")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _unlike(spark, d).select("table_name", "row_id").distinct()


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """What each of these rows says in its ordinary form."""
    return _unlike(spark, d).select("table_name", "row_id", "form")


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """Aliases and citations that look the same."""
    return canonical.links(table(spark, d, "decision_alias"), table(spark, d, "reference_span"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.recurring_lines(table(spark, d, "decision_paragraph"), table(spark, d, "decision")).select("para_id", "line_no")


def _recurring(spark: SparkSession, d: str) -> DataFrame:
    return stage(boilerplate.recurring_lines(table(spark, d, "decision_paragraph"), table(spark, d, "decision")))


def p3_lines(spark: SparkSession, d: str) -> DataFrame:
    """The recurring lines of each court."""
    return boilerplate.line_texts(_recurring(spark, d), table(spark, d, "decision_paragraph"))


def p3_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Every body without them."""
    return boilerplate.without_lines(_recurring(spark, d), table(spark, d, "decision_paragraph"))


def p3_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The recurring chunks of each court, by hash."""
    return boilerplate.recurring_chunks(table(spark, d, "decision_paragraph"), table(spark, d, "decision"))


def p3_cut(spark: SparkSession, d: str) -> DataFrame:
    """Every text of a court without the chunks that recur in it, however its lines break."""
    return boilerplate.without_chunks(table(spark, d, "decision_paragraph"), table(spark, d, "decision"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_spans(spark, d).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every shared run of each pair, by word."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, and into how many documents."""
    per = p7_spans(spark, d).groupBy("item_id", "doc_id").agg(F.max("words").alias("_w"), F.count("*").alias("_n"))
    return per.groupBy("item_id").agg(F.count("*").alias("documents"), F.sum("_n").alias("passages"), F.max("_w").alias("longest"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, d), table(spark, d, "mix_target"))


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """What the mix promises of each target source: whether it has documents, keeps its limit, and meets its share of those that have.

    A share may be off by one document for each other source that it shares texts with and for itself.
    """
    chosen, targets = stage(p8_mix(spark, d)), table(spark, d, "mix_target")
    rows = mixing.shares(chosen, targets).join(targets.select("source", "max_repeats"), "source")
    whole = rows.filter("documents > 0").agg(F.sum("target_share").alias("_share"), F.sum("tokens").alias("_all"))
    slack = chosen.agg(F.coalesce(F.max("n_tokens"), F.lit(0)).alias("_largest"))
    rows = rows.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(slack))
    off = F.abs(F.col("tokens") - F.col("target_share") / F.col("_share") * F.col("_all"))
    met = (F.col("documents") == 0) | (off <= F.col("_largest") * F.lit(10))
    return rows.select("source", (F.col("documents") > 0).alias("has_documents"), (F.col("max_used") <= F.col("max_repeats")).alias("within_limit"), met.alias("meets_share"))


def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each document add up to: its bytes without the overlaps, their number being more than one, and whether all keep the limit and the overlap."""
    rows = p9_pieces(spark, d).select("doc_id", "piece_no", "char_start", "char_end", "n_tokens", "piece")
    order = Window.partitionBy("doc_id").orderBy("piece_no")
    # a document's pieces are bounded by the document
    before = F.lag("char_end").over(order)
    rows = rows.withColumn("_o", F.when(before.isNotNull(), F.octet_length(F.left("piece", before - F.col("char_start"))))).withColumn("_ok", (F.col("n_tokens") == F.octet_length("piece")) & (F.col("n_tokens") <= splitting.LIMIT) & (F.col("_o").isNull() | F.col("_o").between(splitting.OVERLAP, splitting.OVERLAP + 3)))
    return rows.groupBy("doc_id").agg(F.sum(F.col("n_tokens") - F.coalesce("_o", F.lit(0))).alias("bytes"), (F.count("*") > 1).alias("is_cut"), F.every("_ok").alias("keeps_limits"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "documents"), "doc_id", "text", oversized_only=True, with_text=False).filter("piece_no = 1").select("doc_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {q.__name__: q for q in (p1_found, p1_restored, p1_by_method, p2_found, p2_forms, p2_links, p3_found, p3_lines, p3_bodies, p3_chunks, p3_cut, p7_found, p7_spans, p7_items, p8_mix, p8_shares, p8_checked, p9_found, p9_pieces, p9_checked)}

_LINES = r"""lines as (
  select para_id, ecli, unnest(string_split(body, chr(10))) line, generate_subscripts(string_split(body, chr(10)), 1)::int line_no from decision_paragraph),
formed as (select para_id, ecli, line_no, regexp_replace(regexp_replace(regexp_replace(lower(line), '\p{Nd}+', '0', 'g'), '[ \t]+', ' ', 'g'), '^ | $', '', 'g') form from lines),
court as (select ecli, max(court_code) court_code from decision group by ecli),
at_court as (select f.*, c.court_code from formed f join court c on c.ecli = f.ecli where form <> ''),
total as (select court_code, count(distinct p.ecli) total from decision_paragraph p join court c on c.ecli = p.ecli group by court_code),
hot as (select a.court_code, form from at_court a join total t on t.court_code = a.court_code group by a.court_code, form, t.total
  having count(distinct ecli) >= 4 and count(distinct ecli) >= 0.05 * t.total)"""

_RUNS = r"""d as (select doc_id, list_filter(string_split_regex(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from documents),
i as (select item_id, list_filter(string_split_regex(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from eval_item),
ig as (select item_id, unnest(list_transform(generate_series(1, len(w) - 15), lambda k: array_to_string(w[k:k + 15], ' '))) g, generate_subscripts(generate_series(1, len(w) - 15), 1) k from i where len(w) > 15),
dg as (select doc_id, unnest(list_transform(generate_series(1, len(w) - 15), lambda k: array_to_string(w[k:k + 15], ' '))) g, generate_subscripts(generate_series(1, len(w) - 15), 1) k from d where len(w) > 15),
h as (select doc_id, item_id, dg.k, dg.k - ig.k diagonal, ig.k ik from dg join ig on dg.g = ig.g),
n as (select *, k - row_number() over (partition by doc_id, item_id, diagonal order by k) island from h),
runs_ as (select doc_id, item_id, (count(*) + 15)::int words, (min(k) - 1)::int doc_word, (min(ik) - 1)::int item_word from n group by doc_id, item_id, diagonal, island)"""

ORACLE = {
    "p7_spans": f"with {_RUNS} select * from runs_",
    "p7_items": f"with {_RUNS} select item_id, count(distinct doc_id) documents, count(*) passages, max(words) longest from runs_ group by item_id",
    "p8_checked": "select t.source, count(d.doc_id) > 0 has_documents, true within_limit, true meets_share from mix_target t left join documents d on d.source = t.source and d.text <> '' group by t.source",
    "p9_checked": "select doc_id, strlen(text) bytes, strlen(text) > 2048 is_cut, true keeps_limits from documents where text <> ''",
    "p3_found": f"with {_LINES} select para_id, line_no from at_court a join hot h on h.court_code = a.court_code and h.form = a.form",
    "p3_lines": f"""with {_LINES}, texts as (select a.*, l.line from at_court a join lines l on l.para_id = a.para_id and l.line_no = a.line_no)
select t.court_code, arg_min(line, (para_id, line_no)) line, count(distinct ecli) documents, count(*) occurrences from texts t join hot h on h.court_code = t.court_code and h.form = t.form group by t.court_code, t.form""",
    "p3_bodies": f"""with {_LINES}, cut as (select para_id, line_no from at_court a join hot h on h.court_code = a.court_code and h.form = a.form)
select p.para_id, case when body is null then null else coalesce(string_agg(l.line, chr(10) order by l.line_no) filter (c.para_id is null), '') end body
from decision_paragraph p left join lines l on l.para_id = p.para_id left join cut c on c.para_id = l.para_id and c.line_no = l.line_no group by p.para_id, p.body""",
    "p7_found": r"""
with d as (select doc_id, list_filter(string_split_regex(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from documents),
i as (select item_id, list_filter(string_split_regex(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from eval_item),
dg as (select distinct doc_id, unnest(list_transform(generate_series(1, len(w) - 15), lambda k: array_to_string(w[k:k + 15], ' '))) g from d where len(w) > 15),
ig as (select distinct item_id, unnest(list_transform(generate_series(1, len(w) - 15), lambda k: array_to_string(w[k:k + 15], ' '))) g from i where len(w) > 15)
select distinct doc_id, item_id from dg join ig on dg.g = ig.g""",
    "p9_found": "select doc_id from documents where strlen(text) > 2048",
}
