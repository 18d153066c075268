"""Queries of the file readers and page parsers, over files and pages written from the tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kodex.functions.text import json_object
from kodex.patterns import PATTERNS
from kodex.plans.derived import decisions, sql
from kodex.schema import LABELS
from kodex.session import staged_dir
from kodex.sources import files, pages
from kodex.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return f"{staged_dir(spark)}/files-{uuid.uuid4().hex}"


def _dumped(spark, d):
    """provision_dump as dump records, printed as statutes print them, each seventh with one of six faults, each second nested."""
    k = F.col("rec_id") % 7
    rows = table(spark, d, "provision_dump").select(
        F.when(k == 1, F.lit("zákon")).otherwise(F.col("act_no")).alias("act_no"), F.concat(F.lit("§ "), "section", F.lit(".")).alias("section"), F.concat(F.lit("odst. ("), F.coalesce("subsec", F.lit("")), F.lit(")")).alias("subsec"),
        F.when(k == 2, "").otherwise(F.col("body")).alias("body"), F.when(k == 3, "soon").otherwise(F.col("valid_from").cast("string")).alias("valid_from"), F.when(k == 4, "never").otherwise(F.col("valid_to").cast("string")).alias("valid_to"),
        "derogated_by", F.when(k == 5, "xml").alias("format"), (F.col("rec_id") % 2 == 0).alias("_nested"),
    )
    key = ["act_no", "section", "subsec"]
    flat = [F.when(~F.col("_nested"), F.col(c)).alias(c) for c in key]
    return rows.select(*flat, "body", "valid_from", "valid_to", "derogated_by", F.when(F.col("_nested"), F.struct(*key)).alias("provision"), "format")


_RECORD_SQL = """r as (select *, nullif(subsec, '') sub, rec_id % 7 k from provision_dump)"""


@query(f"with {_RECORD_SQL} select act_no, section, sub as subsec, body, valid_from, valid_to, nullif(derogated_by, '') derogated_by from r where k in (0, 6)")
def s8_dump_records(spark, d):
    """Records of a JSON-lines dump that are whole, in their forms."""
    path = _folder(spark)
    _dumped(spark, d).write.json(path)
    return files.dump_records(files.json_lines(spark, path))[0]


@query(f"with {_RECORD_SQL} select case k when 1 then 'no act number' when 2 then 'no body' when 3 then 'no valid_from' when 4 then 'valid_to is no day' else 'foreign format' end reason, section, sub as subsec from r where k between 1 and 5")
def s11_rejected_records(spark, d):
    """Records that are refused, and why."""
    return files.dump_records(files.json_lines(spark, _written(spark, d)))[1].select("reason", "section", "subsec")


def _written(spark, d) -> str:
    path = _folder(spark)
    _dumped(spark, d).write.json(path)
    return path


@query("select act_no, section, subsec, body, valid_from from (select *, nullif(subsec, '') subsec_ from provision_dump)".replace("section, subsec, body", "section, subsec_ subsec, body"))
def s9_document_records(spark, d):
    """Records out of whole JSON documents, bare lists and lists under each of the known names."""
    entry = F.to_json(F.array(F.struct("act_no", "section", "subsec", "body", F.col("valid_from").cast("string").alias("valid_from"))))
    k = F.col("rec_id") % 5
    box = F.concat(F.lit('{"'), F.element_at(F.array(*map(F.lit, ("records", "items", "data", "@graph"))), F.greatest(k, F.lit(1)).cast("int")), F.lit('": '), entry, F.lit("}"))
    documents = table(spark, d, "provision_dump").select(F.when(k == 0, entry).otherwise(box).alias("value"))
    return files.dump_records(files.document_records(documents))[0].select("act_no", "section", "subsec", "body", "valid_from")


@query("select distinct 'part=' || id % 5 folder from provision")
def s10_files_below(spark, d):
    """The folders in which files with a suffix are found, at any depth."""
    path = _folder(spark)
    table(spark, d, "provision").withColumn("part", F.col("id") % 5).write.partitionBy("part").json(path)
    return files.files_below(spark, path, ".json").select(F.regexp_extract("path", r"/(part=\d+)/", 1).alias("folder")).distinct()


_LABELS_SQL = f"""g as (select ref_id, ecli, coalesce(resolved_ecli, '') cited, paragraph_idx, ref_id % 6 k, {LABELS}[(ref_id % 8) + 1] as label from reference_span)"""


def _labelled(spark, d) -> str:
    k = F.col("ref_id") % 6
    rows = table(spark, d, "reference_span").select(
        F.when(k == 1, F.concat(F.lit("TEST-"), "ecli")).otherwise(F.col("ecli")).alias("citing_ecli"), F.coalesce("resolved_ecli", F.lit("")).alias("cited_ecli"), F.when(k == 2, "x").when(k == 3, None).otherwise(F.col("paragraph_idx").cast("string")).alias("paragraph_idx"),
        F.when(k == 4, "ODD").otherwise(F.element_at(F.array(*map(F.lit, LABELS)), (F.col("ref_id") % 8 + 1).cast("int"))).alias("gold_label"), F.lit("n").alias("note"),
    )
    path = _folder(spark)
    rows.write.csv(path, header=True)
    return path


@query(f"with {_LABELS_SQL} select ecli citing_ecli, cited cited_ecli, case when k <> 3 then paragraph_idx end paragraph_idx, label gold_label from g where cited <> '' and k not in (1, 2, 4)")
def s12_gold_labels(spark, d):
    """Labels of a CSV file that can be used."""
    return files.gold_labels(spark, _labelled(spark, d), LABELS)[0].select("citing_ecli", "cited_ecli", "paragraph_idx", "gold_label")


@query(f"with {_LABELS_SQL} select case when cited = '' then 'no key' when k = 1 then 'placeholder' when k = 4 then 'unknown label' else 'paragraph_idx is no number' end problem, count(*) n from g where cited = '' or k in (1, 2, 4) group by 1")
def s12_label_problems(spark, d):
    return files.gold_labels(spark, _labelled(spark, d), LABELS)[1].groupBy("problem").agg(F.count("*").alias("n"))


@query("""select ref_id::varchar id, kind, raw_text, p.para_id::varchar note, substr(p.body, span_start + 1, span_end - span_start) = raw_text ok
from reference_span r join decision_paragraph p on p.ecli = r.ecli and p.idx = r.paragraph_idx""")
def s13_golden_spans(spark, d):
    """Expected spans of a JSON-lines file, checked against their text."""
    p = table(spark, d, "decision_paragraph").select("ecli", F.col("idx").alias("paragraph_idx"), "para_id", "body")
    rows = table(spark, d, "reference_span").join(p, ["ecli", "paragraph_idx"])
    span = F.struct("kind", "raw_text", F.col("span_start").alias("start"), F.col("span_end").alias("end"), F.create_map().cast("map<string,string>").alias("groups"))
    path = _folder(spark)
    rows.select(F.col("ref_id").cast("string").alias("id"), F.col("para_id").cast("string").alias("note"), F.col("body").alias("text"), F.array(span).alias("expected")).write.json(path)
    return files.golden_spans(spark, path).select("id", "kind", "raw_text", "note", "ok")


@query("select * from (values " + ", ".join(f"({i}, '{p.name}', '{p.kind}', {len(p.groups)})" for i, p in enumerate(PATTERNS)) + ") t(ord, name, kind, n_groups)")
def s14_catalogue(spark, d):
    """The patterns of a TOML catalogue in their order; it is read by the driver, like any configuration."""
    entry = lambda p: f"[patterns.{p.name}]\nregex = '''{p.regex}'''\nkind = '{p.kind}'\ngroups = {list(p.groups)}\n"
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "patterns.toml"
        path.write_text("\n".join(map(entry, PATTERNS)))
        found = files.catalogue(str(path))
    return spark.createDataFrame([(p["ord"], p["name"], p["kind"], len(p["groups"])) for p in found], "ord int, name string, kind string, n_groups int")


@query(sql("dec", "select ecli, decided_on, case_no, ref_no, panel court_panel, doc document_id from (select ecli, decided_on, 'senát ' || panel_type panel, length(source_url)::varchar doc, '6 As ' || length(ecli) || '/2020' case_no, '6 As ' || length(ecli) || '/2020-' || length(source_url) ref_no from dec where starts_with(ecli, 'ECLI:') and length(source_url) % 5 <> 0 and length(source_url) % 7 <> 0)"))
def s16_result_rows(spark, d):
    """Rows of result pages: those with an ecli, a day and a document's link; of each fifth the link, of each seventh the day is missing."""
    n = F.length("source_url")
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    link = F.when(n % 5 != 0, F.concat(F.lit('<a href="/DokumentOriginal/Html/'), n.cast("string"), F.lit('">text</a>'))).otherwise(F.lit("<a>text</a>"))
    day = F.when(n % 7 != 0, F.date_format("decided_on", "d. M. yyyy")).otherwise(F.lit("-"))
    cells = [F.lit("1"), F.lit(""), day, F.concat(F.lit("6 As "), F.length("ecli").cast("string"), F.lit("/2020 - "), n.cast("string")), F.concat(F.lit("senát&nbsp;"), "panel_type"), F.lit("Rozsudek"), F.lit(""), F.lit("A <b>v.</b> B"), F.col("ecli"), F.lit(""), link]
    row = F.concat(F.lit("<tr>"), *map(cell, cells), F.lit("</tr>"))
    html = F.concat(F.lit("<table id='tresults'><tr><th>#</th></tr>"), row, F.lit("<tr><td>krátký</td></tr></table>"))
    found = pages.result_rows(decisions(spark, d).select("ecli", html.alias("html")).withColumnRenamed("ecli", "page"), "page", "html")
    return found.select("ecli", "decided_on", "case_no", "ref_no", "court_panel", "document_id")


@query("select provision_id::varchar act_no, id::varchar wording, valid_from, valid_to, kind from (select *, ['platne', 'vyhlasene', 'minule', 'minule_neucinne'][(id % 4) + 1] kind from provision_version) where id % 2 = 0")
def s18_history_entries(spark, d):
    """Wordings out of JSON replies; announced ones and those that never took effect are left out (P11)."""
    kind = F.element_at(F.array(*map(F.lit, ("platne", "vyhlasene", "minule", "minule_neucinne"))), (F.col("id") % 4 + 1).cast("int"))
    entry = F.struct(F.col("id").cast("string").alias("id"), F.col("valid_from").cast("string").alias("datumUcinnostiOd"), F.col("valid_to").cast("string").alias("datumUcinnostiDo"), kind.alias("typ"))
    raw = table(spark, d, "provision_version").select(F.col("provision_id").cast("string").alias("act_no"), F.to_json(F.struct(F.array(entry).alias("historie"))).alias("reply"))
    return files.history_entries(raw).select("act_no", "wording", "valid_from", "valid_to", "kind")


@query("""select alias_id, case when alias_id % 3 = 0 then null else '{"kind":"' || alias_kind || '","of":{"n":' || alias_id || '}}' end found from decision_alias""")
def f35_json_objects(spark, d):
    """The JSON object within a model's chatty reply."""
    reply = F.concat(F.lit("Zde je odpověď:\n```json\n"), F.to_json(F.struct(F.col("alias_kind").alias("kind"), F.struct(F.col("alias_id").alias("n")).alias("of"))), F.lit("\n```"))
    return table(spark, d, "decision_alias").select("alias_id", json_object(F.when(F.col("alias_id") % 3 == 0, F.lit("nevím }{")).otherwise(reply)).alias("found"))
