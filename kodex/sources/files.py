"""Records, labels, golden spans and catalogues from files."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kodex.functions.legal import section_form, subsection_form

_FLAT = "act_no string, section string, subsec string, body string, valid_from string, valid_to string, derogated_by string"
RECORD = f"{_FLAT}, provision struct<act_no string, section string, subsec string>, format string"


def json_lines(spark: SparkSession, path: str, schema: str = RECORD, limit: int | None = None) -> DataFrame:
    """One record per line, blank lines skipped; a line that isn't JSON fails the read."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows if limit is None else rows.limit(limit)


def json_document(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """The records of whole JSON files: a bare list, or a list under records, items, data or @graph."""
    return document_records(spark.read.text(path, wholetext=True), schema)


def document_records(text: DataFrame, schema: str = RECORD) -> DataFrame:
    """The records of JSON documents that are rows (value)."""
    boxed = ", ".join(f"`{k}` array<struct<{_struct(schema)}>>" for k in ("records", "items", "data", "@graph"))
    lists = F.from_json("value", f"array<struct<{_struct(schema)}>>")
    box = F.from_json("value", boxed)
    is_list = F.ltrim(F.col("value")).startswith("[")
    records = F.when(is_list, lists).otherwise(F.coalesce(*[box[k] for k in ("records", "items", "data", "@graph")]))
    return text.select(F.inline(records))


def _struct(schema: str) -> str:
    """A schema's fields with colons, as within struct<>."""
    from pyspark.sql import types as T

    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T._parse_datatype_string(schema).fields)


def files_below(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(path, length) of every file below a folder with the suffix, in order; a missing folder has none."""
    if "://" not in folder and not Path(folder).exists():
        return spark.createDataFrame([], "path string, length long")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "length").orderBy("path")


def dump_records(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejected): records flat or nested under provision, with keys and days in their forms; rejected ones with a reason.

    Act, section, body and valid_from must be there, a day must be one, and a declared foreign format is refused.
    """
    pick = lambda c: F.coalesce(F.col(c), F.col(f"provision.{c}"))
    rows = raw.select(F.trim(pick("act_no")).alias("act_no"), section_form(pick("section")).alias("section"), subsection_form(pick("subsec")).alias("subsec"), "body", F.col("valid_from").try_cast("date").alias("valid_from"), F.col("valid_to").try_cast("date").alias("valid_to"), F.nullif("derogated_by", F.lit("")).alias("derogated_by"), (F.col("valid_to").isNotNull() & F.col("valid_to").try_cast("date").isNull()).alias("_bad_end"), F.col("format").alias("_format"))
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = F.when(F.col("_format").isNotNull(), "foreign format").when(missing("act_no"), "no act").when(~F.col("act_no").rlike(r"^\d+/\d{4}$"), "no act number").when(missing("section"), "no section").when(missing("body"), "no body").when(F.col("valid_from").isNull(), "no valid_from").when(F.col("_bad_end"), "valid_to is no day")
    rows = rows.withColumn("reason", reason)
    kept = ["act_no", "section", "subsec", "body", "valid_from", "valid_to", "derogated_by"]
    return rows.filter("reason is null").select(*kept), rows.filter("reason is not null").select(*kept, "reason")


def gold_labels(spark: SparkSession, path: str, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of a CSV citing_ecli,cited_ecli,paragraph_idx,gold_label,note with # comments; TEST- ids and unknown labels are problems."""
    raw = spark.read.schema("citing_ecli string, cited_ecli string, paragraph_idx string, gold_label string, note string").csv(path, header=True, comment="#", enforceSchema=False)
    idx = F.col("paragraph_idx").try_cast("int")
    problem = (
        F.when(F.coalesce("citing_ecli", F.lit("")).eqNullSafe("") | F.coalesce("cited_ecli", F.lit("")).eqNullSafe(""), "no key")
        .when(F.col("citing_ecli").startswith("TEST-") | F.col("cited_ecli").startswith("TEST-"), "placeholder")
        .when(~F.coalesce(F.col("gold_label").isin(labels), F.lit(False)), "unknown label")
        .when(F.col("paragraph_idx").isNotNull() & idx.isNull(), "paragraph_idx is no number")
    )
    rows = raw.withColumn("problem", problem)
    return rows.filter("problem is null").select("citing_ecli", "cited_ecli", idx.alias("paragraph_idx"), "gold_label", "note"), rows.filter("problem is not null").select("citing_ecli", "cited_ecli", "gold_label", "problem")


GOLDEN = "id string, note string, text string, expected array<struct<kind: string, raw_text: string, start: int, end: int, groups: map<string, string>>>"


def golden_spans(spark: SparkSession, path: str) -> DataFrame:
    """(id, note, kind, raw_text, start, end, groups, ok): the expected spans of a JSON-lines file, ok if the text has raw_text there."""
    rows = json_lines(spark, path, GOLDEN).select("id", "note", "text", F.inline("expected"))
    return rows.withColumn("ok", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("raw_text")).drop("text")


def history_entries(raw: DataFrame) -> DataFrame:
    """(act_no, wording, valid_from, valid_to, kind) of JSON replies with a list `historie`; a reply without one fails.

    Announced wordings and past ones that never took effect are left out.
    """
    fields = "historie array<struct<id: string, datumUcinnostiOd: string, datumUcinnostiDo: string, typ: string>>"
    parsed = raw.withColumn("_h", F.from_json("reply", fields)["historie"]).withColumn("_h", F.when(F.col("_h").isNull(), F.raise_error(F.lit("no list historie"))).otherwise(F.col("_h")))
    rows = parsed.select("act_no", F.inline("_h"))
    # Kinds of wordings that never were in force.
    return rows.filter(~F.upper("typ").isin("VYHLASENE", "MINULE_NEUCINNE")).select("act_no", F.col("id").alias("wording"), F.to_date("datumUcinnostiOd").alias("valid_from"), F.to_date("datumUcinnostiDo").alias("valid_to"), F.col("typ").alias("kind"))


def catalogue(path: str) -> list[dict]:
    """A TOML file's [patterns.*] in their order, each with ord, name, regex, kind, groups; an incomplete one is an error."""
    with open(path, "rb") as f:
        found = tomllib.load(f).get("patterns", {})
    out = []
    for i, (name, p) in enumerate(found.items()):
        if not {"regex", "kind", "groups"} <= p.keys():
            raise ValueError(f"pattern {name} is incomplete")
        out.append({"ord": i, "name": name, **p})
    return out
