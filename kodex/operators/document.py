"""Checking documents: what they cite, and how it stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kodex.functions.text import paragraphs
from kodex.operators import extract
from kodex.session import salted_join, stage


def document_paragraphs(documents: DataFrame) -> DataFrame:
    """(doc, paragraph_idx, body) of (doc_id, text), paragraphs numbered from 1; null and blank texts have none."""
    return documents.select(F.col("doc_id").alias("doc"), F.posexplode(paragraphs(F.col("text"))).alias("_p", "body")).select("doc", (F.col("_p") + 1).alias("paragraph_idx"), "body")


def cited_targets(rows: DataFrame, aliases: DataFrame, provisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, unresolved) of (doc, paragraph_idx, body): what each document cites, each target once, in order of first mention.

    sources: doc_id, ord, ecli or provision_id, raw_text of the first mention, mentions. unresolved: doc_id, raw_text, reason,
    first mention's paragraph; the reason is `not in corpus` for a known kind of citation without a match and `not resolved`
    for a provision whose act isn't known. Null bodies cite nothing; many documents are checked in one plan.
    """
    refs = stage(extract.references(rows))
    keys = ["doc", "paragraph_idx", "span_start", "pattern_ord"]
    cases = extract.resolve_decisions(refs.filter("kind <> 'provision'"), aliases, keys).select("doc", "paragraph_idx", "span_start", "raw_text", F.col("resolved_ecli").alias("ecli"), F.lit(None).cast("long").alias("provision_id"), F.lit("not in corpus").alias("reason"))
    acts = extract.resolve_provisions(refs, provisions).select("doc", "paragraph_idx", "span_start", "raw_text", F.lit(None).cast("string").alias("ecli"), F.col("resolved_provision_id").alias("provision_id"), F.when(F.col("act_no").isNull(), "not resolved").otherwise("not in corpus").alias("reason"))
    every = stage(cases.unionByName(acts))
    first = F.struct("paragraph_idx", "span_start")
    found = every.filter("ecli is not null or provision_id is not null").groupBy("doc", "ecli", "provision_id").agg(F.min(first).alias("_at"), F.min_by("raw_text", first).alias("raw_text"), F.count("*").alias("mentions"))
    # distinct targets of one document: bounded by the sources there are, and small in practice
    found = found.withColumn("ord", F.row_number().over(Window.partitionBy("doc").orderBy("_at")))
    missing = every.filter("ecli is null and provision_id is null").groupBy("doc", "raw_text", "reason").agg(F.min("paragraph_idx").alias("first_paragraph"))
    return found.select(F.col("doc").alias("doc_id"), "ord", "ecli", "provision_id", "raw_text", "mentions"), missing.withColumnRenamed("doc", "doc_id")


def check(sources: DataFrame, lights: DataFrame, provision_lights: DataFrame) -> DataFrame:
    """sources with the light of each target; a decision or provision that lights lack has none."""
    cases = salted_join(sources.filter("ecli is not null"), lights.select("ecli", "light"), ["ecli"], "left")
    acts = salted_join(sources.filter("ecli is null"), provision_lights.select("provision_id", "light"), ["provision_id"], "left")
    return cases.select(*sources.columns, "light").unionByName(acts.select(*sources.columns, "light"))


def spoken(sources: DataFrame, day: str) -> DataFrame:
    """(doc_id, ord, phrase): a sentence that states the light as of the day, in the reader's words."""
    # The wording of each light.
    said = F.create_map(*[F.lit(x) for kv in {"RED": "nelze použít", "AMBER": "použít s opatrností", "GREEN": "bez zjištěných výhrad"}.items() for x in kv])
    return sources.select("doc_id", "ord", F.format_string("%s: %s (k %s)", "raw_text", F.coalesce(F.try_element_at(said, F.col("light")), F.lit("neznámé")), F.date_format(F.lit(day).cast("date"), "d. M. yyyy")).alias("phrase"))
