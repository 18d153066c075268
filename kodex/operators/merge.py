"""Upserts, insert-ignores and timeline merges as whole-table transformations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kodex.functions.legal import sign_spellings
from kodex.functions.text import alias_form
from kodex.operators.graph import latest
from kodex.session import salted_join, stage

#: Kinds of alias in the order in which a decision's own ones are kept.
ALIAS_KINDS = [("ecli_variant", "ecli"), ("case_no", "case_no"), ("ref_no", "ref_no"), ("journal_no", "journal_no")]


def upsert_decisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """old overwritten by new per ecli, except that a null ratio_summary in new keeps the old one.

    Within `new` the latest fetch wins, of equals the greater source_url, then panel_type; ratio_summary is the latest
    that isn't null. Applying the same batch twice changes nothing.
    """
    rest = [c for c in new.columns if c not in ("ecli", "ratio_summary")]
    order = F.struct("fetched_at", "source_url", "panel_type")
    batch = new.groupBy("ecli").agg(F.max_by(F.struct(*rest), order).alias("_r"), F.max_by("ratio_summary", F.when(F.col("ratio_summary").isNotNull(), order)).alias("ratio_summary"))
    batch = batch.select("ecli", *[F.col(f"_r.{c}").alias(c) for c in rest], "ratio_summary", F.lit(1).alias("_new"))
    joined = old.alias("o").join(batch.alias("n"), "ecli", "full")
    return joined.select("ecli", *[F.when(F.col("n._new") == 1, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest], F.coalesce("n.ratio_summary", "o.ratio_summary").alias("ratio_summary")).select(*new.columns)


def current_decisions(fetched: DataFrame) -> DataFrame:
    """One row per ecli of a table in which decisions were fetched again."""
    return upsert_decisions(fetched.limit(0), fetched)


def alias_rows(decisions: DataFrame) -> DataFrame:
    """(alias, alias_kind, ecli): up to four aliases of each decision in their stored form, each once, the ecli's own kind first."""
    entries = F.array(*[F.struct(F.lit(i).alias("ord"), alias_form(F.col(c)).alias("alias"), F.lit(kind).alias("alias_kind")) for i, (kind, c) in enumerate(ALIAS_KINDS)])
    rows = decisions.select("ecli", F.inline(entries)).filter("alias is not null and alias <> ''")
    return rows.groupBy("ecli", "alias").agg(F.min_by("alias_kind", "ord").alias("alias_kind")).select("alias", "alias_kind", "ecli")


def sign_alias_rows(decisions: DataFrame) -> DataFrame:
    """(alias, alias_kind, ecli): both spacings of each constitutional case number."""
    return decisions.select("ecli", F.explode(F.transform(sign_spellings(F.col("case_no")), alias_form)).alias("alias")).select("alias", F.lit("case_no").alias("alias_kind"), "ecli").distinct()


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """old and those rows of new whose key it lacks; of several new rows of a key the least in `order` comes first."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*new.columns)
    missing = first
    cond = None
    o = old.select(*[F.col(k).alias(f"_o_{k}") for k in keys])
    for k in keys:
        c = missing[k].eqNullSafe(o[f"_o_{k}"])
        cond = c if cond is None else cond & c
    return old.select(*new.columns).unionByName(missing.join(o, cond, "left_anti"))


def first_writer(aliases: DataFrame) -> DataFrame:
    """One row per alias in its stored form: the one with the least alias_id."""
    rows = aliases.filter("alias is not null").select(alias_form(F.col("alias")).alias("alias"), "alias_kind", "ecli", "alias_id").filter("alias <> ''")
    return rows.groupBy("alias").agg(F.min_by(F.struct("alias_kind", "ecli"), "alias_id").alias("r")).select("alias", "r.alias_kind", "r.ecli")


def replace_paragraphs(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the paragraphs of every decision in new replaced by new's non-blank ones; of several of one idx the greatest para_id."""
    fresh = latest(new.filter(F.trim("body") != ""), ["ecli", "idx"], ["para_id"])
    kept = salted_join(old, new.select("ecli").distinct(), ["ecli"], "left_anti")
    return kept.select(*new.columns).unionByName(fresh.select(*new.columns))


def corpus_meta(decisions: DataFrame) -> DataFrame:
    """(court_code, decision_count, covered_through) per court."""
    return decisions.groupBy("court_code").agg(F.count("*").alias("decision_count"), F.max("decided_on").alias("covered_through"))


def find_or_insert(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """known provisions and new ones for the keys of wanted that it lacks, null subsections being equal; new ids follow the greatest.

    Ids are ranks in the order of the keys, counted over ranges of their hash so that no task numbers all new keys.
    """
    sub = lambda df: df.withColumn("_s", F.coalesce("subsec", F.lit("")))
    new = sub(wanted).select("act_no", "section", "_s").filter("act_no is not null and section is not null").distinct().join(sub(known).select("act_no", "section", "_s"), ["act_no", "section", "_s"], "left_anti")
    parts = new.withColumn("_b", F.pmod(F.xxhash64("act_no", "section", "_s"), F.lit(256)))
    sizes = parts.groupBy("_b").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).drop("_n")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    rows = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy("act_no", "section", "_s"))).join(F.broadcast(offsets), "_b").join(F.broadcast(top))
    fresh = rows.select((F.col("_top") + F.col("_before") + F.col("_i")).alias("id"), "act_no", "section", F.nullif("_s", F.lit("")).alias("subsec"))
    return known.select("id", "act_no", "section", "subsec").unionByName(fresh)


CITATION_KEY = ["citing_ecli", "cited_ecli", "cited_provision", "paragraph_idx", "raw_text", "extractor"]


def citations(references: DataFrame) -> DataFrame:
    """Resolved references as citation rows: equal ones of a paragraph once, with the least ref_id as id."""
    rows = references.filter("resolved_ecli is not null or resolved_provision_id is not null").select(F.col("ref_id").alias("id"), F.col("ecli").alias("citing_ecli"), F.col("resolved_ecli").alias("cited_ecli"), F.col("resolved_provision_id").alias("cited_provision"), "paragraph_idx", "raw_text", "extractor")
    return rows.groupBy(*CITATION_KEY).agg(F.min("id").alias("id")).select("id", *CITATION_KEY)


def timeline(records: DataFrame) -> DataFrame:
    """Version windows of each provision from records (provision_id, body, valid_from, valid_to, derogated_by).

    In order of valid_from: neighbours of the same body and derogation are one version with the first start and the last
    declared end; a version then ends the day before the next, or on its declared end where that is earlier. Inverted
    windows, and provisions of which two records start on one day, are refused: see timeline_refusals.
    """
    refused = timeline_refusals(records).select("provision_id").distinct()
    w = Window.partitionBy("provision_id").orderBy("valid_from")
    rows = records.join(refused, "provision_id", "left_anti")
    same = F.col("body").eqNullSafe(F.lag("body").over(w)) & F.col("derogated_by").eqNullSafe(F.lag("derogated_by").over(w)) & F.lag("valid_from").over(w).isNotNull()
    rows = rows.withColumn("_run", F.sum(F.when(same, 0).otherwise(1)).over(w))
    runs = rows.groupBy("provision_id", "_run").agg(F.min("valid_from").alias("valid_from"), F.max_by("valid_to", "valid_from").alias("valid_to"), F.min_by("body", "valid_from").alias("body"), F.min_by("derogated_by", "valid_from").alias("derogated_by"))
    return runs.withColumn("valid_to", F.least("valid_to", F.date_sub(F.lead("valid_from").over(w), 1))).drop("_run")


def timeline_refusals(records: DataFrame) -> DataFrame:
    """(provision_id, valid_from, reason) of records that make a timeline undecidable."""
    inverted = records.filter("valid_to < valid_from").select("provision_id", "valid_from", F.lit("inverted").alias("reason"))
    clash = records.groupBy("provision_id", "valid_from").count().filter("count > 1").select("provision_id", "valid_from", F.lit("same start").alias("reason"))
    return inverted.unionByName(clash).distinct()


def timeline_actions(old: DataFrame, new: DataFrame, judgements: DataFrame | None = None) -> DataFrame:
    """(provision_id, valid_from, id, action): insert, update, unchanged or delete, matched by start, ids kept.

    Only provisions that occur in new are touched. With judgements, a provision of which a version would be deleted that a
    judgement names is refused whole: `refused` stands for each of its actions, and referenced_versions says why.
    """
    fields = ["body", "valid_to", "derogated_by"]
    o = old.join(new.select("provision_id").distinct(), "provision_id", "left_semi").select("provision_id", "valid_from", "id", F.struct(*fields).alias("_old"))
    n = new.select("provision_id", "valid_from", F.struct(*fields).alias("_new"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("update")
    rows = o.join(n, ["provision_id", "valid_from"], "full").select("provision_id", "valid_from", "id", action.alias("action"))
    if judgements is None:
        return rows
    rows = stage(rows)
    held = referenced_versions(rows, judgements).select("provision_id").distinct().withColumn("_held", F.lit(True))
    return rows.join(held, "provision_id", "left").select("provision_id", "valid_from", "id", F.when(F.col("_held"), "refused").otherwise(F.col("action")).alias("action"))


def referenced_versions(actions: DataFrame, judgements: DataFrame) -> DataFrame:
    """(provision_id, id) of versions to be deleted that a judgement names on either side: must be empty before a timeline is written."""
    named = judgements.select(F.explode(F.array("from_version_id", "to_version_id")).alias("id")).distinct()
    return actions.filter("action = 'delete'").select("provision_id", "id").join(named, "id", "left_semi").select("provision_id", "id")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """old with the rows of new put in the place of those of the same (null-safe) keys; of several new rows the greatest in `order`."""
    fresh = latest(new, keys, order).select(*old.columns)
    o = old.withColumn("_k", F.struct(*keys))
    n = fresh.select(F.struct(*keys).alias("_n"))
    return o.join(n, F.col("_k").eqNullSafe(F.col("_n")), "left_anti").drop("_k").unionByName(fresh)


def samples_until(samples: DataFrame, totals: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, first_pass) over passes of unstable samples: each key by its first pass, passes taken until the group's total is reached.

    samples: group, pass (from 0), key; totals: group, total. A pass is used if the union of those before it falls short of
    the total; a group without a total, or with 0, gives nothing. A group has few passes, so their running counts are small.
    """
    first = samples.groupBy(group, key).agg(F.min("pass").alias("first_pass"))
    per = first.groupBy(group, "first_pass").agg(F.count("*").alias("_n"))
    before = per.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("first_pass").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    used = before.join(totals.filter("total > 0"), group).filter("_before < total").select(group, "first_pass")
    return salted_join(first, used, [group, "first_pass"], "left_semi").select(group, key, "first_pass")


def unknown_derogations(new: DataFrame, decisions: DataFrame) -> DataFrame:
    """Versions whose derogating decision isn't known: must be empty before a timeline is written."""
    named = new.filter("derogated_by is not null")
    return named.join(decisions.select(F.col("ecli").alias("derogated_by")).distinct(), "derogated_by", "left_anti").select("provision_id", "valid_from", "derogated_by")


def assembled_fragments(fragments: DataFrame) -> DataFrame:
    """(act_no, section, subsec, body): fragment texts joined in order, for the section and for each subsection.

    fragments: act_no, section, subsec, ord, text. Two grains from one pass: each fragment counts for both. The parts of one
    section are bounded by the statute.
    """
    rows = fragments.filter("section is not null and text <> ''").select("act_no", "section", F.explode(F.array_distinct(F.array(F.lit(None).cast("string"), "subsec"))).alias("subsec"), "ord", "text")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("act_no", "section", "subsec").agg(body.alias("body"))
