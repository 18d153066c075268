"""Cheap labels for citation edges, and the gate before a model's answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kodex.functions.text import alias_form, cited, contains_any, is_verbatim, marked, marked_sentence, sentences, squeeze, truncated
from kodex.patterns import DEPARTURE, NARROWING, PARTY, QUASHING
from kodex.schema import MODEL_LABELS

# Confidences of the rules, and the bar below which the cheap tier hands on.
QUASHED, SUBMITTED, TRIAGED, TRIAGE_BAR = "1.00", "0.95", "0.80", 0.75
DEPARTURE_PANELS = ["extended", "grand", "plenary"]


def quashed_sentence(verdict: Column, names: Column, cited_on: Column, citing_on: Column) -> Column:
    """The verdict's sentence that quashes a decision called one of `names`; null if none, or if that decision isn't the earlier one."""
    return F.when(F.coalesce(cited_on < citing_on, F.lit(False)), marked_sentence(verdict, QUASHING, F.transform(names, alias_form)))


def route(edges: DataFrame) -> DataFrame:
    """edges with route, label, confidence, evidence_span, reason.

    edges: citing_panel, citing_date, cited_date, raw_text, context array, focus, verdict_text, cited_names array. In this
    order: structural QUASHED and MENTIONED; escalation of a special panel, of departing and of narrowing language in the
    context; triage FOLLOWED with the citation's sentence, or escalation where it can't be found. One projection, no shuffle.
    """
    here = F.coalesce(F.get("context", F.col("focus")), F.lit(""))
    around = F.array_join("context", "\n\n")
    rows = edges.withColumn("_q", quashed_sentence(F.col("verdict_text"), F.col("cited_names"), F.col("cited_date"), F.col("citing_date")))
    # the paragraph is split once for both rules; no phrase holds what ends a sentence, so the context needn't be split
    rows = rows.withColumn("_s", F.when(squeeze(F.col("raw_text")) != "", sentences(here)))
    rows = rows.withColumn("_m", F.when(contains_any(here, PARTY), marked(F.col("_s"), PARTY, F.array(alias_form(F.col("raw_text")))))).withColumn("_c", cited(F.col("_s"), F.col("raw_text")))
    departs, narrows = contains_any(around, DEPARTURE), contains_any(around, NARROWING)
    why = (
        F.when(F.col("_q").isNotNull(), "quashed").when(F.col("_m").isNotNull(), "party_submission").when(F.col("citing_panel").isin(DEPARTURE_PANELS), "panel_type")
        .when(departs, "departure_marker").when(narrows, "narrowing_marker").when(F.col("_c").isNull(), "low_confidence").otherwise("triage")
    )
    rows = rows.withColumn("reason", why)
    by = lambda q, m, t: F.when(F.col("reason") == "quashed", q).when(F.col("reason") == "party_submission", m).when(F.col("reason") == "triage", t)
    return rows.select(
        *edges.columns,
        F.coalesce(by(F.lit("structural"), F.lit("structural"), F.lit("triage")), F.lit("reasoning")).alias("route"),
        by(F.lit("QUASHED"), F.lit("MENTIONED"), F.lit("FOLLOWED")).alias("label"),
        by(F.lit(QUASHED), F.lit(SUBMITTED), F.lit(TRIAGED)).cast("decimal(3,2)").alias("confidence"),
        by(F.col("_q"), F.col("_m"), F.col("_c")).alias("evidence_span"),
        "reason",
    )


REPLY = "label string, verdict string, material string, confidence string, evidence_span string, reasoning string"
# The verdicts on whether a decision carries a proposition, and on whether a rewording matters.
PROPOSITION = ["SUPPORTS", "OVERBROAD", "UNRELATED", "CONTRADICTS"]
MATERIAL = ["true", "false"]


def violation(reply: Column, context: Column, field: str = "label", allowed: list[str] = MODEL_LABELS) -> Column:
    """What is wrong with a model's JSON reply, null if nothing: its `field`, confidence, span in this order."""
    r = F.from_json(reply, REPLY)
    raw = F.get_json_object(reply, "$.confidence")
    # a number isn't quoted in the JSON text, a truth value isn't a number
    numeric = raw.try_cast("double").isNotNull() & reply.rlike(r'"confidence"\s*:\s*-?[0-9]')
    n = raw.try_cast("double")
    return (
        F.when(r.isNull() | r[field].isNull() | ~r[field].isin(allowed), F.concat(F.lit(f"{field}: "), F.coalesce(r[field], F.lit("none"))))
        .when(~F.coalesce(numeric, F.lit(False)), "confidence: not a number")
        .when((n < 0) | (n > 1), "confidence: outside 0 to 1")
        .when(F.coalesce(F.trim(r["evidence_span"]), F.lit("")) == "", "evidence_span: empty")
        .when(~is_verbatim(r["evidence_span"], context), F.concat(F.lit("evidence_span: not in the context: "), truncated(r["evidence_span"])))
    )


def judged(edges: DataFrame, replies: DataFrame) -> DataFrame:
    """Escalated edges with the first acceptable reply of at most two, else UNCLASSIFIED with confidence 0.

    edges: cache_key, context_text, fallback_span; replies: cache_key, attempt, reply. Every reply, also one from the cache,
    passes the gate. Edges of one key share its replies: a key is judged once.
    """
    tried = replies.filter("attempt <= 2").groupBy("cache_key").agg(F.array_sort(F.collect_list(F.struct("attempt", "reply"))).alias("_tries"))
    rows = edges.join(tried, "cache_key", "left")
    good = F.filter(F.coalesce("_tries", F.array().cast("array<struct<attempt:int,reply:string>>")), lambda t: violation(t["reply"], F.col("context_text")).isNull())
    rows = rows.withColumn("_r", F.from_json(F.get(good, F.lit(0))["reply"], REPLY))
    return rows.select(
        *edges.columns,
        F.coalesce("_r.label", F.lit("UNCLASSIFIED")).alias("label"),
        F.coalesce(F.round(F.col("_r.confidence").try_cast("double"), 2), F.lit(0.0)).cast("decimal(3,2)").alias("confidence"),
        F.coalesce(squeeze(F.col("_r.evidence_span")), F.col("fallback_span")).alias("evidence_span"),
    )


def judged_pairs(pairs: DataFrame, replies: DataFrame) -> DataFrame:
    """(from_version_id, to_version_id, material, confidence, evidence_span) of the pairs with an acceptable reply of at most two.

    A pair without one gets no row: a rewording that wasn't judged must not count. pairs: the ids and context_text;
    replies: the ids, attempt, reply. Each pair of versions is judged once, however many decisions rely on it.
    """
    ids = ["from_version_id", "to_version_id"]
    good = replies.filter("attempt <= 2").join(pairs.select(*ids, "context_text").distinct(), ids).filter(violation(F.col("reply"), F.col("context_text"), "material", MATERIAL).isNull())
    first = good.groupBy(*ids).agg(F.min_by("reply", "attempt").alias("reply")).withColumn("_r", F.from_json("reply", REPLY))
    return first.select(*ids, (F.col("_r.material") == "true").alias("material"), F.round(F.col("_r.confidence").cast("double"), 2).cast("decimal(3,2)").alias("confidence"), squeeze(F.col("_r.evidence_span")).alias("evidence_span"))


def treatment_key(citing: Column, cited: Column, idx: Column, version: str) -> Column:
    return F.concat_ws("|", F.lit("treatment"), citing, cited, F.coalesce(idx.cast("string"), F.lit("-")), F.lit(version))


def route_shares(routed: DataFrame) -> DataFrame:
    """(route, reason, n, share)."""
    sums = routed.groupBy("route", "reason").agg(F.count("*").alias("n"))
    whole = sums.agg(F.sum("n").alias("_all"))
    return sums.join(F.broadcast(whole)).withColumn("share", F.round(F.col("n") / F.col("_all"), 6)).drop("_all")
