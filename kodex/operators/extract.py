"""Citation spans, their resolution, and sentences that refer back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kodex.functions.regex import let, located, parted, running
from kodex.functions.text import alias_form, contains_any, sentences
from kodex.patterns import PATTERNS, TRIGGERS
from kodex.session import enriched, salted_join

def kept_spans(text: Column) -> Column:
    """array<struct<start, back, pattern_ord, raw>>: the catalogue's matches in one text, contained ones dropped; back is minus the end.

    A span goes if a strictly longer one contains it, or an equal one of an earlier pattern does; crossing spans both stay.
    In the order of start, falling end and pattern, that is a span whose end doesn't go beyond all ends before it.
    """
    # one expression finds the matches of all patterns; a text without a pattern's fixed part isn't searched for it
    none = F.array().cast("array<string>")
    cut = F.array(*[F.when(text.contains(p.holds), parted(text, p.regex)).otherwise(none) for p in PATTERNS])
    entry = lambda m, i: F.struct(m["start"].alias("start"), (-m["end"]).alias("back"), i.alias("pattern_ord"), m["raw"].alias("raw"))
    found = F.flatten(F.transform(cut, lambda parts, i: F.transform(located(parts), lambda m: entry(m, i))))

    def outer(every: Column) -> Column:
        least = running(F.transform(every, lambda s: s["back"]), "int", F.least, F.lit(0))
        return let(least, lambda low: F.filter(every, lambda s, i: (i == 0) | (s["back"] < F.get(low, i - 1))))

    return let(F.array_sort(found), lambda e: F.when(F.size(e) > 1, outer(e)).otherwise(e))


def named_groups(pattern_ord: Column, raw: Column) -> Column:
    """The map of a match's groups; absent ones aren't in it."""
    pairs = lambda p: F.array(*[F.struct(F.lit(g).alias("key"), F.regexp_extract(raw, p.regex, k + 1).alias("value")) for k, g in enumerate(p.groups)])
    some = reduce(lambda w, ip: w.when(pattern_ord == ip[0], pairs(ip[1])), enumerate(PATTERNS[1:], 1), F.when(pattern_ord == 0, pairs(PATTERNS[0])))
    return F.map_from_entries(F.filter(some, lambda e: e["value"] != ""))


def kind_of(pattern_ord: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p.kind) for p in PATTERNS]), pattern_ord + 1)


def spans(text: Column) -> Column:
    """array<struct<pattern_ord, kind, raw, start, end, groups>> of kept_spans, sorted by start, end, pattern.

    A pattern runs only over texts that hold its fixed part.
    """
    entry = lambda s: F.struct(s["pattern_ord"].alias("pattern_ord"), kind_of(s["pattern_ord"]).alias("kind"), s["raw"].alias("raw"), s["start"].alias("start"), (-s["back"]).alias("end"), named_groups(s["pattern_ord"], s["raw"]).alias("groups"))
    # no two kept spans begin at one place, so their order is that of their ends as well
    return F.transform(kept_spans(text), entry)


def references(paragraphs: DataFrame) -> DataFrame:
    """(doc, paragraph_idx, kind, raw_text, span_start, span_end, pattern_ord, groups) of (doc, paragraph_idx, body).

    Map-only. Null bodies have no spans; paragraphs without the fixed part of any pattern aren't searched. Groups are read
    off the kept matches alone.
    """
    some = reduce(lambda a, b: a | b, [F.col("body").contains(p.holds) for p in PATTERNS])
    found = paragraphs.filter(some).select("doc", "paragraph_idx", F.explode(kept_spans(F.col("body"))).alias("s"))
    return found.select("doc", "paragraph_idx", kind_of(F.col("s.pattern_ord")).alias("kind"), F.col("s.raw").alias("raw_text"), F.col("s.start").alias("span_start"), (-F.col("s.back")).alias("span_end"), F.col("s.pattern_ord").alias("pattern_ord"), named_groups(F.col("s.pattern_ord"), F.col("s.raw")).alias("groups"))


def alias_candidates(kind: Column, raw: Column, groups: Column, bare_fallback: bool = False) -> Column:
    """Alias forms to try, the most specific first; an empty array for provisions.

    A number with a sheet is looked up with it alone: a case has many decisions. `bare_fallback` adds the bare number.
    """
    g = lambda name: F.try_element_at(groups, F.lit(name))
    full = F.when(g("sheet_no").isNotNull(), F.concat(g("ref_no"), F.lit("-"), g("sheet_no")))
    ref = [F.coalesce(full, g("ref_no"))] + ([g("ref_no")] if bare_fallback else [])
    journal = F.concat(F.lit("R "), g("journal_seq"), F.lit("/"), g("journal_year"))
    tried = F.when(kind == "ref_no", F.array(*ref)).when(kind == "case_no", F.array(g("case_no"))).when(kind == "ecli", F.array(raw)).when(kind == "journal_no", F.array(journal, raw)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(tried, alias_form), lambda a: a.isNotNull() & (a != "")))


def resolve_decisions(refs: DataFrame, aliases: DataFrame, keys: list[str], bare_fallback: bool = False) -> DataFrame:
    """refs with resolved_ecli: the decision of the first candidate that is an alias; null where none is.

    `aliases` is (alias, ecli), one row per alias in its stored form. Distinct candidates are few against the citations of
    a popular decision, so the lookup is an equi-join that is salted on such aliases.
    """
    tried = refs.select(*keys, F.posexplode(alias_candidates(F.col("kind"), F.col("raw_text"), F.col("groups"), bare_fallback)).alias("pos", "alias"))
    hits = salted_join(tried, aliases.select("alias", "ecli"), ["alias"])
    first = hits.groupBy(*keys).agg(F.min_by("ecli", "pos").alias("resolved_ecli"))
    return refs.join(first, keys, "left")


#: Citations of a document that one task carries the act forward through.
STRETCH = 4096


def carry_acts(refs: DataFrame) -> DataFrame:
    """Provision citations of refs with act_no and basis: explicit, backward-scan, document-mode, or null where no act is known.

    Without an act of its own a citation has the last explicit one before it in the document, else the act that the document
    names most often (of equals the one named first). A document is cut into stretches of paragraphs, so that no task holds
    all of a long one: the last act of each stretch is carried over from the stretches before it.
    """
    rows = refs.filter("kind = 'provision'").withColumn("_act", F.try_element_at("groups", F.lit("act_no"))).withColumn("_part", F.floor(F.col("paragraph_idx") / STRETCH))
    at = F.struct("paragraph_idx", "span_start", "span_end")
    w = Window.partitionBy("doc", "_part").orderBy("paragraph_idx", "span_start", "span_end", "pattern_ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_before", F.last("_act", ignorenulls=True).over(w))
    parts = rows.groupBy("doc", "_part").agg(F.max_by("_act", F.when(F.col("_act").isNotNull(), at)).alias("_last"))
    over = Window.partitionBy("doc").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_carried", F.last("_last", ignorenulls=True).over(over)).drop("_last")
    named = rows.filter("_act is not null").groupBy("doc", "_act").agg(F.count("*").alias("_n"), F.min(at).alias("_first"))
    modes = named.groupBy("doc").agg(F.min_by("_act", F.struct(-F.col("_n"), "_first")).alias("_mode"))
    held = refs.select("doc", F.floor(F.col("paragraph_idx") / STRETCH).alias("_part"))
    rows = enriched(enriched(rows, parts, ["doc", "_part"], "inner", counted=held), modes, ["doc"], counted=held)
    earlier = F.coalesce("_before", "_carried")
    basis = F.when(F.col("_act").isNotNull(), "explicit").when(earlier.isNotNull(), "backward-scan").when(F.col("_mode").isNotNull(), "document-mode")
    return rows.withColumn("act_no", F.coalesce("_act", earlier, "_mode")).withColumn("basis", basis).drop("_act", "_part", "_before", "_carried", "_mode")


def resolve_provisions(refs: DataFrame, provisions: DataFrame) -> DataFrame:
    """carry_acts with resolved_provision_id; a citation without subsection matches only a provision without one."""
    rows = carry_acts(refs).withColumn("section", F.try_element_at("groups", F.lit("section"))).withColumn("_sub", F.coalesce(F.try_element_at("groups", F.lit("subsec")), F.lit("")))
    known = provisions.select("act_no", "section", F.coalesce("subsec", F.lit("")).alias("_sub"), F.col("id").alias("resolved_provision_id"))
    return enriched(rows, known, ["act_no", "section", "_sub"]).withColumn("subsec", F.nullif("_sub", F.lit(""))).drop("_sub")


def resolution_stats(refs: DataFrame) -> DataFrame:
    """(kind, resolved, unresolved, coverage) of (kind, resolved boolean)."""
    sums = refs.groupBy("kind").agg(F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"))
    return sums.withColumn("coverage", F.round(F.coalesce(F.try_divide("resolved", F.col("resolved") + F.col("unresolved")), F.lit(1.0)), 6))


def back_references(paragraphs: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc, paragraph_idx, start, sentence): sentences with a trigger phrase that no reference overlaps."""
    some = paragraphs.filter(contains_any(F.col("body"), TRIGGERS))
    said = some.select("doc", "paragraph_idx", F.inline(F.filter(sentences(F.col("body")), lambda s: contains_any(s["sentence"], TRIGGERS))))
    spans_ = refs.select("doc", "paragraph_idx", "span_start", "span_end")
    overlap = [said.doc == spans_.doc, said.paragraph_idx == spans_.paragraph_idx, spans_.span_start < said.start + F.length(said.sentence), spans_.span_end > said.start]
    return said.join(spans_, overlap, "left_anti")


def preceding_context(paragraphs: DataFrame, back: int = 3) -> DataFrame:
    """(doc, paragraph_idx, context): the bodies at the `back` index positions before each paragraph, blanks left out, with blank lines between.

    Each body is sent to the positions after it, so no document is gathered into one task.
    """
    sent = paragraphs.filter(F.trim("body") != "").select("doc", "paragraph_idx", F.explode(F.sequence(F.lit(1), F.lit(back))).alias("_k"), F.trim("body").alias("body"))
    gathered = sent.groupBy("doc", (F.col("paragraph_idx") + F.col("_k")).alias("paragraph_idx")).agg(F.array_sort(F.collect_list(F.struct((-F.col("_k")).alias("k"), "body"))).alias("_c"))
    keyed = paragraphs.select("doc", "paragraph_idx").distinct().join(gathered, ["doc", "paragraph_idx"], "left")
    return keyed.select("doc", "paragraph_idx", F.coalesce(F.array_join(F.col("_c.body"), "\n\n"), F.lit("")).alias("context"))


def allowed_answers(answers: DataFrame, resolved: DataFrame) -> DataFrame:
    """Distinct (doc, sentence_id, ecli) of a model's answers that name a decision which the same document cites anyway."""
    known = resolved.filter("resolved_ecli is not null").select("doc", F.col("resolved_ecli").alias("ecli")).distinct()
    return answers.select("doc", "sentence_id", "ecli").distinct().join(known, ["doc", "ecli"], "left_semi")
