"""Queries of documents, gates, lookups over reference spans, and streams."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kodex import schema
from kodex.functions import legal
from kodex.functions import text as tx
from kodex.operators import classify, document, extract, graph, merge, model
from kodex.operators.evaluate import span_scores
from kodex.patterns import PATTERNS
from kodex.plans import graph as graph_plans
from kodex.plans import text as text_plans
from kodex.plans.derived import AS_OF, citations, day, decisions, judgements, sql, treatments
from kodex.session import enriched, stage
from kodex.sources.tables import table
from kodex.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


# --- documents


_EVERY = """everyone as (select doc, paragraph_idx, span_start, raw_text, resolved_ecli ecli, null::bigint provision_id, 'not in corpus' reason from cases
  union all select doc, paragraph_idx, span_start, raw_text, null, resolved_provision_id, case when act_no is null then 'not resolved' else 'not in corpus' end from provs),
found as (select doc, ecli, provision_id, min((paragraph_idx, span_start)) f, arg_min(raw_text, (paragraph_idx, span_start)) raw_text, count(*) mentions from everyone where ecli is not null or provision_id is not null group by 1, 2, 3),
sources as (select doc doc_id, row_number() over (partition by doc order by f)::int ord, ecli, provision_id, raw_text, mentions from found)"""
_LIGHTS = """lights as (select d.ecli, case when min(row_ord) <= 3 then 'RED' when min(row_ord) is not null then 'AMBER' else 'GREEN' end light from dec d left join every e on e.ecli = d.ecli group by d.ecli),
provision_lights as (select p.id provision_id, case when g.derogated_by is null then 'GREEN' else 'RED' end light from provision p left join derog g on g.provision_id = p.id),
checked as (select s.*, coalesce(l.light, p.light) light from sources s left join lights l on l.ecli = s.ecli left join provision_lights p on p.provision_id = s.provision_id)"""
_DOCUMENTS = f"select doc_id doc, unnest(c) body, generate_subscripts(c, 1)::int paragraph_idx from ({text_plans.ORACLE['f6_document_paragraphs'].split('), q as (')[0].removeprefix('with p as (')}) x, lateral (select case when len(a) > 1 or len(b) <= len(a) then a else b end c)"


def _check_sql(paragraphs: str, select: str) -> str:
    return sql(graph_plans._STANDING, "").rstrip() + ",\n" + ",\n".join([text_plans._refs_sql(paragraphs), text_plans._RESOLVED, _EVERY, _LIGHTS]) + "\n" + select


def _sources(spark, d, rows):
    return document.cited_targets(rows, merge.first_writer(table(spark, d, "decision_alias")), table(spark, d, "provision"))


def _documents(spark, d):
    return document.document_paragraphs(table(spark, d, "documents").select("doc_id", "text"))


def _checked(spark, d):
    return document.check(_sources(spark, d, text_plans._paragraphs(spark, d))[0], graph_plans.c20_standing(spark, d), graph_plans.c21_provision_standing(spark, d))


@query(_check_sql(text_plans._PARA, "select doc_id, ord, ecli, provision_id, raw_text, mentions, light from checked"))
def c22_decision_check(spark, d):
    """What every decision cites in its text and how that stands."""
    return _checked(spark, d)


@query(_check_sql(_DOCUMENTS, "select doc_id, ord, ecli, provision_id, raw_text, mentions, light from checked"))
def c22_document_check(spark, d):
    """What every document of the corpus cites and how it stands."""
    return document.check(_sources(spark, d, _documents(spark, d))[0], graph_plans.c20_standing(spark, d), graph_plans.c21_provision_standing(spark, d))


@query(f"with {text_plans._refs_sql(_DOCUMENTS)}, {text_plans._RESOLVED}, {_EVERY} select doc doc_id, raw_text, reason, min(paragraph_idx) first_paragraph from everyone where ecli is null and provision_id is null group by 1, 2, 3")
def c22_document_unresolved(spark, d):
    return _sources(spark, d, _documents(spark, d))[1]


@query(_check_sql(text_plans._PARA, "select doc_id, ord, raw_text || ': ' || case light when 'RED' then 'nelze použít' when 'AMBER' then 'použít s opatrností' when 'GREEN' then 'bez zjištěných výhrad' else 'neznámé' end || ' (k 30. 6. 2022)' phrase from checked"))
def f25_spoken_checks(spark, d):
    return document.spoken(_checked(spark, d), AS_OF)


# --- lookups over reference spans


def _spans(spark, d):
    """Stored citations with the groups of the first pattern of their kind that their text fits."""
    rows = table(spark, d, "reference_span").select("ref_id", F.col("ecli").alias("doc"), "paragraph_idx", "kind", "raw_text", "span_start", "span_end")
    which = F.coalesce(*[F.when((F.col("kind") == p.kind) & F.col("raw_text").rlike(p.regex), F.lit(i)) for i, p in enumerate(PATTERNS)])
    groups = F.when(which.isNotNull(), extract.named_groups(which, F.col("raw_text"))).otherwise(F.create_map().cast("map<string,string>"))
    return rows.withColumn("groups", groups).withColumn("pattern_ord", F.col("ref_id"))


_FORM = r"lower(trim(regexp_replace({}, '[\s\x{{85}}\p{{Z}}\x1c-\x1f]+', ' ', 'g')))"
_REF, _US, _GEN, _, _R, _PROV = (p.regex for p in PATTERNS)


@query(rf"""with al as (select form, arg_min(ecli, alias_id) ecli from (select *, {_FORM.format('alias')} form from decision_alias) group by form),
r as (select ref_id, kind, raw_text, case kind
  when 'ref_no' then [case when regexp_extract(raw_text, '{_REF}', 2) <> '' then regexp_extract(raw_text, '{_REF}', 1) || '-' || regexp_extract(raw_text, '{_REF}', 2) else regexp_extract(raw_text, '{_REF}', 1) end]
  when 'case_no' then [case when regexp_extract(raw_text, '{_US}', 1) <> '' then regexp_extract(raw_text, '{_US}', 1) else regexp_extract(raw_text, '{_GEN}', 1) end]
  when 'ecli' then [raw_text]
  when 'journal_no' then [case when regexp_matches(raw_text, '{_R}') then 'R ' || regexp_extract(raw_text, '{_R}', 1) || '/' || regexp_extract(raw_text, '{_R}', 2) else '' end, raw_text] else [] end c from reference_span),
e as (select ref_id, unnest(c) x, generate_subscripts(c, 1) o from r),
hit as (select e.ref_id, arg_min(al.ecli, o) ecli from e join al on al.form = {_FORM.format('e.x')} where {_FORM.format('e.x')} <> '' group by 1)
select r.ref_id, hit.ecli resolved_ecli from r left join hit on hit.ref_id = r.ref_id where r.kind <> 'provision'""")
def j9_alias_lookup(spark, d):
    """Each stored citation of a decision resolved again through the aliases."""
    refs = _spans(spark, d).filter("kind <> 'provision'")
    return extract.resolve_decisions(refs, merge.first_writer(table(spark, d, "decision_alias")), ["ref_id"]).select("ref_id", "resolved_ecli")


@query(rf"""with r as (select ref_id, ecli, paragraph_idx, span_start, span_end, nullif(regexp_extract(raw_text, '{_PROV}', 3), '') act from reference_span where kind = 'provision'),
c as (select *, last_value(act ignore nulls) over (partition by ecli order by paragraph_idx, span_start, span_end, ref_id rows between unbounded preceding and 1 preceding) before from r),
m as (select distinct on (ecli) ecli, act as mode from (select ecli, act, count(*) n, min((paragraph_idx, span_start, span_end)) f from r where act is not null group by 1, 2) order by ecli, n desc, f)
select ref_id, coalesce(act, before, mode) act_no, case when act is not null then 'explicit' when before is not null then 'backward-scan' when mode is not null then 'document-mode' end basis from c left join m on m.ecli = c.ecli""")
def w3_carried_acts(spark, d):
    """The act of each stored citation of a provision, and on what basis."""
    return extract.carry_acts(_spans(spark, d)).select("ref_id", "act_no", "basis")


@query("""with p as (select ecli, idx, arg_min(body, para_id) body from decision_paragraph group by 1, 2)
select a.ecli doc, a.idx paragraph_idx, coalesce(string_agg(trim(b.body), chr(10) || chr(10) order by b.idx) filter (trim(b.body) <> ''), '') context from p a left join p b on b.ecli = a.ecli and b.idx between a.idx - 3 and a.idx - 1 group by 1, 2""")
def w2_preceding_context(spark, d):
    rows = table(spark, d, "decision_paragraph").groupBy(F.col("ecli").alias("doc"), F.col("idx").alias("paragraph_idx")).agg(F.min_by("body", "para_id").alias("body"))
    return extract.preceding_context(rows)


@query(sql("dec cit", f"""select c.id, a.panel_type citing_panel, b.decided_on cited_date, (select count(distinct f) from (select unnest([{_FORM.format('b.ecli')}, {_FORM.format('b.case_no')}, {_FORM.format('b.ref_no')}]) f) where f <> '') n_names
from cit c join dec a on a.ecli = c.citing_ecli join dec b on b.ecli = c.cited_ecli"""))
def j16_edges(spark, d):
    """Edges with the number of names under which the cited decision may appear."""
    return text_plans._edges(spark, d).select("id", "citing_panel", "cited_date", F.size("cited_names").cast("long").alias("n_names"))


@query(sql("dec cit trt authority", "select c.id, t.label, t.prompt_version, a.court_code citing_court, b.court_code cited_court, coalesce(u.binding, false) may_depart from cit c join dec a on a.ecli = c.citing_ecli left join dec b on b.ecli = c.cited_ecli left join authority u on u.citing_court = a.court_code and u.citing_panel = a.panel_type and u.cited_court = b.court_code left join trt t on t.citation_id = c.id where t.prompt_version = 'v2' or t.label is null"))
def j18_evaluation_edges(spark, d):
    """Edges of one prompt version for evaluation; edges without any label stay."""
    rows = decisions(spark, d)
    a = rows.select(F.col("ecli").alias("citing_ecli"), F.col("court_code").alias("citing_court"), F.col("panel_type").alias("citing_panel"))
    b = rows.select(F.col("ecli").alias("cited_ecli"), F.col("court_code").alias("cited_court"))
    t = treatments(spark, d).select(F.col("citation_id").alias("id"), "label", "prompt_version")
    edges = enriched(enriched(citations(spark, d), a, ["citing_ecli"], "inner"), b, ["cited_ecli"]).join(F.broadcast(schema.authority(spark)), ["citing_court", "citing_panel", "cited_court"], "left").join(t, "id", "left")
    return edges.filter("prompt_version = 'v2' or label is null").select("id", "label", "prompt_version", "citing_court", "cited_court", F.coalesce("binding", F.lit(False)).alias("may_depart"))


# --- predicates


@query(sql("dec cit", "select c.id, coalesce(b.decided_on < a.decided_on, false) in_order from cit c left join dec a on a.ecli = c.citing_ecli left join dec b on b.ecli = c.cited_ecli"))
def pred7_chronology(spark, d):
    days = decisions(spark, d).select("ecli", "decided_on")
    a, b = days.select(F.col("ecli").alias("citing_ecli"), F.col("decided_on").alias("_a")), days.select(F.col("ecli").alias("cited_ecli"), F.col("decided_on").alias("_b"))
    return enriched(enriched(citations(spark, d), a, ["citing_ecli"]), b, ["cited_ecli"]).select("id", F.coalesce(F.col("_b") < F.col("_a"), F.lit(False)).alias("in_order"))


@query(sql("cit trt", "select label, count(*) filter (confidence >= 0.85) red, count(*) filter (confidence >= 0.60) amber from trt group by label"))
def pred2_confidence_bars(spark, d):
    bar = lambda b: F.col("confidence") >= F.lit(b).cast("decimal(3,2)")
    return treatments(spark, d).groupBy("label").agg(F.count_if(bar("0.85")).alias("red"), F.count_if(bar("0.60")).alias("amber"))


@query("select ecli, court_code from decision where starts_with(ecli, 'ECLI:CZ:NSS:') group by all")
def pred13_court_by_prefix(spark, d):
    return table(spark, d, "decision").filter(F.col("ecli").startswith("ECLI:CZ:NSS:")).select("ecli", "court_code").distinct()


@query("select act_no, section, nullif(subsec, '') subsec, count(*) records from provision_dump group by all")
def a24_provision_groups(spark, d):
    return table(spark, d, "provision_dump").groupBy("act_no", "section", F.nullif("subsec", F.lit("")).alias("subsec")).agg(F.count("*").alias("records"))


@query(f"with a as ({graph_plans.ORACLE['k8_timeline_actions']}) select action, count(*) n from a group by action")
def a21_write_counts(spark, d):
    return graph_plans.k8_timeline_actions(spark, d).groupBy("action").agg(F.count("*").alias("n"))


@query("""select act_no, section, sub as subsec, string_agg(body, chr(10) order by ord) body from (
  select act_no, section, unnest([null, subsec]) sub, generate_subscripts([null, subsec], 1) g, id ord, act_no || ' ' || section || coalesce(' ' || subsec, '') body, subsec from provision) where g = 1 or sub is not null group by 1, 2, 3""")
def a23_assembled_fragments(spark, d):
    """Fragments joined at two grains: each section, and each of its subsections."""
    text = F.concat("act_no", F.lit(" "), "section", F.coalesce(F.concat(F.lit(" "), "subsec"), F.lit("")))
    return merge.assembled_fragments(table(spark, d, "provision").select("act_no", "section", "subsec", F.col("id").alias("ord"), text.alias("text")))


@query("select page_id, prev as before_page, url from (select *, lag(page_id) over (partition by url order by fetched_at, page_id) prev from cached_page where status = 200) where prev is not null")
def k10_overwritten_pages(spark, d):
    """Cached pages that overwrote an earlier one of their url."""
    from pyspark.sql import Window

    # a url's pages are ordered day by day, and the last page of the day before is carried over
    at = F.struct("fetched_at", "page_id")
    rows = table(spark, d, "cached_page").filter("status = 200").select("page_id", "url", "fetched_at", F.to_date("fetched_at").alias("_d"))
    days = rows.groupBy("url", "_d").agg(F.max(at).alias("_last"))
    days = days.withColumn("_carried", F.lag("_last").over(Window.partitionBy("url").orderBy("_d"))["page_id"]).drop("_last")
    within = F.lag("page_id").over(Window.partitionBy("url", "_d").orderBy("fetched_at", "page_id"))
    return rows.withColumn("_w", within).join(days, ["url", "_d"]).withColumn("before_page", F.coalesce("_w", "_carried")).filter("before_page is not null").select("page_id", "before_page", "url")


@query("select url, arg_max(page_id, (fetched_at, page_id)) page_id from cached_page where status = 200 group by url")
def k10_cache(spark, d):
    """The cache after all writes: the last page of each url."""
    return graph.latest(table(spark, d, "cached_page").filter("status = 200").select("url", "page_id", "fetched_at"), ["url"], ["fetched_at", "page_id"]).select("url", "page_id")


# --- prompts and the gate

TEMPLATE = "Citing {{citing}} on {{day}}, cited {{cited}}: {{ratio}}"


@query(sql("dec cit", "select c.id, 'Citing ' || a.ecli || ' on ' || a.decided_on || ', cited ' || b.ecli || ': ' || coalesce(b.ratio_summary, '-') prompt from cit c join dec a on a.ecli = c.citing_ecli join dec b on b.ecli = c.cited_ecli"))
def f21_prompts(spark, d):
    rows = decisions(spark, d)
    a = rows.select(F.col("ecli").alias("citing_ecli"), F.date_format("decided_on", "yyyy-MM-dd").alias("_d"))
    b = rows.select(F.col("ecli").alias("cited_ecli"), "ratio_summary")
    edges = enriched(enriched(citations(spark, d), a, ["citing_ecli"], "inner"), b, ["cited_ecli"], "inner")
    return edges.select("id", tx.render(TEMPLATE, citing=F.col("citing_ecli"), day=F.col("_d"), cited=F.col("cited_ecli"), ratio=F.coalesce("ratio_summary", F.lit("-"))).alias("prompt"))


def _replies(spark, d):
    """A recorded reply for each citation, good or with one of six defects, by its id."""
    k = F.col("id") % 7
    label = F.when(k == 1, "MAYBE").otherwise("FOLLOWED")
    confidence = F.when(k == 2, F.lit('"high"')).when(k == 3, F.lit("1.5")).when(k == 4, F.lit("true")).otherwise(F.lit("0.7"))
    span = F.when(k == 5, F.lit(" ")).when(k == 6, F.lit("never said")).otherwise(F.replace(F.col("raw_text"), F.lit('"'), F.lit("")))
    reply = F.concat(F.lit('{"label": "'), label, F.lit('", "confidence": '), confidence, F.lit(', "evidence_span": "'), span, F.lit('"}'))
    return citations(spark, d).select("id", "citing_ecli", "cited_ecli", "paragraph_idx", "raw_text", reply.alias("reply"))


@query(sql("cit", """select id, case id % 7 when 1 then 'label: MAYBE' when 2 then 'confidence: not a number' when 3 then 'confidence: outside 0 to 1' when 4 then 'confidence: not a number'
when 5 then 'evidence_span: empty' when 6 then 'evidence_span: not in the context: never said' end violation from cit"""))
def f34_gate(spark, d):
    """What is wrong with each recorded reply."""
    return _replies(spark, d).select("id", classify.violation(F.col("reply"), F.concat(F.lit("Viz "), F.replace(F.col("raw_text"), F.lit('"'), F.lit("")), F.lit("."))).alias("violation"))


@query(sql("cit", f"""select id, case when id % 7 = 0 then 'FOLLOWED' else 'UNCLASSIFIED' end as label, cast(case when id % 7 = 0 then 0.7 else 0 end as decimal(3,2)) confidence,
case when id % 7 = 0 then trim(regexp_replace(replace(raw_text, '"', ''), '[\\s\\x{{85}}\\p{{Z}}\\x1c-\\x1f]+', ' ', 'g')) else raw_text end evidence_span from cit"""))
def c13_judged(spark, d):
    """Escalated edges with the recorded reply where it passes the gate, else unclassified."""
    rows = _replies(spark, d)
    key = F.col("id").cast("string").alias("cache_key")
    edges = rows.select("id", key, F.concat(F.lit("Viz "), F.replace(F.col("raw_text"), F.lit('"'), F.lit("")), F.lit(".")).alias("context_text"), F.col("raw_text").alias("fallback_span"))
    return classify.judged(edges, rows.select(key, F.lit(1).alias("attempt"), "reply")).select("id", "label", "confidence", "evidence_span")


@query(sql("dec", r"select a.ecli, regexp_matches(trim(a.case_no), '^(?i)(?:Pl\.?|[IVX]+\.?)\s*ÚS\s*\d+/\d{2,4}$') same from dec a where a.case_no is not null"))
def f16_same_sign(spark, d):
    """Whether each case number is the same sign as its other spelling."""
    other = F.replace(F.col("case_no"), F.lit(".ÚS"), F.lit(". ÚS"))
    return decisions(spark, d).filter("case_no is not null").select("ecli", legal.same_sign(F.col("case_no"), other).alias("same"))


@query(sql("cit", "select id from cit where id % 7 = 0"))
def f34_good_replies(spark, d):
    return f34_gate(spark, d).filter("violation is null").select("id")


# A stand-in for a model: what it says follows from the number on the first line of the prompt. Of each 7 questions number 1
# is answered well only when asked again, number 2 never; the reply quotes the first word below the first line.


def _say(prompt: str, good: dict) -> str:
    head, _, context = prompt.partition("\n")
    k, word = int(head.split()[0]) % 7, context.split()[0] if context.split() else ""
    bad = k == 2 or k == 1 and "was rejected" not in prompt
    return json.dumps({**good, "confidence": 0.8, "evidence_span": "never said" if bad else word}, ensure_ascii=False)


def say_label(prompt: str) -> str:
    return _say(prompt, {"label": "FOLLOWED"})


def say_material(prompt: str) -> str:
    return _say(prompt, {"material": str(int(prompt.split()[0]) % 2 == 0).lower()})


def say_verdict(prompt: str) -> str:
    return _say(prompt, {"verdict": "SUPPORTS"})


def _cached(prompts, n: str, reply):
    """Recorded replies of each third question, of each second of which the quotation is no longer there."""
    rows = prompts.filter(F.col(n) % 3 == 0)
    span = F.when(F.col(n) % 2 == 0, F.regexp_extract(tx.squeeze(F.col("context_text")), r"^\S+", 0)).otherwise("no longer there")
    return rows.select("cache_key", F.to_json(F.struct(*reply, F.lit(0.9).alias("confidence"), span.alias("evidence_span"))).alias("reply"), F.lit("2024-01-01").cast("date").alias("created_at"))


# where an answer comes from, in SQL: the cache, the first attempt, the second, or nowhere
_FROM = "case when {n} % 3 = 0 and {n} % 2 = 0 then 0 when {n} % 7 = 2 then null when {n} % 7 = 1 then 2 else 1 end"
_WORD = "regexp_extract(" + _FORM.replace("lower(", "(") + r", '^\S+')"


@query(sql("cit", f"""select id, case when a is null then 'UNCLASSIFIED' else 'FOLLOWED' end as label, cast(case when a is null then 0 when a = 0 then 0.9 else 0.8 end as decimal(3,2)) confidence, case when a is null then raw_text else {_WORD.format('raw_text')} end evidence_span, a attempt
from (select *, {_FROM.format(n='id')} a from cit)"""))
def c13_classified(spark, d):
    """Every edge through the whole loop: the cache checked again, the model, one retry, else unclassified."""
    edges = citations(spark, d).select("id", F.concat(F.lit("treatment|"), F.col("id").cast("string")).alias("cache_key"), F.concat(F.col("id").cast("string"), F.lit("\n"), "raw_text").alias("prompt"), F.col("raw_text").alias("context_text"), F.col("raw_text").alias("fallback_span"))
    edges = stage(edges)
    answers, _ = model.answered(edges, _cached(edges, "id", [F.lit("FOLLOWED").alias("label")]), say_label)
    answers = stage(answers)
    rows = classify.judged(edges, answers).select("id", "cache_key", "label", "confidence", "evidence_span")
    return rows.join(answers.select("cache_key", "attempt"), "cache_key", "left").drop("cache_key")


@query(sql("dec cit now then_ jud", f"""select from_version_id, to_version_id, from_version_id % 2 = 0 material, cast(case when a = 0 then 0.9 else 0.8 end as decimal(3,2)) confidence, {_WORD.format('body')} evidence_span from (
  select *, {_FROM.format(n='from_version_id')} a from (select distinct t.id from_version_id, n.id to_version_id, t.body from then_ t join now n on n.provision_id = t.provision_id
    where t.id <> n.id and t.body <> n.body and not exists (select 1 from jud j where j.from_version_id = t.id and j.to_version_id = n.id and j.prompt_version = 'v2'))) where a is not null and trim(body) <> ''"""))
def c14_judged_rewordings(spark, d):
    """The pending rewordings through the loop; one that isn't answered gets no row."""
    versions = table(spark, d, "provision_version")
    pending = graph.pending_rewordings(citations(spark, d), decisions(spark, d), versions, judgements(spark, d), day(), "v2")
    pairs = pending.join(versions.select(F.col("id").alias("from_version_id"), F.col("body").alias("context_text")), "from_version_id")
    key = F.concat_ws("|", F.lit("materiality"), "from_version_id", "to_version_id", F.lit("v2"))
    pairs = stage(pairs.withColumn("cache_key", key).withColumn("prompt", F.concat(F.col("from_version_id").cast("string"), F.lit("\n"), "context_text")))
    answers, _ = model.answered(pairs, _cached(pairs, "from_version_id", [(F.col("from_version_id") % 2 == 0).cast("string").alias("material")]), say_material, "material", classify.MATERIAL)
    replies = pairs.select("cache_key", "from_version_id", "to_version_id").join(answers, "cache_key")
    return classify.judged_pairs(pairs, replies)


@query(sql("dec", f"""select ecli, case when a is null then 'UNCLASSIFIED' else 'SUPPORTS' end verdict, case when a is null then null else {_WORD.format('ratio_summary')} end evidence_span, case when a is null then 'evidence_span: not in the context: never said' end violation
from (select *, {_FROM.format(n='length(ecli)')} a from dec where trim(ratio_summary) <> '')"""))
def c15_checked_propositions(spark, d):
    """Whether each decision's summary carries a claim: the verdict with its quotation, else unclassified with what was wrong."""
    rows = decisions(spark, d).filter("trim(ratio_summary) <> ''").select("ecli", F.length("ecli").alias("n"), F.col("ratio_summary").alias("context_text"))
    key = F.concat_ws("|", F.lit("v1"), "ecli", F.sha2(tx.squeeze(F.col("context_text")), 256))
    rows = stage(rows.withColumn("cache_key", key).withColumn("prompt", F.concat(F.col("n").cast("string"), F.lit("\n"), "context_text")))
    answers, rejected = model.answered(rows, _cached(rows, "n", [F.lit("SUPPORTS").alias("verdict")]), say_verdict, "verdict", classify.PROPOSITION)
    said = rows.select("ecli", "cache_key").join(answers, "cache_key", "left").join(rejected, "cache_key", "left").withColumn("_r", F.from_json("reply", classify.REPLY))
    return said.select("ecli", F.coalesce("_r.verdict", F.lit("UNCLASSIFIED")).alias("verdict"), tx.squeeze(F.col("_r.evidence_span")).alias("evidence_span"), "violation")


@query(sql("cit", """select id, case id % 3 when 1 then 'verdict: MAYBE' when 2 then 'evidence_span: not in the context: never said' end violation from cit"""))
def c15_proposition_gate(spark, d):
    """Recorded verdicts on a proposition through the same gate."""
    k = F.col("id") % 3
    said = F.replace(F.col("raw_text"), F.lit('"'), F.lit(""))
    reply = F.concat(F.lit('{"verdict": "'), F.when(k == 1, "MAYBE").otherwise("SUPPORTS"), F.lit('", "confidence": 1, "evidence_span": "'), F.when(k == 2, F.lit("never said")).otherwise(said), F.lit('"}'))
    return citations(spark, d).select("id", classify.violation(reply, said, "verdict", classify.PROPOSITION).alias("violation"))


@query(sql("cit", """select distinct citing_ecli doc, id sentence_id, case when id % 3 = 0 then citing_ecli else cited_ecli end ecli from cit c where cited_ecli is not null
and exists (select 1 from cit x where x.citing_ecli = c.citing_ecli and x.cited_ecli = case when c.id % 3 = 0 then c.citing_ecli else c.cited_ecli end)"""))
def c7_allowed_answers(spark, d):
    """Answers to back references that name a decision which the document cites; each third answer names the document itself."""
    c = citations(spark, d).filter("cited_ecli is not null")
    answers = c.select(F.col("citing_ecli").alias("doc"), F.col("id").alias("sentence_id"), F.when(F.col("id") % 3 == 0, F.col("citing_ecli")).otherwise(F.col("cited_ecli")).alias("ecli"))
    return extract.allowed_answers(answers, c.select(F.col("citing_ecli").alias("doc"), F.col("cited_ecli").alias("resolved_ecli"))).select("doc", "sentence_id", "ecli")


@query(sql("dec cit trt latest authority labelled", "select cited_ecli, citing_ecli, evidence_span, min(paragraph_idx) first_paragraph from labelled group by all"))
def j20_reason_paragraphs(spark, d):
    """The first paragraph behind each reason, carried along with the evidence instead of looked up again."""
    t = graph.treatments_for(citations(spark, d), treatments(spark, d), decisions(spark, d), schema.authority(spark))
    return t.groupBy("cited_ecli", "citing_ecli", "evidence_span").agg(F.min("paragraph_idx").alias("first_paragraph"))


@query(sql("dec cit then_", "select distinct provision_id, id version_id from then_ where id is not null"))
def c24_wanted_wordings(spark, d):
    """The distinct wordings in force on some citing decision's day."""
    return graph_plans.j3_version_in_force(spark, d).filter("v0_id is not null").select("provision_id", F.col("v0_id").alias("version_id")).distinct()


@query(f"""with al as (select distinct {_FORM.format('alias')} form from decision_alias), m as (select distinct {_FORM.format("regexp_replace(raw_text, '^sp\\. ?zn\\. ?', '')")} form from reference_span where kind = 'case_no')
select form from m where form not in (select form from al where form is not null)""")
def c25_unknown_cases(spark, d):
    """Case numbers that are cited and no alias: what is left to look for."""
    cited = table(spark, d, "reference_span").filter("kind = 'case_no'").select(tx.alias_form(F.regexp_replace("raw_text", r"^sp\. ?zn\. ?", "")).alias("form")).distinct()
    return cited.join(table(spark, d, "decision_alias").select(tx.alias_form(F.col("alias")).alias("form")), "form", "left_anti")


@query(rf"""with {text_plans._CASES}, stored as (select distinct {text_plans._STORED_KEY} as key from (select trim(case_no) c from decision) where regexp_matches(c, '^(?i)(?:Pl\.?|[IVX]+\.?)\s*ÚS\s*\d+/\d{{2,4}}$')),
misses as (select distinct key from histogram where mentions = 1)
select key, spelling, mentions from histogram h where not exists (select 1 from stored s where s.key = h.key) and not exists (select 1 from misses m where m.key = h.key)""")
def c25_pending_cases(spark, d):
    """Cases that are mentioned, not stored and not known to be missing (here: those mentioned once): what is left to fetch, most cited first."""
    found = stage(text_plans.a19_case_histogram(spark, d))
    stored = table(spark, d, "decision").select(legal.sign_key(F.col("case_no")).alias("key")).filter("key is not null")
    misses = found.filter("mentions = 1").select("key")
    return found.join(stored, "key", "left_anti").join(misses, "key", "left_anti").orderBy(F.desc("mentions"), "key")


_H, _N = _FORM.format("p.body"), _FORM.format("r.raw_text")


@query(f"select ref_id, para_id, case when length(n) > 0 then cast((length(h) - length(replace(h, n, ''))) / length(n) as int) else 0 end times from (select r.ref_id, p.para_id, {_H} h, {_N} n from reference_span r join decision_paragraph p on p.ecli = r.ecli and p.idx = r.paragraph_idx)")
def f10_occurrences(spark, d):
    """How often each citation's text occurs in its paragraph."""
    p = table(spark, d, "decision_paragraph").select("ecli", F.col("idx").alias("paragraph_idx"), "para_id", "body")
    rows = table(spark, d, "reference_span").select("ref_id", "ecli", "paragraph_idx", "raw_text").join(p, ["ecli", "paragraph_idx"])
    return rows.select("ref_id", "para_id", tx.occurrences(F.col("body"), F.col("raw_text")).alias("times"))


_AT = r"'(?i)' || list_aggregate(list_transform(string_split(n, ' '), lambda w: regexp_escape(w)), 'string_agg', '[\s\x{85}\p{Z}\x1c-\x1f]+')"


@query(rf"""with r as (select r.ref_id, p.para_id, p.body, trim(regexp_replace(r.raw_text, '[\s\x{{85}}\p{{Z}}\x1c-\x1f]+', ' ', 'g')) n from reference_span r join decision_paragraph p on p.ecli = r.ecli and p.idx = r.paragraph_idx),
f as (select ref_id, para_id, regexp_extract_all(body, {_AT}) ms, string_split_regex(body, {_AT}) pieces from r where n <> ''),
k as (select *, unnest(generate_series(1, len(ms))) k from f where len(ms) > 0)
select ref_id, para_id, k::int place, (list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))::int span_start, length(ms[k])::int n_chars from k""")
def f10_positions(spark, d):
    """Where each citation's text occurs in its paragraph."""
    p = table(spark, d, "decision_paragraph").select("ecli", F.col("idx").alias("paragraph_idx"), "para_id", "body")
    rows = enriched(table(spark, d, "reference_span").select("ref_id", "ecli", "paragraph_idx", "raw_text"), p, ["ecli", "paragraph_idx"], "inner")
    found = rows.select("ref_id", "para_id", F.posexplode(tx.locate(F.col("body"), F.col("raw_text"))).alias("p", "m"))
    return found.select("ref_id", "para_id", (F.col("p") + 1).alias("place"), F.col("m.start").alias("span_start"), (F.col("m.end") - F.col("m.start")).alias("n_chars"))


#: What the first reason in the order of the table is called.
PHRASES = {1: "zrušeno", 2: "překonáno", 3: "předpis zrušen", 4: "rozpor", 5: "zúženo", 6: "předpis změněn", 7: "k posouzení", 8: "opírá se o oslabené"}


@query(sql(graph_plans._STANDING, "select ecli, case min(row_ord) " + " ".join(f"when {k} then '{v}'" for k, v in PHRASES.items()) + " end phrase from every group by ecli"))
def f24_verdict_phrases(spark, d):
    names = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])
    return graph_plans.c19_reasons(spark, d).groupBy("ecli").agg(F.min("row_ord").alias("_o")).select("ecli", F.try_element_at(names, F.col("_o")).alias("phrase"))


@query(sql("cit", "select distinct cited_provision from cit where cited_provision is not null except select provision_id from provision_version"))
def u5_provisions_without_version(spark, d):
    return citations(spark, d).filter("cited_provision is not null").select("cited_provision").subtract(table(spark, d, "provision_version").select(F.col("provision_id").alias("cited_provision")))


@query("""with p as (select ecli, idx, arg_min(body, para_id) body from decision_paragraph group by 1, 2)
select ecli, string_agg(body, ' ' order by idx) heading from (select *, row_number() over (partition by ecli order by idx) r from p) where r <= 4 group by ecli""")
def s20_headings(spark, d):
    """The heading of each decision: its first four paragraphs."""
    from kodex.sources import pages

    return pages.headings(table(spark, d, "decision_paragraph").groupBy("ecli", "idx").agg(F.min_by("body", "para_id").alias("body"))).select("ecli", "heading")


@query()
def s20_decision_dates(spark, d):
    """The heading of each decision with the last date that any of its paragraphs gives, which is the decision's own."""
    from kodex.sources import pages

    rows = pages.headings(table(spark, d, "decision_paragraph").groupBy("ecli", "idx").agg(F.min_by("body", "para_id").alias("body")))
    return rows.select("ecli", "heading", F.date_format("dated_on", "yyyy-MM-dd").alias("dated_on"))


@query(f"""with {text_plans._refs_sql(text_plans._PARA)}, {text_plans._RESOLVED}
select (select count(distinct doc) from para) decisions, (select count(*) from refs) as refs, (select count(resolved_ecli) from cases) decision_hits, (select count(resolved_provision_id) from provs) provision_hits,
  (select count(*) from cases where resolved_ecli is null) + (select count(*) from provs where resolved_provision_id is null) unresolved""")
def a12_extraction_totals(spark, d):
    """What a run of the extraction over all decisions reads, finds and resolves."""
    rows = text_plans._paragraphs(spark, d)
    refs = stage(extract.references(rows))
    keys = ["doc", "paragraph_idx", "span_start", "pattern_ord"]
    cases = extract.resolve_decisions(refs.filter("kind <> 'provision'"), merge.first_writer(table(spark, d, "decision_alias")), keys).select(F.col("resolved_ecli").isNotNull().alias("c"), F.lit(False).alias("p"))
    acts = extract.resolve_provisions(refs, table(spark, d, "provision")).select(F.lit(False).alias("c"), F.col("resolved_provision_id").isNotNull().alias("p"))
    sums = cases.unionByName(acts).agg(F.count("*").alias("refs"), F.count_if("c").alias("decision_hits"), F.count_if("p").alias("provision_hits"), F.count_if(~F.col("c") & ~F.col("p")).alias("unresolved"))
    # one row each
    return table(spark, d, "decision_paragraph").agg(F.count_distinct("ecli").alias("decisions")).crossJoin(F.broadcast(sums))


@query(f"""with {text_plans._refs_sql("select distinct ecli doc, idx paragraph_idx, body from decision_paragraph")}, f as (select distinct doc, paragraph_idx, kind, raw_text, span_start, span_end, subsec, act_no from refs),
g as (select ecli doc, paragraph_idx, kind, raw_text, span_start, span_end, max(case when ref_id % 9 = 0 then 1 else 0 end) spoilt from reference_span group by all)
select f.kind, count(*) group_mismatches from f join g on g.doc = f.doc and g.paragraph_idx = f.paragraph_idx and g.kind = f.kind and g.raw_text = f.raw_text and g.span_start = f.span_start and g.span_end = f.span_end where spoilt = 1 group by f.kind""".replace("max(case when ref_id % 9 = 0 then 1 else 0 end) spoilt from reference_span group by all", "max(case when ref_id % 9 = 0 then 1 else 0 end) spoilt from reference_span group by 1, 2, 3, 4, 5, 6"))
def a18_group_mismatches(spark, d):
    """Spans that extraction and reference_span share, with other groups: those of each ninth stored span are spoilt."""
    gold = _spans(spark, d).withColumn("groups", F.when(F.col("ref_id") % 9 == 0, F.create_map(F.lit("~"), F.lit("~"))).otherwise(F.col("groups")))
    found = extract.references(table(spark, d, "decision_paragraph").select(F.col("ecli").alias("doc"), F.col("idx").alias("paragraph_idx"), "body"))
    return span_scores(gold, found, ["doc", "paragraph_idx", "raw_text", "span_start", "span_end"]).filter("group_mismatches > 0").select("kind", "group_mismatches")


# --- streams


@query("""with w as (select date_trunc('day', ts) window_start, event_type, count(*) n from events group by 1, 2), m as (select max(ts) - interval 1 hour as mark from events)
select cast(window_start as varchar)[1:10] as day, event_type, n from w, m where window_start + interval 1 day <= mark""")
def stream_event_windows(spark, d):
    """Daily event counts by a stream with a watermark; only closed windows."""
    # the table's files are in no order of time: in several batches the watermark would drop rows of the later ones
    rows = incremental.drained(incremental.event_windows(incremental.table_stream(spark, d, "events", None)))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("select distinct on (ecli) ecli, epoch_us(fetched_at) fetched_us, panel_type from decision order by ecli, fetched_at desc, panel_type desc, source_url desc")
def stream_latest_decisions(spark, d):
    """Each decision's latest fetch, folded from a stream of fetches."""
    stream = incremental.table_stream(spark, d, "decision").select("ecli", F.unix_micros("fetched_at").alias("fetched_us"), "panel_type", "source_url")
    return incremental.KeptLatest(spark, ["ecli"], ["fetched_us", "panel_type", "source_url"]).run(stream).select("ecli", "fetched_us", "panel_type")
