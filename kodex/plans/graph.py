"""Queries over decisions, the citation graph and provision timelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kodex import schema
from kodex.operators import evaluate, extract, graph, merge, status
from kodex.plans.derived import AS_OF, citations, day, decisions, judgements, sql, treatments
from kodex.session import stage
from kodex.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
HOT = "ECLI:CZ:NSS:2019:1.Ahz.1.2018.77"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


# --- scans


@query(sql("dec", f"select ecli, court_code, panel_type, decided_on from dec where ecli = '{HOT}'"))
def s1_decision_by_key(spark, d):
    return decisions(spark, d).filter(F.col("ecli") == HOT).select("ecli", "court_code", "panel_type", "decided_on")


@query(sql("dec cit", "select ecli, decided_on from dec where ecli in (select cited_ecli from cit where cited_ecli is not null)"))
def s2_decisions_of_keys(spark, d):
    keys = citations(spark, d).filter("cited_ecli is not null").select(F.col("cited_ecli").alias("ecli")).distinct()
    return decisions(spark, d).join(keys, "ecli", "left_semi").select("ecli", "decided_on")


@query(f"select para_id, idx, body from decision_paragraph where ecli = '{HOT}' order by idx, para_id")
def s3_paragraphs_in_order(spark, d):
    return table(spark, d, "decision_paragraph").filter(F.col("ecli") == HOT).select("para_id", "idx", "body").orderBy("idx", "para_id")


@query(sql("dec", "select ecli, source_url from dec where trim(source_url) <> ''"))
def s4_source_links(spark, d):
    return decisions(spark, d).filter("trim(source_url) <> ''").select("ecli", "source_url")


@query(sql("dec", "select ecli, decided_on from dec where court_code = 'US' order by ecli"))
def s5_decisions_of_court(spark, d, court="US"):
    rows = decisions(spark, d)
    return (rows.filter(F.col("court_code") == court) if court else rows).select("ecli", "decided_on").orderBy("ecli")


@query("select para_id, ecli from decision_paragraph where contains(body, 'ÚS')")
def s6_prefiltered_paragraphs(spark, d):
    return table(spark, d, "decision_paragraph").filter(F.col("body").contains("ÚS")).select("para_id", "ecli")


@query(sql("cit", "select id, citing_ecli, cited_ecli, cited_provision from cit where id = 5"))
def s7_citation_by_id(spark, d):
    return citations(spark, d).filter("id = 5").select("id", "citing_ecli", "cited_ecli", "cited_provision")


# --- sinks and merges


@query(sql("dec", "select ecli, court_code, panel_type, decided_on, case_no, ratio_summary, source_url from dec"))
def k1_upserted_decisions(spark, d):
    rows = table(spark, d, "decision")
    early, late = rows.filter("fetched_at < timestamp '2020-01-01'"), rows.filter("fetched_at >= timestamp '2020-01-01'")
    return merge.upsert_decisions(merge.current_decisions(early), late).select("ecli", "court_code", "panel_type", "decided_on", "case_no", "ratio_summary", "source_url")


_FORM = r"lower(trim(regexp_replace({}, '[\s\x{{85}}\p{{Z}}\x1c-\x1f]+', ' ', 'g')))"


@query(f"select form as alias, arg_min(alias_kind, alias_id) alias_kind, arg_min(ecli, alias_id) ecli from (select *, {_FORM.format('alias')} form from decision_alias) where form <> '' group by form")
def k2_first_writer_aliases(spark, d):
    return merge.first_writer(table(spark, d, "decision_alias"))


@query("""with fresh as (select ecli, idx, max(para_id) para_id from decision_paragraph where para_id % 2 = 0 and trim(body) <> '' group by ecli, idx)
select ecli, idx, para_id from fresh union all
select ecli, idx, para_id from decision_paragraph where para_id % 2 = 1 and ecli not in (select ecli from decision_paragraph where para_id % 2 = 0)""")
def k3_replaced_paragraphs(spark, d):
    """The even rows as a new crawl over the odd ones as the stored table."""
    rows = table(spark, d, "decision_paragraph").select("ecli", "idx", "para_id", "body")
    return merge.replace_paragraphs(rows.filter("para_id % 2 = 1"), rows.filter("para_id % 2 = 0")).select("ecli", "idx", "para_id")


@query(sql("dec", "select court_code, count(*) decision_count, max(decided_on) covered_through from dec group by court_code"))
def k4_corpus_meta(spark, d):
    return merge.corpus_meta(decisions(spark, d))


@query("""with wanted as (select distinct act_no, section, coalesce(subsec, '') s from provision_dump), new as (
  select w.* from wanted w anti join provision p on p.act_no = w.act_no and p.section = w.section and coalesce(p.subsec, '') = w.s)
select act_no, section, subsec, true known from provision union all select act_no, section, nullif(s, ''), false from new""")
def k5_provision_identities(spark, d):
    known = table(spark, d, "provision")
    wanted = table(spark, d, "provision_dump").select("act_no", "section", F.nullif("subsec", F.lit("")).alias("subsec"))
    top = known.agg(F.max("id").alias("top"))
    return merge.find_or_insert(known, wanted).join(F.broadcast(top)).select("act_no", "section", "subsec", (F.col("id") <= F.col("top")).alias("known"))


@query(sql("cit", "select id, citing_ecli, cited_ecli, cited_provision, paragraph_idx, raw_text, extractor from cit"))
def k6_citations(spark, d):
    return citations(spark, d)


@query(sql("cit trt", "select distinct on (citation_id, prompt_version) citation_id, prompt_version, label from trt"))
def k7_treatments_inserted(spark, d):
    rows = treatments(spark, d)
    old, new = rows.filter("prompt_version = 'v1'"), rows
    return merge.insert_ignore(old.select("citation_id", "prompt_version", "label", "id"), new.select("citation_id", "prompt_version", "label", "id"), ["citation_id", "prompt_version"], ["id"]).select("citation_id", "prompt_version", "label")


def _records(spark, d):
    key = ["act_no", "section", F.coalesce("subsec", F.lit("")).alias("sub")]
    ids = table(spark, d, "provision").select("act_no", "section", F.coalesce("subsec", F.lit("")).alias("sub"), F.col("id").alias("provision_id"))
    rows = table(spark, d, "provision_dump").select(*key, "body", "valid_from", "valid_to", "derogated_by", "rec_id").join(ids, ["act_no", "section", "sub"])
    rows = rows.filter("valid_to is null or valid_to >= valid_from")
    return graph.latest(rows.select("provision_id", "valid_from", "body", "valid_to", "derogated_by", "rec_id"), ["provision_id", "valid_from"], ["rec_id"]).drop("rec_id")


_RECORDS = """rec as (select distinct on (p.id, x.valid_from) p.id provision_id, x.valid_from, x.valid_to, x.body, x.derogated_by from provision_dump x
  join provision p on p.act_no = x.act_no and p.section = x.section and coalesce(p.subsec, '') = coalesce(x.subsec, '')
  where x.valid_to is null or x.valid_to >= x.valid_from order by p.id, x.valid_from, x.rec_id desc),
flagged as (select *, case when lag(valid_from) over w is not null and body is not distinct from lag(body) over w and derogated_by is not distinct from lag(derogated_by) over w then 0 else 1 end fresh from rec window w as (partition by provision_id order by valid_from)),
runs as (select *, sum(fresh) over (partition by provision_id order by valid_from) run from flagged),
merged as (select provision_id, min(valid_from) valid_from, arg_max_null(valid_to, valid_from) valid_to, arg_min_null(body, valid_from) body, arg_min_null(derogated_by, valid_from) derogated_by from runs group by provision_id, run),
tl as (select provision_id, valid_from, least(valid_to, lead(valid_from) over (partition by provision_id order by valid_from) - 1)::date valid_to, body, derogated_by from merged)"""


@query(f"with {_RECORDS} select provision_id, valid_from, valid_to, body, derogated_by from tl")
def c16_timeline(spark, d):
    return merge.timeline(_records(spark, d)).select("provision_id", "valid_from", "valid_to", "body", "derogated_by")


@query("""select distinct provision_id, valid_from, 'inverted' reason from provision_version where valid_to < valid_from
union all select provision_id, valid_from, 'same start' from provision_version group by provision_id, valid_from having count(*) > 1""")
def c16_timeline_refusals(spark, d):
    return merge.timeline_refusals(table(spark, d, "provision_version"))


_ACTIONS = f"""{_RECORDS}, old as (select distinct on (provision_id, valid_from) * from provision_version order by provision_id, valid_from, id),
acts_ as (select coalesce(o.provision_id, n.provision_id) provision_id, coalesce(o.valid_from, n.valid_from) valid_from, o.id,
  case when o.id is null then 'insert' when n.provision_id is null then 'delete'
    when o.body is not distinct from n.body and o.valid_to is not distinct from n.valid_to and o.derogated_by is not distinct from n.derogated_by then 'unchanged' else 'update' end as action
from (select * from old where provision_id in (select provision_id from tl)) o full join tl n on n.provision_id = o.provision_id and n.valid_from = o.valid_from),
few as (select * from jud where from_version_id % 40 = 0),
named as (select provision_id, id from acts_ where action = 'delete' and id in (select from_version_id from few union select to_version_id from few))"""


def _actions(spark, d):
    """The stored timelines, the judgements that name some of their versions, and what the dumps would change."""
    old = table(spark, d, "provision_version")
    old = old.groupBy("provision_id", "valid_from").agg(F.min_by(F.struct("id", "body", "valid_to", "derogated_by"), "id").alias("r")).select("provision_id", "valid_from", "r.*")
    return old, judgements(spark, d).filter("from_version_id % 40 = 0"), merge.timeline(_records(spark, d))


@query(sql("jud", "").rstrip() + f""", {_ACTIONS} select provision_id, valid_from, id, case when provision_id in (select provision_id from named) then 'refused' else action end as action from acts_""")
def k8_timeline_actions(spark, d):
    old, named, new = _actions(spark, d)
    return merge.timeline_actions(old, new, named)


@query(sql("jud", "").rstrip() + f", {_ACTIONS} select provision_id, id from named")
def j22_referenced_versions(spark, d):
    """Versions that the dumps no longer have but a judgement names."""
    old, named, new = _actions(spark, d)
    return merge.referenced_versions(merge.timeline_actions(old, new), named)


@query(f"with {_RECORDS} select provision_id, valid_from, derogated_by from tl where derogated_by is not null and derogated_by not in (select ecli from decision)")
def j21_unknown_derogations(spark, d):
    return merge.unknown_derogations(merge.timeline(_records(spark, d)), table(spark, d, "decision"))


@query(f"with {_RECORDS} select count(*) versions, count(*) filter (valid_to is null) as open_versions, count(derogated_by) derogated from tl")
def k11_ingest_counts(spark, d):
    return merge.timeline(_records(spark, d)).agg(F.count("*").alias("versions"), F.count_if(F.col("valid_to").isNull()).alias("open_versions"), F.count("derogated_by").alias("derogated"))


@query(sql("jud", """, old as (select from_version_id, to_version_id, prompt_version, material, created_at from jud where from_version_id % 3 <> 0),
new as (select from_version_id, to_version_id, prompt_version, not material material, created_at + 10 created_at from jud where to_version_id % 2 = 0)
select * from new union all select * from old o where not exists (select 1 from new n where n.from_version_id = o.from_version_id and n.to_version_id = o.to_version_id and n.prompt_version = o.prompt_version)""").replace("\n, old", ", old"))
def k9_judgements_upserted(spark, d):
    """Judgements written again over the stored ones, where there are any."""
    rows = stage(judgements(spark, d).select("from_version_id", "to_version_id", "prompt_version", "material", "created_at"))
    new = rows.filter("to_version_id % 2 = 0").withColumn("material", ~F.col("material")).withColumn("created_at", F.date_add("created_at", 10))
    return merge.upsert(rows.filter("from_version_id % 3 <> 0"), new, ["from_version_id", "to_version_id", "prompt_version"], ["created_at"])


@query(sql("dec", f"""select distinct on (ecli, alias) {_FORM.format('a')} as alias, kind as alias_kind, ecli
from (select ecli, unnest([ecli, case_no, ref_no, journal_no]) a, unnest(['ecli_variant', 'case_no', 'ref_no', 'journal_no']) kind, unnest([0, 1, 2, 3]) o from dec) where {_FORM.format('a')} <> '' order by ecli, alias, o"""))
def k12_alias_rows(spark, d):
    return merge.alias_rows(decisions(spark, d))


@query(sql("dec", r"""select distinct lower(alias) as alias, 'case_no' alias_kind, ecli from (select ecli, unnest([w || '. ÚS ' || n || '/' || y, w || '.ÚS ' || n || '/' || y]) as alias from (
  select ecli, case when regexp_matches(case_no, '^(?i)pl') then 'Pl' else upper(regexp_extract(case_no, '^([IVXivx]+)', 1)) end w, regexp_extract(case_no, '(\d+)/', 1) n, right(regexp_extract(case_no, '/(\d{2,4})$', 1), 2) y
  from dec where regexp_matches(trim(case_no), '^(?i)(?:Pl\.?|[IVX]+\.?)\s*ÚS\s*\d+/\d{2,4}$')))"""))
def k13_sign_aliases(spark, d):
    return merge.sign_alias_rows(decisions(spark, d))


# --- joins


@query(sql("dec cit trt latest authority labelled", "select citation_id, citing_ecli, cited_ecli, paragraph_idx, label, confidence, evidence_span, citing_court, citing_panel, citing_date, cited_court, may_depart from labelled"))
def j1_treatments_for(spark, d):
    return graph.treatments_for(citations(spark, d), treatments(spark, d), decisions(spark, d), schema.authority(spark))


@query(sql("cit trt latest follows", "select citing_ecli, cited_ecli from follows"))
def j2_followed(spark, d):
    return graph.followed(citations(spark, d), treatments(spark, d))


@query(sql("dec cit then_", "select citing_ecli, provision_id, decided_on, id v0_id, valid_from v0_from from then_"))
def j3_version_in_force(spark, d):
    cases = decisions(spark, d).select(F.col("ecli").alias("citing_ecli"), "decided_on")
    rows = citations(spark, d).filter("cited_provision is not null").select("citing_ecli", F.col("cited_provision").alias("provision_id")).distinct().join(cases, "citing_ecli")
    return graph.in_force(stage(rows), table(spark, d, "provision_version"), "decided_on", "v0")


@query(sql("now", "select provision_id, id, valid_from as from from now".replace("as from from", 'as "from" from')))
def j4_version_at_day(spark, d):
    return graph.in_force_at(table(spark, d, "provision_version"), day()).drop("body")


@query(sql("jud mat", "select from_version_id v0_id, to_version_id v1_id, material from mat"))
def j5_latest_materiality(spark, d):
    return graph.latest_materiality(judgements(spark, d))


@query(sql("dec derog", "select provision_id, derogated_by, derogated_on from derog"))
def j6_derogations(spark, d):
    return graph.derogations(table(spark, d, "provision_version"), decisions(spark, d), day())


def _relied(spark, d):
    return graph.relied_on(citations(spark, d), decisions(spark, d), table(spark, d, "provision_version"), judgements(spark, d), day())


@query(sql("dec cit now derog then_ jud mat relied", "select ecli, provision_id, reworded, changed_on, material, derogated_by from relied"))
def j7_relied_on(spark, d):
    return _relied(spark, d)


@query(sql("dec derog", "select p.id provision_id, p.act_no, p.section, p.subsec, g.derogated_by from provision p left join derog g on g.provision_id = p.id"))
def j8_directly_cited(spark, d):
    p = table(spark, d, "provision").withColumnRenamed("id", "provision_id")
    return p.join(graph.derogations(table(spark, d, "provision_version"), decisions(spark, d), day()).drop("derogated_on"), "provision_id", "left").select("provision_id", "act_no", "section", "subsec", "derogated_by")


@query("""select x.rec_id, p.id provision_id from provision_dump x left join provision p on p.act_no = x.act_no and p.section = x.section and p.subsec is not distinct from nullif(x.subsec, '')""")
def j10_provision_keys(spark, d):
    x, p = table(spark, d, "provision_dump").withColumn("subsec", F.nullif("subsec", F.lit(""))), table(spark, d, "provision")
    return x.join(p, (x.act_no == p.act_no) & (x.section == p.section) & x.subsec.eqNullSafe(p.subsec), "left").select("rec_id", F.col("id").alias("provision_id"))


@query(sql("cit trt", "select id from cit where not exists (select 1 from trt where trt.citation_id = cit.id and trt.prompt_version = 'v2')"))
def j11_unlabelled_edges(spark, d):
    done = treatments(spark, d).filter("prompt_version = 'v2'").select(F.col("citation_id").alias("id"))
    return citations(spark, d).join(done, "id", "left_anti").select("id")


@query(sql("dec cit now then_ jud", "select distinct t.id from_version_id, n.id to_version_id from then_ t join now n on n.provision_id = t.provision_id where t.id <> n.id and t.body <> n.body and not exists (select 1 from jud j where j.from_version_id = t.id and j.to_version_id = n.id and j.prompt_version = 'v1')"))
def j13_pending_rewordings(spark, d):
    return graph.pending_rewordings(citations(spark, d), decisions(spark, d), table(spark, d, "provision_version"), judgements(spark, d), day(), "v1")


@query("select a.provision_id, a.id earlier_id, b.id later_id from provision_version a join provision_version b on b.provision_id = a.provision_id and b.valid_from > a.valid_from where a.valid_to is null or a.valid_to >= b.valid_from")
def j14_overlaps(spark, d):
    return graph.overlaps(table(spark, d, "provision_version"))


@query("""with links as (select b.id, count(a.id) links from provision_version b left join provision_version a on a.provision_id = b.provision_id and a.valid_from < b.valid_from and (a.valid_to is null or a.valid_to >= b.valid_from) where b.valid_from is not null group by b.id),
ok as (select provision_id, valid_from f, coalesce(valid_to, date '9999-12-31') t from provision_version where valid_from is not null and (valid_to is null or valid_to >= valid_from)),
m as (select *, max(t) over (partition by provision_id order by f, t rows between unbounded preceding and 1 preceding) before from ok),
n as (select *, sum(case when before is null or f > before + 1 then 1 else 0 end) over (partition by provision_id order by f, t rows unbounded preceding) run from m),
periods as (select provision_id, min(f) f, max(t) t from n group by provision_id, run)
select v.id, v.provision_id, p.f class_from, l.links from provision_version v join links l on l.id = v.id left join periods p on p.provision_id = v.provision_id and p.f <= v.valid_from and p.t >= v.valid_from""")
def j14_overlap_classes(spark, d):
    """Each window with the class of windows that overlap or meet in one period, and how many earlier ones reach its start: no pairs."""
    return graph.overlap_classes(table(spark, d, "provision_version"))


@query("""select a.provision_id, 'overlap' problem, count(*) n from provision_version a join provision_version b on b.provision_id = a.provision_id and b.valid_from > a.valid_from where a.valid_to is null or a.valid_to >= b.valid_from group by 1
union all select provision_id, 'open', count(*) from provision_version where valid_to is null group by 1 having count(*) > 1""")
def c18_timeline_problems(spark, d):
    return graph.timeline_problems(table(spark, d, "provision_version"))


@query(sql("jud", "select v.id from provision_version v where exists (select 1 from jud where from_version_id = v.id or to_version_id = v.id)"))
def j15_judged_versions(spark, d):
    return graph.judged_versions(table(spark, d, "provision_version"), judgements(spark, d)).select("id")


@query(sql("dec", "select c.code, c.name, count(x.ecli) decisions, max(x.decided_on) newest from (values ('US', 'Ústavní soud'), ('NSS', 'Nejvyšší správní soud'), ('NS', 'Nejvyšší soud')) c(code, name) left join dec x on x.court_code = c.code group by 1, 2"))
def j17_courts(spark, d):
    rows = decisions(spark, d).select(F.col("court_code").alias("code"), "ecli", "decided_on").groupBy("code").agg(F.count("ecli").alias("decisions"), F.max("decided_on").alias("newest"))
    return schema.courts(spark).join(rows, "code", "left").fillna(0, ["decisions"])


def _links_sql() -> str:
    return sql(_STANDING, "select ecli, source_url from dec where ecli in (select cited_ecli from cit where cited_ecli is not null union select by_ecli from every where ecli in (select cited_ecli from cit) union select via_ecli from every where ecli in (select cited_ecli from cit))")


def j23_link_table(spark, d):
    """The pages of all cited decisions and of those that their reasons name, by whom or through whom."""
    cited = stage(citations(spark, d).filter("cited_ecli is not null").select(F.col("cited_ecli").alias("ecli")).distinct())
    named = c19_reasons(spark, d).join(cited, "ecli", "left_semi").select(F.explode(F.array("by_ecli", "via_ecli")).alias("ecli"))
    keys = cited.unionByName(named).filter("ecli is not null").distinct()
    return decisions(spark, d).join(keys, "ecli", "left_semi").select("ecli", "source_url")


# --- aggregates, sets, order


@query(sql("dec cit trt", "select (select count(*) from dec) decisions, (select count(*) from decision_paragraph) paragraphs, (select count(*) from decision_alias) aliases, (select count(*) from provision) provisions, (select count(*) from provision_version) versions, (select count(cited_ecli) from cit) decision_citations, (select count(*) from trt) treatments"))
def a3_table_counts(spark, d):
    one = lambda df, name, c="*": F.broadcast(df.agg(F.count(c).alias(name)))
    out = one(decisions(spark, d), "decisions")
    for df, name, c in [(table(spark, d, "decision_paragraph"), "paragraphs", "*"), (table(spark, d, "decision_alias"), "aliases", "*"), (table(spark, d, "provision"), "provisions", "*"), (table(spark, d, "provision_version"), "versions", "*"), (citations(spark, d), "decision_citations", "cited_ecli"), (treatments(spark, d), "treatments", "*")]:
        out = out.join(one(df, name, c))
    return out


@query(sql("cit trt", "select label, count(*) n from trt group by label"))
def a4_label_histogram(spark, d):
    return treatments(spark, d).groupBy("label").agg(F.count("*").alias("n"))


@query(sql("cit trt latest", "select citation_id, label, confidence, prompt_version from latest"))
def a5_latest_treatments(spark, d):
    return graph.latest_treatments(treatments(spark, d)).select("citation_id", "label", "confidence", "prompt_version")


@query(sql("cit", "select distinct citing_ecli, cited_provision from cit where cited_provision is not null"))
def a6_relied_pairs(spark, d):
    return citations(spark, d).filter("cited_provision is not null").select("citing_ecli", "cited_provision").distinct()


@query(sql("dec", f"select coalesce(sum(n), 0)::bigint corpus_size, coalesce(min(m), date '{AS_OF}') corpus_through from (select count(*) n, max(decided_on) m from dec group by court_code)"))
def a8_corpus_scope(spark, d):
    return status.corpus_scope(merge.corpus_meta(decisions(spark, d)), day())


@query("select kind, count(*) filter (r) resolved, count(*) filter (not r) unresolved, round(coalesce(count(*) filter (r) / count(*), 1.0), 6) coverage from (select kind, resolved_ecli is not null or resolved_provision_id is not null r from reference_span) group by kind")
def a11_resolution_stats(spark, d):
    return extract.resolution_stats(table(spark, d, "reference_span").select("kind", F.expr("resolved_ecli is not null or resolved_provision_id is not null").alias("resolved")))


@query(sql("cit", "select cited_ecli, count(*) n from cit where cited_ecli is not null group by 1 order by n desc, cited_ecli limit 25"))
def o5_most_cited(spark, d):
    """A top-k report: each partition keeps its best 25."""
    return citations(spark, d).filter("cited_ecli is not null").groupBy("cited_ecli").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cited_ecli").limit(25)


@query(sql("cit", "select citing_ecli ecli from cit union select cited_ecli from cit where cited_ecli is not null"))
def u1_all_targets(spark, d):
    return citations(spark, d).select(F.explode(F.array("citing_ecli", "cited_ecli")).alias("ecli")).filter("ecli is not null").distinct()


@query("""select 'both' side, count(*) n from (select alias from decision_alias intersect select raw_text from reference_span)
union all select 'alias only', count(*) from (select alias from decision_alias except select raw_text from reference_span)
union all select 'citation only', count(*) from (select raw_text from reference_span except select alias from decision_alias)""")
def u3_set_differences(spark, d):
    a, b = table(spark, d, "decision_alias").select("alias"), table(spark, d, "reference_span").select(F.col("raw_text").alias("alias"))
    n = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "alias only")).unionByName(n(b.subtract(a), "citation only"))


@query("select ecli, raw_text, kind, min(paragraph_idx) first_paragraph from reference_span where resolved_ecli is null and resolved_provision_id is null group by all")
def u7_unresolved(spark, d):
    return table(spark, d, "reference_span").filter("resolved_ecli is null and resolved_provision_id is null").groupBy("ecli", "raw_text", "kind").agg(F.min("paragraph_idx").alias("first_paragraph"))


@query("""with n as (select *, row_number() over (partition by ecli order by idx, para_id) i from decision_paragraph)
select ecli, idx, para_id, (i - 1) // 20 batch from n""")
def w7_batches(spark, d):
    """Fixed-size batches of a decision's paragraphs, numbered over cuts of it that are counted first."""
    from pyspark.sql import Window

    rows = table(spark, d, "decision_paragraph").select("ecli", "idx", "para_id", F.floor(F.col("idx") / 512).alias("_c"))
    sizes = rows.groupBy("ecli", "_c").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("ecli").orderBy("_c")) - F.col("_n")).drop("_n")
    i = F.row_number().over(Window.partitionBy("ecli", "_c").orderBy("idx", "para_id"))
    return rows.withColumn("_i", i).join(before, ["ecli", "_c"]).select("ecli", "idx", "para_id", F.floor((F.col("_i") + F.col("_before") - 1) / 20).alias("batch"))


# --- standing


def _standing(spark, d):
    rows = decisions(spark, d)
    edges, labels = citations(spark, d), treatments(spark, d)
    t = stage(graph.treatments_for(edges, labels, rows, schema.authority(spark)))
    return status.standing(rows, t, stage(_relied(spark, d)), graph.followed(edges, labels), day())


_STANDING = "dec cit trt latest authority labelled follows now derog then_ jud mat relied own every"


query(_links_sql())(j23_link_table)


@query(sql(_STANDING, "select d.ecli, case when min(row_ord) <= 3 then 'RED' when min(row_ord) is not null then 'AMBER' else 'GREEN' end light, count(row_ord) n_reasons from dec d left join every e on e.ecli = d.ecli group by d.ecli"))
def c20_standing(spark, d):
    return _standing(spark, d)[0]


@query(sql(_STANDING, "select ecli, row_ord, kind, by_ecli, panel, span, provision_id, changed_on, citation_id, via_ecli from every"))
def c19_reasons(spark, d):
    return _standing(spark, d)[1].drop("_k")


@query(sql(_STANDING, "select light, count(*) n from (select case when min(row_ord) <= 3 then 'RED' when min(row_ord) is not null then 'AMBER' else 'GREEN' end light from dec d left join every e on e.ecli = d.ecli group by d.ecli) group by light"))
def a25_light_counts(spark, d):
    return _standing(spark, d)[0].groupBy("light").agg(F.count("*").alias("n"))


@query(sql("dec derog", "select p.id provision_id, case when g.derogated_by is null then 'GREEN' else 'RED' end light from provision p left join derog g on g.provision_id = p.id"))
def c21_provision_standing(spark, d):
    return j8_directly_cited(spark, d).select("provision_id", F.when(F.col("derogated_by").isNull(), "GREEN").otherwise("RED").alias("light"))


@query(sql(_STANDING.replace("every", "day_ every"), """select ecli, row_number() over (partition by ecli order by row_ord, k1, k2, span, panel, changed_on, citation_id)::int place, row_ord, kind, by_ecli, provision_id, via_ecli from (
  select e.*, case when row_ord in (3, 6) then lpad(provision_id::varchar, 20, '0') when row_ord = 8 then via_ecli else d.decided_on::varchar end k1, case when row_ord in (3, 6, 8) then '' else by_ecli end k2 from every e left join day_ d on d.ecli = e.by_ecli)""") )
def c19_ordered_reasons(spark, d):
    """Each decision's reasons in their order: by the row of the table, then by day and citing decision, or by provision."""
    rows = status.ordered(_standing(spark, d)[1]).select("ecli", F.posexplode("reasons").alias("p", "r"))
    return rows.select("ecli", (F.col("p") + 1).alias("place"), "r.row_ord", "r.kind", "r.by_ecli", "r.provision_id", "r.via_ecli")


@query(sql("cit", "select citing_ecli, paragraph_idx, id from cit order by citing_ecli, paragraph_idx, id"))
def o7_edges_in_order(spark, d):
    return citations(spark, d).orderBy("citing_ecli", "paragraph_idx", "id").select("citing_ecli", "paragraph_idx", "id")


@query(sql("dec cit now then_ jud", "select distinct t.id from_version_id, n.id to_version_id from then_ t join now n on n.provision_id = t.provision_id where t.id <> n.id and t.body <> n.body and not exists (select 1 from jud j where j.from_version_id = t.id and j.to_version_id = n.id and j.prompt_version = 'v1') order by 1, 2 limit 10"))
def o4_first_pending(spark, d):
    """The first ten rewordings to be judged: a limit after the order, which each partition applies to its own rows first."""
    return j13_pending_rewordings(spark, d).orderBy("from_version_id", "to_version_id").limit(10)


@query("""with s as (select court_code, ecli, min(epoch_us(fetched_at) // 1000000 % 4) first_pass from decision group by 1, 2), t as (select court_code, (count(distinct ecli) * 3) // 5 total from decision group by 1),
n as (select court_code, first_pass, count(*) n from s group by 1, 2), b as (select court_code, first_pass, coalesce(sum(n) over (partition by court_code order by first_pass rows between unbounded preceding and 1 preceding), 0) before from n)
select s.court_code, s.ecli, s.first_pass from s join b on b.court_code = s.court_code and b.first_pass = s.first_pass join t on t.court_code = s.court_code where b.before < t.total""")
def u4_samples_until_total(spark, d):
    """Decisions of repeated samples of a court's list, samples being taken until three fifths of it are reached."""
    rows = table(spark, d, "decision").select("court_code", "ecli", F.pmod(F.floor(F.unix_micros("fetched_at") / 1000000), F.lit(4)).alias("pass"))
    totals = rows.groupBy("court_code").agg(F.floor(F.count_distinct("ecli") * 3 / 5).alias("total"))
    return merge.samples_until(rows, totals, "court_code", "ecli")


# --- evaluation: labels of the second prompt version as gold for the first


def _scored(spark, d):
    c = citations(spark, d).filter("cited_ecli is not null").select(F.col("id").alias("citation_id"), "citing_ecli", "cited_ecli", "paragraph_idx")
    t = treatments(spark, d).join(c, "citation_id")
    gold = t.filter("prompt_version = 'v2'").select("id", "citing_ecli", "cited_ecli", "paragraph_idx", F.col("label").alias("gold_label"))
    predictions = t.filter("prompt_version = 'v1'").select("citing_ecli", "cited_ecli", "paragraph_idx", "label", "created_at", "id")
    return evaluate.match_predictions(gold, predictions)


_SCORED = """e as (select t.*, c.citing_ecli, c.cited_ecli, c.paragraph_idx from trt t join cit c on c.id = t.citation_id where c.cited_ecli is not null),
newest as (select distinct on (citing_ecli, cited_ecli, paragraph_idx) citing_ecli, cited_ecli, paragraph_idx, label from e where prompt_version = 'v1' order by citing_ecli, cited_ecli, paragraph_idx, created_at desc, id desc),
only_ as (select citing_ecli, cited_ecli, min(label) as label from newest group by 1, 2 having count(*) = 1),
scored as (select g.id, g.label gold_label, coalesce(n.label, o.label, '(none)') predicted, n.label is not null exact_paragraph from e g left join newest n on n.citing_ecli = g.citing_ecli and n.cited_ecli = g.cited_ecli and n.paragraph_idx is not distinct from g.paragraph_idx
  left join only_ o on o.citing_ecli = g.citing_ecli and o.cited_ecli = g.cited_ecli where g.prompt_version = 'v2')"""


@query(sql("cit trt", "").rstrip() + ",\n" + _SCORED + " select id, gold_label, predicted, exact_paragraph from scored")
def j19_matched_predictions(spark, d):
    return _scored(spark, d).select("id", "gold_label", "predicted", "exact_paragraph")


@query(sql("cit trt", "").rstrip() + ",\n" + _SCORED + """, n as (select l.label, (select count(*) from scored where gold_label = l.label and predicted = l.label) tp, (select count(*) from scored where gold_label <> l.label and predicted = l.label) fp,
  (select count(*) from scored where gold_label = l.label and predicted <> l.label) fn from (select gold_label as label from scored union select predicted from scored where predicted <> '(none)') l)
select label, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) recall, round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) f1 from n""")
def a14_label_scores(spark, d):
    return evaluate.label_scores(_scored(spark, d))


@query(sql("cit trt", "").rstrip() + ",\n" + _SCORED + " select gold_label, " + ", ".join(f"count(*) filter (predicted = '{x}') \"{x}\"" for x in schema.LABELS) + ", count(*) filter (predicted = '(none)') \"none\" from scored group by gold_label")
def a15_confusion(spark, d):
    return evaluate.confusion(_scored(spark, d))


_IN = "('DISTINGUISHED', 'NARROWED', 'DEPARTED')"


@query(sql("cit trt", "").rstrip() + ",\n" + _SCORED + f""" select count(*) filter (gold_label in {_IN}) gold_rows, count(*) filter (gold_label in {_IN} and predicted = gold_label) exact,
count(*) filter (gold_label in {_IN} and predicted in {_IN} and predicted <> gold_label) inside, count(*) filter (gold_label in {_IN} and predicted not in {_IN}) leaked_out, count(*) filter (gold_label not in {_IN} and predicted in {_IN}) leaked_in,
round(count(*) filter (gold_label in {_IN} and predicted = gold_label) / nullif(count(*) filter (gold_label in {_IN}), 0), 6) accuracy from scored""")
def a16_cluster_scores(spark, d):
    return evaluate.cluster_scores(_scored(spark, d))


_RED = "({0} = 'QUASHED' or {0} = 'DEPARTED' and id % 2 = 0)"


@query(sql("cit trt", "").rstrip() + ",\n" + _SCORED + f""", s as (select {_RED.format('gold_label')} g, {_RED.format('predicted')} p from (select id // 2 id, gold_label, predicted from scored)),
n as (select count(*) filter (g and p) tp, count(*) filter (p and not g) fp, count(*) filter (g and not p) fn from s) select tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) recall from n""")
def a17_red_scores(spark, d):
    return evaluate.red_scores(_scored(spark, d).withColumn("may_depart", F.floor(F.col("id") / 2) % 2 == 0))
