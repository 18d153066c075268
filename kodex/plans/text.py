"""Queries over texts: extraction, resolution, sentences, routing, forms of numbers and dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kodex.functions import legal, text
from kodex.operators import classify, extract, graph, merge
from kodex.patterns import PATTERNS
from kodex.plans.derived import citations, decisions, sql
from kodex.session import enriched, spread, stage, widened
from kodex.sources import pages
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


def _paragraphs(spark, d):
    """(doc, paragraph_idx, body): paragraphs of decisions with white space squeezed, a paragraph that was loaded twice once."""
    rows = table(spark, d, "decision_paragraph").select("ecli", "idx", "para_id", "body")
    first = rows.groupBy("ecli", "idx").agg(F.min_by("body", "para_id").alias("body"))
    return first.select(F.col("ecli").alias("doc"), F.col("idx").alias("paragraph_idx"), text.squeeze(F.col("body")).alias("body"))


_SQUEEZE = r"trim(regexp_replace({}, '[\s\x{{85}}\p{{Z}}\x1c-\x1f]+', ' ', 'g'))"
_CZ = f"translate({{}}, '{text.ACCENTED}', '{text.PLAIN}')"


@query(f"select para_id, {_SQUEEZE.format('body')} body from decision_paragraph")
def f1_squeezed(spark, d):
    return table(spark, d, "decision_paragraph").select("para_id", text.squeeze(F.col("body")).alias("body"))


@query(f"select alias_id, lower({_SQUEEZE.format('alias')}) form from decision_alias")
def f2_alias_forms(spark, d):
    return table(spark, d, "decision_alias").select("alias_id", text.alias_form(F.col("alias")).alias("form"))


@query("select para_id, lower(" + _SQUEEZE.format(_CZ.format(r"regexp_replace(body, '\p{M}', '', 'g')")) + ") folded from decision_paragraph")
def f4_unaccented(spark, d):
    return table(spark, d, "decision_paragraph").select("para_id", text.unaccented(F.col("body")).alias("folded"))


def _parts(by: str) -> str:
    return f"list_filter(list_transform(string_split_regex(text, '{by}'), lambda x: {_SQUEEZE.format('x')}), lambda x: x <> '')"


_R = r"(?:\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}])"


@query(f"""with p as (select doc_id, {_parts(_R + r"[ \t\x{A0}]*" + _R)} a, {_parts(_R)} b from documents), q as (select doc_id, case when len(a) > 1 or len(b) <= len(a) then a else b end c from p)
select doc_id, unnest(c) paragraph, generate_subscripts(c, 1)::int idx from q""")
def f6_document_paragraphs(spark, d):
    """Paragraphs of every document, numbered from 1."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("p", "paragraph")).select("doc_id", (F.col("p") + 1).alias("idx"), "paragraph")


_WORDS = "|".join(a.replace(".", r"\.") for a in text.ABBREVIATIONS.split())


def _sentences_sql(source: str, keys: str) -> str:
    """CTEs up to sentences (keys, sentence_start, sentence) of a SELECT of keys and t."""
    return rf"""cut as (select {keys}, string_split(regexp_replace(t, '([.!?]\s+)', '\1' || chr(1), 'g'), chr(1)) c from ({source})),
pieces as (select {keys}, unnest(c) piece, generate_subscripts(c, 1) i from cut),
runs_ as (select *, coalesce(sum(length(piece)) over before_, 0) before, coalesce(sum(case when regexp_matches(piece, '(?i)(?:^|\s)(?:{_WORDS}|[0-9IVX]+\.)\s+$') then 0 else 1 end) over before_, 0) run
  from pieces window before_ as (partition by {keys} order by i rows between unbounded preceding and 1 preceding)),
sentences as (select {keys}, min(before)::int sentence_start, regexp_replace(string_agg(piece, '' order by i), '\s+$', '') sentence from runs_ group by {keys}, run having trim(regexp_replace(string_agg(piece, '' order by i), '\s+$', '')) <> '')"""


@query("with " + _sentences_sql("select para_id, body t from decision_paragraph", "para_id") + " select para_id, sentence_start, sentence from sentences")
def f7_sentences(spark, d):
    """Sentences of every paragraph with their offsets."""
    return widened(table(spark, d, "decision_paragraph").select("para_id", "body")).select("para_id", F.inline(text.sentences(F.col("body")))).select("para_id", F.col("start").alias("sentence_start"), "sentence")


def _phrases(names: list[str]) -> str:
    return "case " + " ".join(f"when contains(f, '{p}') then '{p}'" for p in names) + " end"


@query(f"select para_id, {_phrases(extract.TRIGGERS + classify.DEPARTURE)} phrase from (select para_id, lower({_SQUEEZE.format('body')}) f from decision_paragraph)")
def f9_first_phrase(spark, d):
    return table(spark, d, "decision_paragraph").select("para_id", text.first_phrase(F.col("body"), extract.TRIGGERS + classify.DEPARTURE).alias("phrase"))


@query(f"select r.ref_id, p.para_id, contains({_SQUEEZE.format('p.body')}, {_SQUEEZE.format('r.raw_text')}) and {_SQUEEZE.format('r.raw_text')} <> '' is_quote from reference_span r join decision_paragraph p on p.ecli = r.ecli and p.idx = r.paragraph_idx")
def f13_verbatim_spans(spark, d):
    p = table(spark, d, "decision_paragraph").select("ecli", F.col("idx").alias("paragraph_idx"), "para_id", "body")
    rows = table(spark, d, "reference_span").select("ref_id", "ecli", "paragraph_idx", "raw_text").join(p, ["ecli", "paragraph_idx"])
    return rows.select("ref_id", "para_id", text.is_verbatim(F.col("raw_text"), F.col("body")).alias("is_quote"))


@query(sql("dec", r"""select ecli, case when regexp_matches(s, '^(.*?\d/\d{4})\s*[-–]\s*(\d+)$') then trim(regexp_extract(s, '^(.*?\d/\d{4})\s*[-–]\s*(\d+)$', 1)) else s end case_no,
  case when regexp_matches(s, '^(.*?\d/\d{4})\s*[-–]\s*(\d+)$') then trim(regexp_extract(s, '^(.*?\d/\d{4})\s*[-–]\s*(\d+)$', 1)) || '-' || regexp_extract(s, '^(.*?\d/\d{4})\s*[-–]\s*(\d+)$', 2) else s end ref_no
from (select ecli, """ + _SQUEEZE.format("ref_no") + " s from dec where ref_no is not null)"))
def f14_ref_no_parts(spark, d):
    return decisions(spark, d).filter("ref_no is not null").select("ecli", legal.split_ref_no(F.col("ref_no")).alias("r")).select("ecli", "r.case_no", "r.ref_no")


@query(sql("dec", r"""select ecli, case when regexp_matches(c, '^(?i)pl') then 'Pl' else cast(list_position(['I', 'II', 'III', 'IV'], upper(regexp_extract(c, '^([IVXivx]+)', 1))) as varchar) end || '-' || regexp_extract(c, '(\d+)/', 1) || '-' || right(regexp_extract(c, '/(\d{2,4})$', 1), 2) || '_1' as key
from (select ecli, trim(case_no) c from dec) where regexp_matches(c, '^(?i)(?:Pl\.?|[IVX]+\.?)\s*ÚS\s*\d+/\d{2,4}$')"""))
def f15_sign_keys(spark, d):
    return decisions(spark, d).select("ecli", legal.sign_key(F.col("case_no")).alias("key")).filter("key is not null")


@query(r"""select rec_id, trim(regexp_replace(trim(replace('§ ' || section || '.', '§', ' ')), '\.+$', '')) section, nullif(trim(regexp_replace(trim(replace('odst. (' || coalesce(subsec, '') || ')', 'odst.', ' ')), '^[()]+|[()]+$', '', 'g')), '') subsec from provision_dump""")
def f17_section_forms(spark, d):
    """Printed forms of sections and subsections brought to their keys."""
    return table(spark, d, "provision_dump").select("rec_id", legal.section_form(F.concat(F.lit("§ "), "section", F.lit("."))).alias("section"), legal.subsection_form(F.concat(F.lit("odst. ("), F.coalesce("subsec", F.lit("")), F.lit(")"))).alias("subsec"))


@query(r"""select id, regexp_extract(p, '/par_([^/]+)', 1) section, nullif(regexp_extract(p, '/odst_([^/]+)', 1), '') subsec from (select id, 'eli/cz/sb/' || act_no || '/par_' || section || coalesce('/odst_' || subsec, '') p from provision)""")
def f18_fragment_keys(spark, d):
    path = F.concat(F.lit("eli/cz/sb/"), "act_no", F.lit("/par_"), "section", F.coalesce(F.concat(F.lit("/odst_"), "subsec"), F.lit("")))
    return table(spark, d, "provision").select("id", legal.fragment_keys(path).alias("k")).select("id", "k.section", "k.subsec")


#: How many paragraphs are a decision's heading; one where a court has no known layout.
HEADINGS = {"NSS": 4, "US": 2}
_NO_MARKS = r"regexp_replace(h.body, '\p{M}', '', 'g')"


def _asserted(markers: list[str], referral: str) -> str:
    """SQL: whether f has a match of a marker without a verb of referral in the 48 characters before it."""
    def one(marker: str) -> str:
        ms, pieces = f"regexp_extract_all(f, '{marker}')", f"string_split_regex(f, '{marker}')"
        total = lambda part: f"coalesce(list_sum(list_transform({part}, lambda x: length(x))), 0)"
        at = f"({total(f'({pieces})[1:k]')} + {total(f'({ms})[1:k - 1]')})"
        free = f"not regexp_matches(substr(f, cast(greatest({at} - 48, 0) + 1 as bigint), cast(least({at}, 48) as bigint)), '{referral}')"
        return f"coalesce(list_bool_or(list_transform(generate_series(1, len({ms})), lambda k: {free})), false)"

    return "(" + " or ".join(map(one, markers)) + ")"


# the courts' rules in SQL by themselves, so that a fault in the operator's lists shows
_NSS_REFERS, _US_REFERS = (r"\b(?:postoup\w*|postupuje|" + x + r"predlozi\w*|predlozen\w*|predklad\w*|" + y + r"navrh\w* na postoupeni)\b" for x, y in (("postupuji|", r"prikaz\w*|"), ("", "")))


@query(sql("dec", "").rstrip() + rf""", p as (select ecli, arg_min(body, para_id) body, idx from decision_paragraph group by ecli, idx), n as (select *, row_number() over (partition by ecli order by idx) r from p),
h as (select d.ecli, string_agg({_SQUEEZE.format('n.body')}, ' ' order by idx) body from dec d join n on n.ecli = d.ecli and r <= case d.court_code when 'NSS' then 4 when 'US' then 2 else 1 end group by d.ecli),
r as (select d.ecli, d.court_code, d.case_no, h.body, lower({_SQUEEZE.format(_CZ.format(_NO_MARKS.replace("h.body", "concat_ws(' ', h.body, case when court_code <> 'US' then case_no end)")))}) f,
  lower({_SQUEEZE.format(_CZ.format("case_no"))}) sign from dec d left join h on h.ecli = d.ecli)
select ecli, case when trim(coalesce(body, '')) = '' and trim(coalesce(case_no, '')) = '' then 'unknown' when court_code = 'US' and (coalesce(regexp_matches(sign, '^\s*pl\.?\s*us\b'), false) or {_asserted([r'\bplen\w*\b'], _US_REFERS)}) then 'plenary'
  when court_code = 'NSS' and {_asserted([r'\brozsiren\w* senat\w*\b', r'\b\d+clenn\w* rs nss\b'], _NSS_REFERS)} then 'extended' when court_code = 'NSS' and {_asserted([r'\bplen\w* nss\b'], _NSS_REFERS)} then 'plenary'
  when court_code = 'NS' and {_asserted([r'\bvelk\w* senat\w*\b'], _NSS_REFERS)} then 'grand' else 'panel' end panel_type from r""")
def f20_panel_types(spark, d):
    """The panel of each decision as its heading and case number tell it."""
    rows = decisions(spark, d).select("ecli", "court_code", "case_no")
    first = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv]), F.col("court_code")), F.lit(1))
    head = pages.leading(_paragraphs(spark, d).select(F.col("doc").alias("ecli"), F.col("paragraph_idx").alias("idx"), "body"), max(HEADINGS.values()))
    head = pages.joined(head.join(rows.select("ecli", first.alias("_first")), "ecli").filter("rank <= _first")).withColumnRenamed("heading", "body")
    rows = rows.join(head, "ecli", "left")
    return rows.select("ecli", legal.panel_type(F.col("court_code"), F.col("body"), F.col("case_no")).alias("panel_type"))


@query("select para_id, case when length(s) <= 120 then s else left(s, 120) || '...' end short from (select para_id, " + _SQUEEZE.format("body") + " s from decision_paragraph)")
def f22_shortened(spark, d):
    return table(spark, d, "decision_paragraph").select("para_id", text.truncated(F.col("body")).alias("short"))


@query(sql("dec", "select ecli, day(decided_on) || '. ' || month(decided_on) || '. ' || year(decided_on) printed, decided_on parsed from dec"))
def f26_dates(spark, d):
    """Dates printed as decisions print them, and read again."""
    printed = legal.czech_day(F.col("decided_on"))
    return decisions(spark, d).select("ecli", printed.alias("printed"), legal.czech_date(F.concat(F.lit("V Brně dne "), printed)).alias("parsed"))


@query("select page_id, sha256(text) digest, sha1(url) url_key from cached_page")
def f32_digests(spark, d):
    return table(spark, d, "cached_page").select("page_id", F.sha2("text", 256).alias("digest"), F.sha1("url").alias("url_key"))


@query(sql("cit", "select id, 'treatment|' || citing_ecli || '|' || coalesce(cited_ecli || '|', '') || coalesce(cast(paragraph_idx as varchar), '-') || '|v1' as key from cit"))
def f33_cache_keys(spark, d):
    return citations(spark, d).select("id", classify.treatment_key(F.col("citing_ecli"), F.col("cited_ecli"), F.col("paragraph_idx"), "v1").alias("key"))


def _refs_sql(paragraphs: str, name: str = "refs") -> str:
    """CTEs up to `name`: the catalogue's spans of the rows (doc, paragraph_idx, body) of a SELECT, contained ones dropped."""
    parts = []
    for i, p in enumerate(PATTERNS):
        named = ", ".join(f"nullif(regexp_extract(ms[k], '{p.regex}', {p.groups.index(g) + 1}), '') {g}" if g in p.groups else f"null {g}" for g in GROUPS)
        parts.append(f"""select doc, paragraph_idx, {i} pattern_ord, '{p.kind}' kind, ms[k] raw, pos, {named} from (
  select *, (list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))::int pos from (
    select *, unnest(generate_series(1, len(ms))) k from (select doc, paragraph_idx, regexp_extract_all(body, '{p.regex}') ms, string_split_regex(body, '{p.regex}') pieces from para where contains(body, '{p.holds}')) where len(ms) > 0))""")
    return f"""para as materialized ({paragraphs}),
spans as materialized ({" union all ".join(parts)}),
{name} as materialized (select doc, paragraph_idx, pattern_ord, kind, raw raw_text, pos span_start, pos + length(raw)::int span_end, {", ".join(GROUPS)} from spans s where not exists (select 1 from spans o where o.doc = s.doc and o.paragraph_idx = s.paragraph_idx
  and o.pos <= s.pos and o.pos + length(o.raw) >= s.pos + length(s.raw) and ((o.pos, length(o.raw)) <> (s.pos, length(s.raw)) or o.pattern_ord < s.pattern_ord)))"""


GROUPS = sorted({g for p in PATTERNS for g in p.groups})
_PARA = f"select ecli doc, idx paragraph_idx, {_SQUEEZE.format('arg_min(body, para_id)')} body from decision_paragraph group by ecli, idx"
_LOWER = "lower(" + _SQUEEZE + ")"
_RESOLVED = f"""al as (select form, arg_min(ecli, alias_id) ecli from (select *, {_LOWER.format('alias')} form from decision_alias) where form <> '' group by form),
tried as (select *, unnest(c) x, generate_subscripts(c, 1) o from (select doc, paragraph_idx, span_start, pattern_ord, case kind when 'ref_no' then [coalesce(ref_no || '-' || sheet_no, ref_no)] when 'case_no' then [case_no] when 'ecli' then [raw_text]
  when 'journal_no' then ['R ' || journal_seq || '/' || journal_year, raw_text] end c from refs where kind <> 'provision')),
hit as (select doc, paragraph_idx, span_start, pattern_ord, arg_min(al.ecli, o) ecli from tried join al on al.form = {_LOWER.format('x')} group by 1, 2, 3, 4),
cases as (select r.*, hit.ecli resolved_ecli from refs r left join hit on hit.doc = r.doc and hit.paragraph_idx = r.paragraph_idx and hit.span_start = r.span_start and hit.pattern_ord = r.pattern_ord where kind <> 'provision'),
carried as (select *, last_value(act_no ignore nulls) over (partition by doc order by paragraph_idx, span_start, span_end rows between unbounded preceding and 1 preceding) before from refs where kind = 'provision'),
modes as (select distinct on (doc) doc, act_no as mode from (select doc, act_no, count(*) n, min((paragraph_idx, span_start, span_end)) f from carried where act_no is not null group by 1, 2) order by doc, n desc, f),
acts as (select c.doc, c.paragraph_idx, c.span_start, c.raw_text, coalesce(c.act_no, c.before, m.mode) act_no, c.section, c.subsec,
  case when c.act_no is not null then 'explicit' when c.before is not null then 'backward-scan' when m.mode is not null then 'document-mode' end basis from carried c left join modes m on m.doc = c.doc),
provs as (select a.*, p.id resolved_provision_id from acts a left join provision p on p.act_no = a.act_no and p.section = a.section and p.subsec is not distinct from a.subsec)"""


def _refs(spark, d):
    return stage(extract.references(_paragraphs(spark, d)))


@query(f"with {_refs_sql(_PARA)} select doc, paragraph_idx, kind, raw_text, span_start, span_end, concat_ws(';', " + ", ".join(f"'{g}=' || {g}" for g in GROUPS) + ") groups from refs")
def c1_references(spark, d):
    """Citation spans of every paragraph, contained ones dropped."""
    groups = F.array_join(F.array_sort(F.transform(F.map_entries("groups"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return _refs(spark, d).select("doc", "paragraph_idx", "kind", "raw_text", "span_start", "span_end", groups.alias("groups"))


@query(f"with {_refs_sql(_PARA)}, {_RESOLVED} select doc, paragraph_idx, kind, raw_text, span_start, resolved_ecli from cases")
def c5_resolved_decisions(spark, d):
    """Each citation of a decision with the decision that its first known alias names."""
    refs = _refs(spark, d).filter("kind <> 'provision'")
    keys = ["doc", "paragraph_idx", "span_start", "pattern_ord"]
    return extract.resolve_decisions(refs, merge.first_writer(table(spark, d, "decision_alias")), keys).select("doc", "paragraph_idx", "kind", "raw_text", "span_start", "resolved_ecli")


@query(f"with {_refs_sql(_PARA)}, {_RESOLVED} select doc, paragraph_idx, span_start, raw_text, act_no, section, subsec, basis, resolved_provision_id from provs")
def w3_resolved_provisions(spark, d):
    """Each citation of a provision with the act carried forward, on what basis, and the provision."""
    return extract.resolve_provisions(_refs(spark, d), table(spark, d, "provision")).select("doc", "paragraph_idx", "span_start", "raw_text", "act_no", "section", "subsec", "basis", "resolved_provision_id")


@query(f"with {_refs_sql(_PARA)}, {_RESOLVED} select kind, count(*) filter (r) resolved, count(*) filter (not r) unresolved, round(count(*) filter (r) / count(*), 6) coverage from (select kind, resolved_ecli is not null r from cases union all select 'provision', resolved_provision_id is not null from provs) group by kind")
def a11_extraction_coverage(spark, d):
    """Resolution by kind of what was extracted."""
    refs = _refs(spark, d)
    keys = ["doc", "paragraph_idx", "span_start", "pattern_ord"]
    cases = extract.resolve_decisions(refs.filter("kind <> 'provision'"), merge.first_writer(table(spark, d, "decision_alias")), keys).select("kind", F.col("resolved_ecli").isNotNull().alias("resolved"))
    acts = extract.resolve_provisions(refs, table(spark, d, "provision")).select("kind", F.col("resolved_provision_id").isNotNull().alias("resolved"))
    return extract.resolution_stats(cases.unionByName(acts))


_SPAN = "doc, paragraph_idx, kind, raw_text, span_start, span_end"


@query(f"""with {_refs_sql("select distinct ecli doc, idx paragraph_idx, body from decision_paragraph")}, f as (select distinct {_SPAN} from refs), g as (select distinct ecli doc, paragraph_idx, kind, raw_text, span_start, span_end from reference_span),
n as (select kind, (select count(*) from (select {_SPAN} from g where g.kind = k.kind intersect select {_SPAN} from f)) tp, (select count(*) from f where f.kind = k.kind) nf, (select count(*) from g where g.kind = k.kind) ng from (select kind from f union select kind from g) k)
select kind, tp, nf - tp fp, ng - tp fn, round(tp / nullif(nf, 0), 6) as precision, round(tp / nullif(ng, 0), 6) recall from n""")
def a18_span_scores(spark, d):
    """Extracted spans against those of reference_span, over the stored bodies."""
    from kodex.operators.evaluate import span_scores

    rows = table(spark, d, "decision_paragraph").select(F.col("ecli").alias("doc"), F.col("idx").alias("paragraph_idx"), "body")
    found = extract.references(rows)
    gold = table(spark, d, "reference_span").select(F.col("ecli").alias("doc"), "paragraph_idx", "kind", "raw_text", "span_start", "span_end")
    return span_scores(gold, found, ["doc", "paragraph_idx", "raw_text", "span_start", "span_end"])


_CASES = r"""m as (select trim(regexp_replace(unnest(regexp_extract_all(body, 'sp\.\s*zn\.\s*((?:Pl\.|[IVX]+\.?)\s*ÚS\s+\d+/\d{2,4})', 1)), '\s+', ' ', 'g')) spelling from decision_paragraph where contains(body, 'ÚS')),
k as (select case when starts_with(spelling, 'Pl') then 'Pl' else list_position(['I', 'II', 'III', 'IV'], regexp_extract(spelling, '^([IVX]+)', 1))::varchar end || '-' || regexp_extract(spelling, '(\d+)/', 1) || '-' || right(spelling, 2) || '_1' as key, spelling, count(*) n from m group by all),
histogram as (select key, arg_min(spelling, (-n, spelling)) spelling, sum(n)::bigint mentions from k where key is not null group by key)"""
_STORED_KEY = r"""case when regexp_matches(c, '^(?i)pl') then 'Pl' else cast(list_position(['I', 'II', 'III', 'IV'], upper(regexp_extract(c, '^([IVXivx]+)', 1))) as varchar) end || '-' || regexp_extract(c, '(\d+)/', 1) || '-' || right(regexp_extract(c, '/(\d{2,4})$', 1), 2) || '_1'"""


@query(rf"""with {_CASES}, stored as (select distinct {_STORED_KEY} as key from (select trim(case_no) c from decision) where regexp_matches(c, '^(?i)(?:Pl\.?|[IVX]+\.?)\s*ÚS\s*\d+/\d{{2,4}}$'))
select h.key, spelling, mentions, s.key is not null as known from histogram h left join stored s on s.key = h.key""")
def a19_case_mentions(spark, d):
    """Each constitutional case that paragraphs mention, by document key, and whether its decision is stored already."""
    stored = table(spark, d, "decision").select(legal.sign_key(F.col("case_no")).alias("key")).filter("key is not null").distinct().withColumn("known", F.lit(True))
    return a19_case_histogram(spark, d).join(stored, "key", "left").fillna(False, ["known"])


@query(f"with {_CASES} select key, spelling, mentions from histogram order by mentions desc, key")
def a19_case_histogram(spark, d):
    """Mentions of each constitutional case by document key, both forms of the year in one, with the most frequent spelling; most cited first."""
    p = dict((x.name, x) for x in PATTERNS)["case_no_us"]
    rows = table(spark, d, "decision_paragraph").filter(F.col("body").contains(p.holds)).select(F.explode(F.regexp_extract_all("body", F.lit(p.regex), F.lit(1))).alias("raw"))
    return case_histogram(rows.select(text.squeeze(F.col("raw")).alias("spelling"))).orderBy(F.desc("mentions"), "key")


def case_histogram(mentions: DataFrame) -> DataFrame:
    """(key, spelling, mentions) of the cases that (spelling) names: the most frequent spelling, the least one of several, and all mentions."""
    per = mentions.groupBy(legal.sign_key(F.col("spelling")).alias("key"), "spelling").agg(F.count("*").alias("n")).filter("key is not null")
    return per.groupBy("key").agg(F.min_by("spelling", F.struct(-F.col("n"), "spelling")).alias("spelling"), F.sum("n").alias("mentions"))


@query("select substr(content_type, 1, case when strpos(content_type, ';') > 0 then strpos(content_type, ';') - 1 else length(content_type) end) prefix, count(*) n from cached_page where content_type is not null group by 1")
def a20_prefix_counts(spark, d):
    return table(spark, d, "cached_page").filter("content_type is not null").groupBy(F.substring_index("content_type", ";", 1).alias("prefix")).agg(F.count("*").alias("n"))


@query("""with days as (select court_code, unnest(generate_series(min(decided_on), max(decided_on), interval 1 day))::date as day from decision group by 1),
seen as (select court_code, decided_on as day, count(*) n, count(distinct ecli) m from decision group by 1, 2)
select d.court_code, d.day, coalesce(n, 0) reported, coalesce(m, 0) seen, greatest(coalesce(n, 0) - coalesce(m, 0), 0) missing from days d left join seen s on s.court_code = d.court_code and s.day = d.day""")
def a22_days(spark, d):
    """Fetched and distinct decisions for every day of each court's span, and how many fell short."""
    rows = table(spark, d, "decision")
    days = rows.groupBy("court_code").agg(F.min("decided_on").alias("a"), F.max("decided_on").alias("b")).select("court_code", F.explode(F.sequence("a", "b")).alias("day"))
    seen = rows.groupBy("court_code", F.col("decided_on").alias("day")).agg(F.count("*").alias("reported"), F.count_distinct("ecli").alias("seen"))
    return days.join(seen, ["court_code", "day"], "left").fillna(0, ["reported", "seen"]).withColumn("missing", F.greatest(F.col("reported") - F.col("seen"), F.lit(0)))


@query(f"with {_refs_sql(_PARA)}, {_sentences_sql('select doc, paragraph_idx, body t from para', 'doc, paragraph_idx')}, said as (select *, {_LOWER.format('sentence')} form from sentences)"
    + f""" select s.doc, s.paragraph_idx, sentence_start, sentence, coalesce((select string_agg(b.body, chr(10) || chr(10) order by b.paragraph_idx) from para b where b.doc = s.doc and b.paragraph_idx between s.paragraph_idx - 3 and s.paragraph_idx - 1 and b.body <> ''), '') context
from said s where ({" or ".join(f"contains(form, '{t}')" for t in extract.TRIGGERS)}) and not exists (select 1 from refs r where r.doc = s.doc and r.paragraph_idx = s.paragraph_idx and r.span_start < s.sentence_start + length(s.sentence) and r.span_end > s.sentence_start)""")
def c6_back_references(spark, d):
    """Sentences that refer back and hold no citation, with the paragraphs before them."""
    rows = _paragraphs(spark, d)
    found = extract.back_references(rows, _refs(spark, d))
    return found.join(extract.preceding_context(rows), ["doc", "paragraph_idx"]).select("doc", "paragraph_idx", F.col("start").alias("sentence_start"), "sentence", "context")


@query("""with p as (select ecli, idx, min_by(body, para_id) body from decision_paragraph group by 1, 2)
select ecli, idx, array_to_string(list(body) over (partition by ecli order by idx rows between 2 preceding and 2 following), chr(10) || chr(10)) context,
  least(row_number() over (partition by ecli order by idx) - 1, 2)::int focus from p""".replace("min_by(", "arg_min("))
def w1_context_windows(spark, d):
    rows = table(spark, d, "decision_paragraph").groupBy("ecli", "idx").agg(F.min_by("body", "para_id").alias("body"))
    return graph.context_windows(rows).select("ecli", "idx", F.array_join("context", "\n\n").alias("context"), F.col("focus").cast("int").alias("focus"))


_VERDICTS = f"""whole as (select ecli, idx, arg_min(body, para_id) body from decision_paragraph group by 1, 2),
folded as (select *, replace(lower({_SQUEEZE.format(_CZ.format(r"regexp_replace(body, '\\p{M}', '', 'g')"))}), ' ', '') f, case when regexp_matches(ecli, '^(nalus|ECLI:CZ:US):') then 'US' when starts_with(ecli, 'ECLI:CZ:NSS:') then 'NSS' end court,
  row_number() over (partition by ecli order by idx) r from whole),
starts as (select ecli, max(idx) s from folded where court = 'US' and r <= 6 and (f = 'vyrok' or f like '%takto:') group by 1 union all select ecli, min(idx) from folded where court = 'NSS' and f like 'takto%' group by 1),
later as (select f.* from folded f join starts s on s.ecli = f.ecli and f.idx > s.s), stops as (select ecli, min(idx) e from later where starts_with(f, 'oduvodneni') or (court = 'NSS' and regexp_matches(body, '^\\[\\d+\\]')) group by 1),
verdicts as (select l.ecli, trim(string_agg(body, chr(10) order by idx)) verdict_text from later l left join stops e on e.ecli = l.ecli where e.e is null or idx < e.e group by 1 having trim(string_agg(body, chr(10) order by idx)) <> '')"""


def _bodies(spark, d):
    """(ecli, idx, body): a paragraph that was loaded twice once."""
    return table(spark, d, "decision_paragraph").groupBy("ecli", "idx").agg(F.min_by("body", "para_id").alias("body"))


def _verdicts(rows):
    return pages.verdicts(rows.filter(pages.has_layout(F.col("ecli"))))


def _edges(spark, d):
    """Citation edges with both decisions, the aliases of the cited one, the context and the citing verdict."""
    rows = decisions(spark, d).select("ecli", "panel_type", "decided_on", "case_no", "ref_no", "journal_no")
    c = stage(citations(spark, d).filter("cited_ecli is not null"))
    names = merge.alias_rows(rows).filter("alias_kind <> 'journal_no'").groupBy("ecli").agg(F.array_sort(F.collect_set("alias")).alias("cited_names"))
    citing = rows.select(F.col("ecli").alias("citing_ecli"), F.col("panel_type").alias("citing_panel"), F.col("decided_on").alias("citing_date"))
    cited = rows.join(names, "ecli", "left").select(F.col("ecli").alias("cited_ecli"), F.col("decided_on").alias("cited_date"), "cited_names")
    paragraphs = stage(_bodies(spark, d))
    # contexts of cited paragraphs alone; a decision's window is at most four paragraphs wider
    windows = graph.context_windows(paragraphs).select(F.col("ecli").alias("citing_ecli"), F.col("idx").alias("paragraph_idx"), "context", "focus").join(c.select("citing_ecli", "paragraph_idx").distinct(), ["citing_ecli", "paragraph_idx"], "left_semi")
    verdicts = _verdicts(paragraphs).withColumnRenamed("ecli", "citing_ecli")
    edges = enriched(enriched(c, citing, ["citing_ecli"], "inner", counted=c), cited, ["cited_ecli"], "inner", counted=c)
    edges = enriched(edges.join(windows, ["citing_ecli", "paragraph_idx"], "left"), verdicts, ["citing_ecli"], counted=c)
    return edges.withColumn("context", F.coalesce("context", F.array().cast("array<string>"))).withColumn("focus", F.coalesce("focus", F.lit(0))).withColumn("cited_names", F.coalesce("cited_names", F.array().cast("array<string>")))


_has = lambda names: "(" + " or ".join(f"contains(form, '{p}')" for p in names) + ")"
_ROUTES = sql("dec cit", "").rstrip() + f""",
{_VERDICTS},
near as (select ecli, idx, body, array_to_string(list(body) over (partition by ecli order by idx rows between 2 preceding and 2 following), chr(10) || chr(10)) around from whole),
called as (select ecli, list(distinct form) names from (select ecli, unnest([{_LOWER.format('ecli')}, {_LOWER.format('case_no')}, {_LOWER.format('ref_no')}]) form from dec) where form <> '' group by ecli),
edges as (select c.id, a.panel_type citing_panel, coalesce(b.decided_on < a.decided_on, false) in_order, {_LOWER.format('c.raw_text')} cited, n.body here, n.around, v.verdict_text, k.names from cit c join dec a on a.ecli = c.citing_ecli join dec b on b.ecli = c.cited_ecli
  left join near n on n.ecli = c.citing_ecli and n.idx = c.paragraph_idx left join verdicts v on v.ecli = c.citing_ecli left join called k on k.ecli = c.cited_ecli where c.cited_ecli is not null),
{_sentences_sql("select id, 'h' k, here t from edges where here is not null union all select id, 'a', around from edges where around is not null union all select id, 'v', verdict_text from edges where verdict_text is not null", "id, k")},
said as (select s.*, {_LOWER.format('sentence')} form, e.cited, e.names, e.in_order from sentences s join edges e on e.id = s.id),
flags as (select id, arg_min(sentence, sentence_start) filter (k = 'v' and in_order and {_has(classify.QUASHING)} and list_bool_or(list_transform(names, lambda n: contains(form, n)))) q,
  arg_min(sentence, sentence_start) filter (k = 'h' and cited <> '' and {_has(classify.PARTY)} and contains(form, cited)) m, arg_min(sentence, sentence_start) filter (k = 'h' and cited <> '' and contains(form, cited)) c,
  coalesce(bool_or(k = 'a' and {_has(classify.DEPARTURE)}), false) departs, coalesce(bool_or(k = 'a' and {_has(classify.NARROWING)}), false) narrows from said group by id),
reasons_ as (select e.id, q, m, c, case when q is not null then 'quashed' when m is not null then 'party_submission' when citing_panel in ('extended', 'grand', 'plenary') then 'panel_type' when departs then 'departure_marker'
  when narrows then 'narrowing_marker' when c is null then 'low_confidence' else 'triage' end reason from edges e left join flags f on f.id = e.id),
routes as (select id, case when reason in ('quashed', 'party_submission') then 'structural' when reason = 'triage' then 'triage' else 'reasoning' end route, reason,
  case reason when 'quashed' then 'QUASHED' when 'party_submission' then 'MENTIONED' when 'triage' then 'FOLLOWED' end as label,
  cast(case reason when 'quashed' then 1.00 when 'party_submission' then 0.95 when 'triage' then 0.80 end as decimal(3,2)) confidence, case reason when 'quashed' then q when 'party_submission' then m when 'triage' then c end evidence_span from reasons_)
"""


@query(_ROUTES + "select id, route, reason, label, confidence, evidence_span from routes")
def c11_routes(spark, d):
    """Every edge with its cheap label, or why it needs a closer look."""
    return classify.route(spread(_edges(spark, d), "id")).select("id", "route", "reason", "label", "confidence", "evidence_span")


@query(_ROUTES + "select route, reason, count(*) n, round(count(*) / sum(count(*)) over (), 6) share from routes group by route, reason")
def a13_route_shares(spark, d):
    return classify.route_shares(classify.route(spread(_edges(spark, d), "id")))


@query(f"with {_VERDICTS} select ecli, verdict_text from verdicts")
def w9_verdicts(spark, d):
    """The operative part of each decision of a court whose pages' layout is known."""
    return _verdicts(_bodies(spark, d))


def _bold_pages(spark, d):
    """(ecli, html) of a page for each constitutional decision: some paragraphs with emphasis, then the verdict in bold under its label."""
    filler = F.repeat(F.lit("<p>Odstavec <b>zvýrazněný text</b> návrhu.</p>"), F.length("ecli") % 9)
    html = F.concat(F.lit('<html><head><title>x</title></head><body><div class="DocContent">'), filler, F.lit("<p><b>V ý r o k<br/>Stížnost "), "ecli", F.lit(" se&nbsp;odmítá.</b></p><p>Odůvodnění</p></div></body></html>"))
    return table(spark, d, "decision").filter("court_code = 'US'").select("ecli").distinct().select("ecli", html.alias("html"))


_BOLD = "bold as (select distinct ecli, 'Stížnost ' || ecli || ' se odmítá.' bold from decision where court_code = 'US' and length(ecli) % 9 + 2 <= 6)"


@query(f"with {_BOLD} select ecli, bold verdict_text from bold")
def s21_bold_verdicts(spark, d):
    """The verdict that a page sets in bold within its first six paragraphs, without its label."""
    return _bold_pages(spark, d).select("ecli", pages.bold_verdict(F.col("html")).alias("verdict_text")).filter("verdict_text is not null")


@query(f"with {_VERDICTS}, {_BOLD} select coalesce(b.ecli, v.ecli) ecli, coalesce(bold, verdict_text) verdict_text from bold b full join verdicts v on v.ecli = b.ecli")
def s19_cached_verdicts(spark, d):
    """Each decision's verdict: what its cached page sets in bold, else what its paragraphs announce."""
    return pages.cached_verdicts(_bodies(spark, d), _bold_pages(spark, d))


@query(r"""with n as (select ecli, cast(regexp_extract(body, '^\[(\d{1,9})\]', 1) as int) no, idx, para_id from decision_paragraph where regexp_matches(body, '^\[\d{1,9}\]')),
f as (select ecli, no, arg_min(para_id, idx * 10000000000 + para_id) para_id from n where no >= 1 group by 1, 2), ok as (select ecli from f group by ecli having count(*) >= 3 and min(no) = 1)
select f.ecli, no, para_id from f join ok on ok.ecli = f.ecli""")
def w8_numbered_paragraphs(spark, d):
    return pages.numbered(table(spark, d, "decision_paragraph"))


_LINES = "text"
for _p, _r in [("(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<head\\b.*?</head\\s*>", "''"), ("[\\r\\n]+", "' '"), ("(?i)<br\\s*/?>|</(?:p|div|tr|li|h[1-6]|table|blockquote|title)\\s*>", "chr(10)"), ("<[^<>]*>", "''")]:
    _LINES = f"regexp_replace({_LINES}, '{_p}', {_r}, 'g')"
for _p, _r in pages.ENTITIES.items():
    _LINES = f"replace({_LINES}, '&{_p};', '" + _r.replace("'", "''") + "')"


@query(f"select page_id, unnest(c) body, generate_subscripts(c, 1)::int idx from (select page_id, list_filter(list_transform(string_split({_LINES}, chr(10)), lambda x: {_SQUEEZE.format('x')}), lambda x: x <> '') c from cached_page)")
def s15_page_paragraphs(spark, d):
    """The paragraphs of every cached page."""
    return pages.paragraphs(widened(table(spark, d, "cached_page").select("page_id", "text")), "page_id", "text")


@query(r"""select page_id, regexp_extract(text, '(?s)<title>(.*?)</title>', 1) title, list_position([true], status between 200 and 299) is not null ok from cached_page""")
def s16_page_titles(spark, d):
    return table(spark, d, "cached_page").select("page_id", F.regexp_extract("text", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.col("status").between(200, 299).alias("ok"))
