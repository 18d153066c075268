"""Tables of the data model that the data folder lacks, derived from those it has by rules that SQL can state as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kodex.operators import merge
from kodex.schema import AUTHORITY, LABELS
from kodex.sources.tables import table

#: The day of the questions.
AS_OF = "2022-06-30"


def day():
    return F.lit(AS_OF).cast("date")


def decisions(spark: SparkSession, d: str) -> DataFrame:
    return merge.current_decisions(table(spark, d, "decision"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    return merge.citations(table(spark, d, "reference_span"))


def treatments(spark: SparkSession, d: str) -> DataFrame:
    """A label for every citation by its id, and a later one of another prompt version for each fifth."""
    c = citations(spark, d)
    labels = F.array(*[F.lit(x) for x in LABELS])
    row = lambda k: F.struct(
        (F.col("id") * 2 + k).alias("tid"),
        F.get(labels, ((F.col("id") * 7 + 3 * k) % 8).cast("int")).alias("label"),
        ((F.lit(100) - (F.col("id") * 13 + k) % 60) / 100).cast("decimal(3,2)").alias("confidence"),
        F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("id") % 300) + 10 * k).cast("int")).alias("created_at"),
        F.lit(f"v{k + 1}").alias("prompt_version"),
    )
    rows = F.when(F.col("id") % 5 == 0, F.array(row(0), row(1))).otherwise(F.array(row(0)))
    return c.select(F.col("id").alias("citation_id"), F.col("raw_text").alias("evidence_span"), F.inline(rows)).withColumnRenamed("tid", "id")


def judgements(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on pairs of successive wordings of a provision: three of four pairs have one, some a second."""
    v = table(spark, d, "provision_version").select("provision_id", "id", "valid_from")
    pairs = v.select("provision_id", F.col("id").alias("from_version_id"), F.col("valid_from").alias("f")).join(v.select("provision_id", F.col("id").alias("to_version_id"), F.col("valid_from").alias("t")), "provision_id").filter("f < t")
    s = F.col("from_version_id") + F.col("to_version_id")
    row = lambda k: F.struct((s % 3 == k).alias("material"), F.lit(f"v{k + 1}").alias("prompt_version"), F.date_add(F.lit("2024-01-01").cast("date"), k).alias("created_at"))
    return pairs.filter(s % 4 != 0).select("from_version_id", "to_version_id", F.inline(F.when(s % 5 == 0, F.array(row(0), row(1))).otherwise(F.array(row(0)))))


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: str(x).lower() if isinstance(x, bool) else f"'{x}'"
    return "(values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") t({names})"


SQL = {
    "dec": """dec as (
  select distinct on (d.ecli) d.* exclude (ratio_summary), r.ratio_summary
  from decision d left join (select ecli, arg_max(ratio_summary, fetched_at) ratio_summary from decision where ratio_summary is not null group by ecli) r on r.ecli = d.ecli
  order by d.ecli, d.fetched_at desc, d.source_url desc, d.panel_type desc)""",
    "cit": """cit as (
  select min(ref_id) id, ecli citing_ecli, resolved_ecli cited_ecli, resolved_provision_id cited_provision, paragraph_idx, raw_text, extractor
  from reference_span where resolved_ecli is not null or resolved_provision_id is not null group by all)""",
    "trt": f"""trt as (
  select id * 2 + k id, id citation_id, raw_text evidence_span, {LABELS}[((id * 7 + 3 * k) % 8) + 1] as label,
    cast((100 - (id * 13 + k) % 60) / 100 as decimal(3,2)) confidence, date '2024-01-01' + cast(id % 300 + 10 * k as int) created_at, 'v' || (k + 1) prompt_version
  from cit, (values (0), (1)) x(k) where k = 0 or id % 5 = 0)""",
    "latest": "latest as (select distinct on (citation_id) * from trt order by citation_id, created_at desc, id desc)",
    "jud": """jud as (
  select a.id from_version_id, b.id to_version_id, (a.id + b.id) % 3 = k material, 'v' || (k + 1) prompt_version, date '2024-01-01' + k created_at
  from provision_version a join provision_version b on a.provision_id = b.provision_id and a.valid_from < b.valid_from, (values (0), (1)) x(k)
  where (a.id + b.id) % 4 <> 0 and (k = 0 or (a.id + b.id) % 5 = 0))""",
    "authority": f"authority as (select * from {_values(AUTHORITY, 'citing_court, citing_panel, cited_court, binding')})",
    "labelled": """labelled as (
  select c.id citation_id, c.citing_ecli, c.cited_ecli, c.paragraph_idx, t.label, t.confidence, t.evidence_span, a.court_code citing_court, a.panel_type citing_panel, a.decided_on citing_date,
    b.court_code cited_court, coalesce(u.binding, false) may_depart
  from cit c join latest t on t.citation_id = c.id join dec a on a.ecli = c.citing_ecli join dec b on b.ecli = c.cited_ecli
  left join authority u on u.citing_court = a.court_code and u.citing_panel = a.panel_type and u.cited_court = b.court_code
  where c.citing_ecli <> c.cited_ecli)""",
    "follows": "follows as (select distinct c.citing_ecli, c.cited_ecli from cit c join latest t on t.citation_id = c.id where t.label = 'FOLLOWED' and c.cited_ecli is not null and c.citing_ecli <> c.cited_ecli)",
    "now": f"""now as (select distinct on (provision_id) provision_id, id, body, valid_from from provision_version where valid_from <= date '{AS_OF}' and (valid_to is null or valid_to >= date '{AS_OF}')
  order by provision_id, valid_from desc, id desc)""",
    "derog": f"""derog as (select distinct on (v.provision_id) v.provision_id, v.derogated_by, x.decided_on derogated_on from provision_version v join dec x on x.ecli = v.derogated_by
  where x.decided_on <= date '{AS_OF}' order by v.provision_id, x.decided_on desc, v.derogated_by desc)""",
    "then_": """then_ as (select distinct on (c.citing_ecli, c.cited_provision) c.citing_ecli, c.cited_provision provision_id, x.decided_on, v.id, v.body, v.valid_from
  from cit c join dec x on x.ecli = c.citing_ecli left join provision_version v on v.provision_id = c.cited_provision and v.valid_from <= x.decided_on and (v.valid_to is null or v.valid_to >= x.decided_on)
  where c.cited_provision is not null order by c.citing_ecli, c.cited_provision, v.valid_from desc nulls last, v.id desc)""",
    "mat": "mat as (select distinct on (from_version_id, to_version_id) * from jud order by from_version_id, to_version_id, created_at desc, prompt_version desc)",
    "relied": """relied as (select t.citing_ecli ecli, t.provision_id, coalesce(t.body <> n.body, false) reworded, case when t.id is distinct from n.id then n.valid_from end changed_on, coalesce(m.material, false) material, g.derogated_by
  from then_ t left join now n on n.provision_id = t.provision_id left join mat m on m.from_version_id = t.id and m.to_version_id = n.id left join derog g on g.provision_id = t.provision_id)""",
    "own": f"""own as (
  select cited_ecli ecli, 1 row_ord, 'Quashed' kind, citing_ecli by_ecli, null panel, evidence_span span, null::bigint provision_id, null::date changed_on, null::bigint citation_id, null via_ecli from labelled where citing_date <= date '{AS_OF}' and label = 'QUASHED' and confidence >= 0.85
  union select cited_ecli, 2, 'Superseded', citing_ecli, citing_panel, evidence_span, null, null, null, null from labelled where citing_date <= date '{AS_OF}' and label = 'DEPARTED' and may_depart and confidence >= 0.85
  union select ecli, 3, 'ProvisionDerogated', derogated_by, null, null, provision_id, null, null, null from relied where derogated_by is not null and (changed_on is null or changed_on <= date '{AS_OF}')
  union select cited_ecli, 4, 'Conflict', citing_ecli, null, evidence_span, null, null, null, null from labelled where citing_date <= date '{AS_OF}' and label = 'DEPARTED' and not may_depart and confidence >= 0.60
  union select cited_ecli, 5, 'Narrowed', citing_ecli, null, evidence_span, null, null, null, null from labelled where citing_date <= date '{AS_OF}' and label = 'NARROWED' and confidence >= 0.60
  union select ecli, 6, 'ProvisionReworded', null, null, null, provision_id, changed_on, null, null from relied where reworded and material and changed_on <= date '{AS_OF}'
  union select cited_ecli, 7, 'NeedsReview', citing_ecli, null, null, null, null, citation_id, null from labelled where citing_date <= date '{AS_OF}' and label = 'UNCLASSIFIED')""",
    "day_": "day_ as (select ecli, decided_on from dec)",
    "every": """red as (select distinct ecli from own where row_ord <= 3),
every as (select * from own where ecli in (select ecli from dec) union all
  select f.citing_ecli, 8, 'InheritedWeakness', null, null, null, null, null, null, f.cited_ecli from follows f join red on red.ecli = f.cited_ecli where f.citing_ecli in (select ecli from dec))""",
}


def sql(names: str, text: str) -> str:
    """`text` after the named derived tables."""
    return "with " + ",\n".join(SQL[n] for n in names.split()) + "\n" + text
