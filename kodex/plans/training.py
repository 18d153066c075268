"""Queries of the general training-data operators (problems 4 to 6) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kodex.operators import asof, history, sweep
from kodex.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    return asof.known_provisions(t("evaluation_context"), t("reference_span"), t("decision"), t("provision_version"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return history.provision_history(table(spark, d, "provision_dump"), table(spark, d, "provision"))


def p5_patches(spark: SparkSession, d: str) -> DataFrame:
    """The checkpoint-delta store itself: how many versions and attribute patches each provision has."""
    store = history.dump_store(table(spark, d, "provision_dump")).patches().withColumnRenamed("_sub", "subsec")
    return store.groupBy("act_no", "section", "subsec").agg(
        F.count("*").alias("versions"),
        F.count_if("is_full").alias("full_copies"),
        F.count_if(F.expr("not is_full and patch_body is not null")).alias("body_patches"),
        F.count_if(F.expr("not is_full and patch_valid_to is not null")).alias("end_patches"),
    )


def p5_at_day(spark: SparkSession, d: str) -> DataFrame:
    """The wording of each provision that began last by a day, folded from the nearest checkpoint."""
    store = history.dump_store(table(spark, d, "provision_dump"))
    return store.latest_by(F.lit("2015-06-30").cast("date")).select("act_no", "section", F.col("_sub").alias("subsec"), "valid_from", "body")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sweep.coverage(table(spark, d, "provision_version"), "provision_id", "valid_from", "valid_to")


QUERIES = {"p4_found": p4_found, "p5_found": p5_found, "p5_patches": p5_patches, "p5_at_day": p5_at_day, "p6_found": p6_found}

_IN_FORCE = """select v.id from provision_version v where v.provision_id = r.provision_id and v.valid_from <= {day} and (v.valid_to is null or v.valid_to >= {day}) and v.recorded_on <= {day}
    order by v.valid_from desc, v.recorded_on desc, v.id desc limit 1"""

_SETTLED = """settled as (
  select act_no, section, coalesce(subsec, '') subsec, valid_from, valid_to, body, derogated_by
  from provision_dump where valid_from is not null and (valid_to is null or valid_to >= valid_from)
  qualify row_number() over (partition by act_no, section, coalesce(subsec, ''), valid_from order by dump_on desc nulls last, rec_id desc) = 1)"""

ORACLE = {
    "p4_found": f"""
with relied as (select distinct ecli, resolved_provision_id provision_id from reference_span where resolved_provision_id is not null),
decided as (select ecli, max(decided_on) decided_on from decision group by ecli),
r as (select c.request_id, relied.provision_id, d.decided_on, c.as_of from evaluation_context c join relied on relied.ecli = c.ecli left join decided d on d.ecli = c.ecli)
select distinct request_id, provision_id,
  coalesce(({_IN_FORCE.format(day="r.decided_on")}), 0) decided_version_id,
  coalesce(({_IN_FORCE.format(day="r.as_of")}), 0) asof_version_id
from r""",
    "p5_found": rf"""
with {_SETTLED},
closed as (select p.id provision_id, valid_from f, least(valid_to, lead(valid_from) over w - 1)::date t,
    trim(regexp_replace(body, '\s+', ' ', 'g')) b, derogated_by g
  from settled s join provision p on p.act_no = s.act_no and p.section = s.section and coalesce(p.subsec, '') = s.subsec
  window w as (partition by p.id order by valid_from)),
runs as (select *, case when lag(t) over w + 1 = f and b is not distinct from lag(b) over w and g is not distinct from lag(g) over w then 0 else 1 end fresh
  from closed window w as (partition by provision_id order by f)),
numbered as (select *, sum(fresh) over (partition by provision_id order by f) run from runs)
select provision_id, strftime(min(f), '%Y-%m-%d') valid_from, coalesce(strftime(arg_max_null(t, f), '%Y-%m-%d'), '9999-12-31') valid_to
from numbered group by provision_id, run""",
    "p5_patches": f"""
with {_SETTLED},
n as (select *, row_number() over w - 1 k, body is distinct from lag(body) over w cb, valid_to is distinct from lag(valid_to) over w ct
  from settled window w as (partition by act_no, section, subsec order by valid_from))
select act_no, section, subsec, count(*) versions, count(*) filter (k % 8 = 0) full_copies,
  count(*) filter (k % 8 <> 0 and cb) body_patches, count(*) filter (k % 8 <> 0 and ct) end_patches
from n group by all""",
    "p5_at_day": f"with {_SETTLED} select act_no, section, subsec, max(valid_from) valid_from, arg_max(body, valid_from) body from settled where valid_from <= date '2015-06-30' group by act_no, section, subsec",
    "p6_found": """
with ok as (select provision_id, valid_from f, coalesce(valid_to, date '9999-12-31') t from provision_version where valid_from is not null and (valid_to is null or valid_to >= valid_from)),
m as (select *, max(t) over (partition by provision_id order by f, t rows between unbounded preceding and 1 preceding) before from ok),
n as (select *, sum(case when before is null or f > before + 1 then 1 else 0 end) over (partition by provision_id order by f, t rows unbounded preceding) run from m),
periods as (select provision_id, min(f) f, max(t) t from n group by provision_id, run)
select provision_id, 'period' kind, strftime(f, '%Y-%m-%d') day_from, strftime(t, '%Y-%m-%d') day_to from periods
union all
select provision_id, 'gap', strftime((t + 1)::date, '%Y-%m-%d'), strftime((next - 1)::date, '%Y-%m-%d')
from (select *, lead(f) over (partition by provision_id order by f) next from periods) where next is not null""",
}
