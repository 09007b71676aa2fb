"""History queries: events as commits (author: user, lines: event id and value), lineitem as files of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.operators import history as H
from codehealth.plans.registry import query, table


def commits(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("commit_hash"), F.concat(F.lit("u"), "user_id").alias("author_name"), F.col("ts").alias("committed_at"), (F.col("event_id") % 90).alias("added"), (F.col("event_id") % 7).alias("removed")
    )


COMMITS = "(select cast(event_id as varchar) commit_hash, concat('u', user_id) author_name, ts committed_at, event_id % 90 added, event_id % 7 removed from events)"


def files(spark, sf_dir) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    return i.select(
        F.col("l_orderkey").alias("commit_hash"), F.concat(F.lit("p"), "l_partkey").alias("path"), F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("removed")
    )


FILES = "(select l_orderkey commit_hash, concat('p', l_partkey) path, cast(l_quantity as bigint) added, cast(l_linenumber as bigint) removed from lineitem)"
ONCE = f"(select commit_hash, path, sum(added) added, sum(removed) removed from {FILES} group by all)"
CHURN = f"(select path, count(*) commits, cast(sum(added) as bigint) added, cast(sum(removed) as bigint) removed from {ONCE} group by path)"
TOP = f"(select * from {CHURN} order by commits desc, added desc, path limit 10)"
AS_OF = "2024-01-31 00:00:00"


@query(f"select strftime(date_trunc('week', committed_at), '%Y-%m-%d') as week, count(*) as commits, cast(sum(added) as bigint) as added, cast(sum(removed) as bigint) as removed from {COMMITS} group by 1")
def a1_weekly_trend(spark, sf_dir):
    return H.weekly_trend(commits(spark, sf_dir))


@query("select strftime(date_trunc('week', l_shipdate), '%Y-%m-%d') as week, count(*) as commits, cast(sum(l_quantity) as bigint) as added, cast(sum(l_linenumber) as bigint) as removed from lineitem group by 1")
def a1_weekly_trend_of_shipments(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("committed_at"), F.col("l_quantity").alias("added"), F.col("l_linenumber").alias("removed"))
    return H.weekly_trend(i)


@query(f"select coalesce(nullif(author_name, ''), 'unknown') as author, count(*) as commits, cast(sum(added) as bigint) as added from {COMMITS} group by 1")
def a2_author_totals(spark, sf_dir):
    return H.author_totals(commits(spark, sf_dir))


@query(f"select * from {CHURN}")
def a3_file_churn(spark, sf_dir):
    return H.file_churn(files(spark, sf_dir))


@query(f"select * from {TOP}")
def o4_top_files(spark, sf_dir):
    return H.top_files(files(spark, sf_dir))


@query(
    f"""select module, risk_level, evidence from (
    select path as module,
      case when (commits / total >= 0.0005 and added >= 300) or added >= 1200 then 'HIGH' when commits >= 3 then 'MEDIUM' end as risk_level,
      concat('commits: ', commits, '; share: ', cast(round_even(commits / total * 100, 0) as bigint), '%; added: ', added, '; removed: ', removed) as evidence
    from {TOP}, (select count(distinct commit_hash) total from {FILES})) where risk_level is not null"""
)
def h1_hotspots(spark, sf_dir):
    found = H.hotspots(files(spark, sf_dir), share=0.0005, min_added=300, huge_added=1200)
    return found.withColumn("evidence", F.array_join("evidence", "; "))


@query(
    f"""with recent as (select * from {COMMITS} where committed_at >= timestamp '{AS_OF}' - interval 30 days)
    select 'trend' as kind, strftime(date_trunc('week', committed_at), '%Y-%m-%d') as key, count(*) as a, cast(sum(added) as bigint) as b from recent group by 2
    union all select 'author', coalesce(nullif(author_name, ''), 'unknown'), count(*), cast(sum(added) as bigint) from recent group by 2
    union all select 'file', path, commits, added from {TOP}"""
)
def h2_history_bundle(spark, sf_dir):
    return H.history_bundle(commits(spark, sf_dir), files(spark, sf_dir), AS_OF, "no such range")


@query(f"select commit_hash, author_name from {COMMITS} where committed_at >= timestamp '{AS_OF}' - interval 14 days")
def s6_range_filter(spark, sf_dir):
    return H.in_last_days(commits(spark, sf_dir), "committed_at", AS_OF, 14).select("commit_hash", "author_name")


@query(f"select count(*) as n, min(strftime(committed_at, '%Y-%m-%d')) as first_day from {COMMITS} where committed_at >= timestamp '{AS_OF}' - interval 90 days")
def f10_range_by_name(spark, sf_dir):
    return H.in_range(commits(spark, sf_dir), "committed_at", AS_OF, "90d").agg(F.count("*").alias("n"), F.min(F.date_format("committed_at", "yyyy-MM-dd")).alias("first_day"))


def dependencies(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") % 3 == 0, "maven").when(F.col("p_size") % 3 == 1, "npm").otherwise("cargo").alias("ecosystem"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("latest"),
        F.when(F.col("p_size") % 8 != 0, F.col("p_brand")).alias("risk_reason"),
        (F.col("p_size") % 2 == 0).alias("is_eol"),
        F.when(F.col("p_size") > 40, "HIGH").when(F.col("p_size") > 20, "MEDIUM").alias("risk_level"),
    )


DEPENDENCIES = """(select p_partkey id, case p_size % 3 when 0 then 'maven' when 1 then 'npm' else 'cargo' end ecosystem, p_name as name, case when p_size % 4 <> 0 then p_type end latest,
  case when p_size % 8 <> 0 then p_brand end risk_reason, p_size % 2 = 0 is_eol, case when p_size > 40 then 'HIGH' when p_size > 20 then 'MEDIUM' end risk_level from part)"""


@query(
    f"""select id, case when is_eol and latest is not null then concat('upgrade to ', latest) when is_eol then concat('confirm support: ', coalesce(risk_reason, '')) end as suggestion,
    case ecosystem when 'maven' then 'MAVEN' when 'npm' then 'NPM' when 'pip' then 'PIP' else 'OTHER' end as ecosystem_code from {DEPENDENCIES}"""
)
def h3_dependency_results(spark, sf_dir):
    return H.dependency_results(dependencies(spark, sf_dir)).select("id", "suggestion", "ecosystem_code")


@query(f"select ecosystem, count(*) as total, count(*) filter (is_eol) as eol, count(*) filter (risk_level = 'HIGH') as high from {DEPENDENCIES} group by 1")
def a6_dependency_stats(spark, sf_dir):
    return H.dependency_stats(dependencies(spark, sf_dir), ["ecosystem"])
