"""Scores, reports, debt, lifecycle and retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.functions.keys import file_keys
from codehealth.operators import debt as D
from codehealth.operators import documents as O
from codehealth.operators import line_rules as R
from codehealth.operators import neighbours as N
from codehealth.operators import retrieval as K
from codehealth.operators import scoring as C
from codehealth.plans import graph, history, source_code
from codehealth.plans.portfolio import RUNS, runs
from codehealth.plans.registry import query, spread, table

# --- scores ----------------------------------------------------------------------------------------------------------

SCAN = """(select o_custkey project_id, count(*) file_count, cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) loc_total, count(*) filter (o_orderstatus = 'F') bugs, count(*) filter (o_orderstatus = 'P') vulnerabilities,
  count(*) * 8 code_smells, cast(count(*) as double) * 1.7 duplication_rate, cast(o_custkey % 100 as double) coverage_rate, cast(o_custkey % 9 as double) complexity, o_custkey % 4 skipped_big, o_custkey % 6 = 0 truncated,
  o_custkey % 2 = 0 has_backend, o_custkey % 3 = 0 has_frontend, o_custkey % 5 = 0 has_top_dir, case when o_custkey % 7 = 0 then 0 else 1 end n_frameworks from orders group by o_custkey)"""


def scan(spark, sf_dir) -> DataFrame:
    k = F.col("project_id")
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(
        F.count("*").alias("file_count"), F.sum(F.floor("o_totalprice")).cast("long").alias("loc_total"), F.count_if(F.col("o_orderstatus") == "F").alias("bugs"), F.count_if(F.col("o_orderstatus") == "P").alias("vulnerabilities")
    )
    return own.select(
        "*", (F.col("file_count") * 8).alias("code_smells"), (F.col("file_count").cast("double") * 1.7).alias("duplication_rate"), (k % 100).cast("double").alias("coverage_rate"), (k % 9).cast("double").alias("complexity"),
        (k % 4).alias("skipped_big"), (k % 6 == 0).alias("truncated"), (k % 2 == 0).alias("has_backend"), (k % 3 == 0).alias("has_frontend"), (k % 5 == 0).alias("has_top_dir"),
        F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Vue"))).alias("frameworks"),
    )


QUALITY = """cast(greatest(85 - 3 * least(bugs, 5) - 5 * least(vulnerabilities, 3) - case when code_smells > 50 then least((code_smells - 50) // 50, 10) else 0 end
  - case when duplication_rate > 10 then least(floor((duplication_rate - 10) / 5), 6) else 0 end - case when coverage_rate < 50 then 8 else 0 end - case when complexity > 5 then 5 else 0 end, 40) as bigint)"""
PROXY = "cast(greatest(75 - 5 * least(skipped_big, 3) - case when truncated then 5 else 0 end, 40) as bigint)"
STRUCTURE = "cast(least(70 + case when has_backend and has_frontend then 10 when has_backend or has_frontend then 5 else 0 end + case when has_top_dir then 10 else 0 end + 5, 95) as bigint)"
SCALE = "cast(case when loc_total < 1000 then 95 when loc_total < 10000 then 90 when loc_total < 50000 then 80 when loc_total < 200000 then 65 else 50 end as bigint)"
SCORED = f"(select *, {QUALITY} quality, {STRUCTURE} structure, cast(case when n_frameworks > 0 then 75 else 70 end as bigint) dependency, {SCALE} scale from {SCAN})"
HEALTH = f"(select *, cast(round_even(quality * cast(0.4 as double) + structure * cast(0.3 as double) + dependency * cast(0.15 as double) + scale * cast(0.15 as double), 0) as bigint) health from {SCORED})"
LEVEL = "case when health >= 90 then 'EXCELLENT' when health >= 75 then 'GOOD' when health >= 60 then 'FAIR' else 'POOR' end"


@query(f"select project_id, quality from {SCORED}")
def c1_quality_score(spark, sf_dir):
    return C.scored(scan(spark, sf_dir)).select("project_id", "quality")


@query(f"select project_id, {PROXY} as quality from {SCAN}")
def c2_quality_proxy(spark, sf_dir):
    return scan(spark, sf_dir).select("project_id", C.quality_by_proxy(F.col("skipped_big"), F.col("truncated")).alias("quality"))


@query(f"select project_id, structure from {SCORED}")
def c3_structure_score(spark, sf_dir):
    return C.scored(scan(spark, sf_dir)).select("project_id", "structure")


@query(f"select project_id, dependency, scale from {SCORED}")
def c4_dependency_and_scale(spark, sf_dir):
    return C.scored(scan(spark, sf_dir)).select("project_id", "dependency", "scale")


@query(f"select project_id, health, {LEVEL} as level, cast(least(greatest(round_even(health / 20, 0), 1), 5) as bigint) as stars from {HEALTH}")
def c5_health(spark, sf_dir):
    return C.scored(scan(spark, sf_dir)).select("project_id", "health", "level", C.stars(F.col("health")).alias("stars"))


RISKS = f"""(select project_id, 0 p, 'vulnerabilities' title, 'HIGH' level from {SCAN} where vulnerabilities > 0 union all select project_id, 1, 'bugs', 'MEDIUM' from {SCAN} where bugs > 0 union all select project_id, 2, 'code smells', 'LOW' from {SCAN} where code_smells > 0
  union all select project_id, 3, 'big files', 'HIGH' from {SCAN} where skipped_big > 0 union all select project_id, 4, 'large code base', 'MEDIUM' from {SCAN} where loc_total > 200000
  union all select project_id, 5, 'unknown frameworks', 'LOW' from {SCAN} where n_frameworks = 0 union all select project_id, 6, 'truncated scan', 'MEDIUM' from {SCAN} where truncated)"""


@query(f"select project_id, cast(row_number() over (partition by project_id order by p) - 1 as int) as pos, title, level from {RISKS}")
def c6_risks(spark, sf_dir):
    return scan(spark, sf_dir).select("project_id", F.posexplode(C.risks()).alias("pos", "r")).select("project_id", "pos", "r.title", "r.level")


@query(
    f"""select project_id, concat_ws('|', case when bugs > 0 or vulnerabilities > 0 then 'now' end, case when skipped_big > 0 or code_smells > 50 then 'next' end, case when loc_total > 50000 then 'later' end) as phases from {SCAN}"""
)
def c7_phases(spark, sf_dir):
    return scan(spark, sf_dir).select("project_id", F.array_join(F.transform(C.phases(), lambda p: p["phase"]), "|").alias("phases"))


CANDIDATE = '{"healthScore": %d, "dimensions": [{"key": "quality", "score": 1}, {"key": "structure", "score": 2}, {"key": "dependency", "score": 3}, {"key": "%s", "score": 4}], "risks": [{"title": "t", "level": "LOW"}]}'


@query(
    """with e as (select event_id id, cast(json_extract_string(props, '$.k') as bigint) k, event_id % 3 <> 0 ok, event_id % 90 base from events)
    select id, cast(case when ok then least(greatest(least(greatest(k, base - 10), base + 10), 0), 100) else base end as bigint) as health_score, case when ok then 'CANDIDATE' else 'RULES' end as source from e"""
)
def c8_validated(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    json = F.format_string(CANDIDATE, F.get_json_object("props", "$.k").cast("long"), F.when(F.col("event_id") % 3 == 0, "odd").otherwise("scale"))
    rows = e.select(F.col("event_id").alias("id"), json.alias("report_json"), (F.col("event_id") % 90).alias("base_health"))
    return C.validated(rows).select("id", "health_score", "source")


#: How candidates come: alone, fenced, between prose, before prose with braces, with braces in strings, cut off, twice.
WRAPPED = ("%s", "```json\n%s\n```", "Here it is:\n\n%s\nDone.", "%s and {so} on", '{"note": "} {", "x": 1} then %s', "{ %s", "%s%s", "no { braces")
#: Which of these are read: an object that is no report counts as one that could be read, but not as a good one.
READ = (0, 1, 2, 3, 6)


@query(
    f"""with e as (select event_id id, cast(json_extract_string(props, '$.k') as bigint) k, event_id % {len(WRAPPED)} in ({", ".join(map(str, READ))}) ok, event_id % 90 base from events)
    select id, cast(case when ok then least(greatest(least(greatest(k, base - 10), base + 10), 0), 100) else base end as bigint) as health_score, case when ok then 'CANDIDATE' else 'RULES' end as source from e"""
)
def c8_wrapped_reports(spark, sf_dir):
    """Reports inside prose, code fences and other braces."""
    e = table(spark, sf_dir, "events")
    json = F.format_string(CANDIDATE, F.get_json_object("props", "$.k").cast("long"), F.lit("scale"))
    text = F.lit(None).cast("string")
    for k, shape in enumerate(WRAPPED):
        parts = [x for part in shape.split("%s") for x in (F.lit(part), json)][:-1]
        text = F.when(F.col("event_id") % len(WRAPPED) == k, F.concat(*parts)).otherwise(text)
    rows = e.select(F.col("event_id").alias("id"), text.alias("report_json"), (F.col("event_id") % 90).alias("base_health"))
    return C.validated(rows).select("id", "health_score", "source")


@query("select event_id as analysis_id, unnest(['dimension', 'dimension', 'dimension', 'dimension', 'risk']) as part, unnest(['quality', 'structure', 'dependency', case when event_id % 3 = 0 then 'odd' else 'scale' end, 't']) as name, unnest(['1.0', '2.0', '3.0', '4.0', 'LOW']) as value from events where event_id % 5 <> 0 union all select event_id, 'dimension', null, null from events where event_id % 5 = 0")
def c9_report_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    json = F.format_string(CANDIDATE, F.lit(5), F.when(F.col("event_id") % 3 == 0, "odd").otherwise("scale"))
    return C.report_rows(e.select(F.col("event_id").alias("analysis_id"), F.when(F.col("event_id") % 5 == 0, "not json").otherwise(json).alias("report_json")))


@query(
    f"""with s as (select source project_id, count(*) file_count, sum(n_chars) loc_total, count(*) filter (n_chars > 5000) skipped_big from documents group by 1)
    select project_id, cast(round_even(cast(greatest(75 - 5 * least(skipped_big, 3), 40) as bigint) * cast(0.4 as double) + 75 * cast(0.3 as double) + 70 * cast(0.15 as double) + {SCALE} * cast(0.15 as double), 0) as bigint) as health from s"""
)
def c11_rebuilt_scan(spark, sf_dir):
    """Scores from a stored file snapshot: flags reset, no metrics."""
    own = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("project_id")).agg(F.count("*").alias("file_count"), F.sum("n_chars").alias("loc_total"), F.count_if(F.col("n_chars") > 5000).alias("skipped_big"))
    none = {c: F.lit(None).cast("double") for c in ("bugs", "vulnerabilities", "code_smells", "duplication_rate", "coverage_rate", "complexity")}
    flags = {c: F.lit(False) for c in ("truncated", "has_backend", "has_frontend", "has_top_dir")}
    return C.scored(own.withColumns(none | flags).withColumn("frameworks", F.array().cast("array<string>"))).select("project_id", "health")


def priorities(spark, sf_dir, odd: int) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 2 == odd).select(F.col("o_custkey").alias("project_id"), F.col("o_orderpriority").alias("title"))


@query(
    """with a as (select distinct o_custkey p, o_orderpriority t from orders where o_orderkey % 2 = 0), b as (select distinct o_custkey p, o_orderpriority t from orders where o_orderkey % 2 = 1)
    select coalesce(a.p, b.p) as project_id, coalesce(a.t, b.t) as title, case when a.p is not null and b.p is not null then 'kept' when a.p is not null then 'removed' else 'added' end as change from a full join b on a.p = b.p and a.t = b.t"""
)
def e1_risk_diff(spark, sf_dir):
    return C.risk_diff(priorities(spark, sf_dir, 0), priorities(spark, sf_dir, 1))


@query(
    """with d as (select o_custkey p, o_orderpriority t, o_orderkey % 2 k, max(o_orderkey) s from orders group by 1, 2, 3)
    select n.p as project_id, n.t as dimension, n.s as score, b.s as base_score from d n left join d b on n.p = b.p and n.t = b.t and b.k = 0 where n.k = 1"""
)
def e2_dimension_compare(spark, sf_dir):
    side = lambda k: table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_custkey").alias("project_id"), F.col("o_orderpriority").alias("dimension")).agg(F.max("o_orderkey").alias("score"))
    return C.dimension_compare(side(0), side(1))


# --- debt ------------------------------------------------------------------------------------------------------------


def violation_debt(spark, sf_dir):
    return D.architecture_debt(graph.violations(spark, sf_dir).withColumn("reason", F.concat_ws(" ", "project_id", "source", "target")).withColumn("project_id", F.lit("p")))


D1 = f"(select 'ARCH' as source, severity as level, concat(project_id, ' ', source, ' ', target) as title, null as suggestion from {graph.VIOLATIONS})"
D2 = "(select 'QUALITY' as source, case event_id % 4 when 0 then 'HIGH' else 'MEDIUM' end as level, event_type as title, null as suggestion from events where event_id % 4 < 2)"
D3 = f"(select 'EVOLUTION' as source, 'HIGH' as level, path as title, concat(commits, '；', added) as suggestion from {history.TOP} where added >= 1200)"
D4 = f"(select 'DEPEND' as source, risk_level as level, name as title, case when latest is not null then concat('upgrade to ', latest) end as suggestion from {history.DEPENDENCIES} where risk_level in ('HIGH', 'MEDIUM'))"


@query(f"select * from {D1}")
def d1_architecture_debt(spark, sf_dir):
    return violation_debt(spark, sf_dir).drop("project_id")


def issue_debt(spark, sf_dir):
    level = F.when(F.col("event_id") % 4 == 0, "BLOCKER").when(F.col("event_id") % 4 == 1, "CRITICAL").otherwise("MAJOR")
    return D.quality_debt(table(spark, sf_dir, "events").select(F.lit("p").alias("project_id"), level.alias("severity"), F.col("event_type").alias("message")))


@query(f"select * from {D2}")
def d2_quality_debt(spark, sf_dir):
    return issue_debt(spark, sf_dir).drop("project_id")


def hotspot_debt(spark, sf_dir):
    from codehealth.operators import history as H

    best = H.top_files(history.files(spark, sf_dir)).select(F.lit("p").alias("project_id"), F.col("path").alias("module"), F.when(F.col("added") >= 1200, "HIGH").otherwise("LOW").alias("risk_level"), F.array(F.col("commits").cast("string"), F.col("added").cast("string")).alias("evidence"))
    return D.evolution_debt(best)


@query(f"select * from {D3}")
def d3_evolution_debt(spark, sf_dir):
    return hotspot_debt(spark, sf_dir).drop("project_id")


def part_debt(spark, sf_dir):
    return D.dependency_debt(history.dependencies(spark, sf_dir).withColumn("project_id", F.lit("p")).withColumn("suggestion", F.lit(None).cast("string")))


@query(f"select * from {D4}")
def d4_dependency_debt(spark, sf_dir):
    return part_debt(spark, sf_dir).drop("project_id")


@query(
    f"""select project_id, source, level, count(*) as n from (select 'p' as project_id, * from (select * from {D1} union all select * from {D2} union all select * from {D3} union all select * from {D4} union all select 'MANUAL', 'LOW', s_name, null from supplier where s_suppkey % 2 = 0)
    union all select 'q', case when s_suppkey % 2 = 0 then 'MANUAL' else 'ARCH' end, 'LOW', s_name, null from supplier union all select 'r', 'MANUAL', 'LOW', s_name, null from supplier where s_suppkey % 2 = 0) group by all"""
)
def e3_debt_rebuild(spark, sf_dir):
    """Project p is rebuilt, r too but without findings, q is left alone."""
    s = table(spark, sf_dir, "supplier")
    old = s.select(F.explode(F.array(*map(F.lit, "pqr"))).alias("project_id"), F.when(F.col("s_suppkey") % 2 == 0, "MANUAL").otherwise("ARCH").alias("source"), F.lit("LOW").alias("level"), F.col("s_name").alias("title"), F.lit(None).cast("string").alias("suggestion"))
    projects = spark.createDataFrame([("p",), ("r",)], "project_id string")
    now = D.rebuilt(old, projects, violation_debt(spark, sf_dir), issue_debt(spark, sf_dir), hotspot_debt(spark, sf_dir), part_debt(spark, sf_dir))
    return now.groupBy("project_id", "source", "level").agg(F.count("*").alias("n"))


@query(
    """with recursive e as (select user_id u, row_number() over (partition by user_id order by event_id) k, event_id, case event_id % 3 when 0 then 'DOING' when 1 then 'DONE' else 'WONTFIX' end t, event_id % 2 = 0 said from events),
    f as (select u, k, event_id, t, 'OPEN' as before, case when t = 'DONE' and not said then 'missing note' when t = 'WONTFIX' and not said then 'missing reason' end why from e where k = 1
      union all select e.u, e.k, e.event_id, e.t, case when f.why is null then f.t else f.before end,
        case when not ((case when f.why is null then f.t else f.before end) = 'OPEN' or ((case when f.why is null then f.t else f.before end) = 'DOING' and e.t = 'DONE')) then 'illegal change'
          when e.t = 'DONE' and not e.said then 'missing note' when e.t = 'WONTFIX' and not e.said then 'missing reason' end from f join e on e.u = f.u and e.k = f.k + 1)
    select u as debt_id, event_id as seq, t as target, before, why, why is null as accepted from f"""
)
def l5_status_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_id") % 2 == 0, "said")
    target = F.when(F.col("event_id") % 3 == 0, "DOING").when(F.col("event_id") % 3 == 1, "DONE").otherwise("WONTFIX")
    return D.status_changes(e.select(F.col("user_id").alias("debt_id"), F.col("event_id").alias("seq"), target.alias("target"), said.alias("note"), said.alias("reason")))


@query("select p_partkey as id, case when p_size % 4 = 0 then 'HIGH' else 'MEDIUM' end as level, case when p_size % 5 = 0 then 'title missing' when p_size % 3 = 0 then 'unknown source' end as reason from part")
def l6_intake(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 == 0, "  ").otherwise(F.col("p_name")).alias("title"), F.when(F.col("p_size") % 3 == 0, "BOT").otherwise("MANUAL").alias("source"), F.when(F.col("p_size") % 4 == 0, "high").otherwise("?").alias("level"))
    return D.intake(rows).select("id", "level", "reason")


# --- lifecycle -------------------------------------------------------------------------------------------------------


@query(
    """select 'project' as t, count(*) as n from customer where c_custkey % 10 <> 3 union all select 'analysis', count(*) from orders where o_custkey % 10 <> 3
    union all select 'analysis_report', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey % 10 = 3)
    union all select 'chat_session', count(distinct conv_id) from conversations where conv_id % 10 <> 3 union all select 'chat_message', count(*) from conversations where conv_id % 10 <> 3
    union all select 'tech_debt', count(*) from events where user_id % 10 <> 3 union all select 'file_node', count(*) from documents where doc_id % 10 <> 3 union all select 'other', count(*) from part
    union all select 'cancelled', count(*) from orders where o_custkey % 10 = 3 and o_orderstatus = 'P'"""
)
def l1_purge(spark, sf_dir):
    """Each tenth project goes, from all tables; reports go by their analyses and messages by their sessions."""
    t = lambda name: table(spark, sf_dir, name)
    key = lambda name, column: t(name).withColumn("project_id", F.col(column))
    chats = t("conversations").withColumn("session_id", F.col("conv_id"))
    tables = {
        "project": key("customer", "c_custkey"), "analysis": key("orders", "o_custkey").select("project_id", F.col("o_orderkey").alias("analysis_id"), F.when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("SUCCEEDED").alias("status")),
        "analysis_report": t("lineitem").withColumn("analysis_id", F.col("l_orderkey")), "chat_session": chats.select("session_id", F.col("conv_id").alias("project_id")).distinct(), "chat_message": chats,
        "tech_debt": key("events", "user_id"), "file_node": key("documents", "doc_id"), "other": t("part"),
    }
    ids = lambda name: tables[name].select(F.col("project_id").cast("long"))
    gone = ids("project").unionByName(ids("chat_session")).unionByName(ids("tech_debt")).unionByName(ids("file_node")).filter("project_id % 10 = 3")
    left, stopped = D.purge(tables, gone)
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
    out = n(stopped.filter("status = 'CANCELLED'"), "cancelled")
    for name, rows in left.items():
        out = out.unionByName(n(rows, name))
    return out


@query(f"select status, error_code, count(*) as n from (select case when status = 'RUNNING' then 'FAILED' else status end status, case when status = 'RUNNING' then 5003 end error_code from {RUNS}) group by 1, 2 union all select 'READY', null, count(distinct project_id) from {RUNS} where status = 'RUNNING'")
def l2_recovered(spark, sf_dir):
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.lit("ANALYZING").alias("status"))
    fixed, own = D.recovered(runs(spark, sf_dir), projects)
    ready = own.filter("status = 'READY'").groupBy("status").agg(F.count("*").alias("n")).select("status", F.lit(None).cast("int").alias("error_code"), "n")
    return fixed.groupBy("status", "error_code").agg(F.count("*").alias("n")).unionByName(ready)


@query(f"select project_id, count(*) as active from {RUNS} where status = 'RUNNING' group by 1 having count(*) > 1")
def l3_several_active(spark, sf_dir):
    return D.several_active(runs(spark, sf_dir))


@query(
    """select 'unique:l_orderkey,l_linenumber' as rule, cast(count(*) - count(distinct (l_orderkey, l_linenumber)) as bigint) as n from lineitem union all select 'null:l_partkey', count(*) filter (l_partkey is null) from lineitem
    union all select 'enum:l_returnflag', count(*) filter (l_returnflag not in ('A', 'N')) from lineitem union all select 'orphan:l_orderkey', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')"""
)
def l4_audit(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return D.audit(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey"], {"l_returnflag": ["A", "N"]}, {"l_orderkey": (orders, "o_orderkey")})


@query(
    """with c as (select o_custkey project_id, o_orderkey seq, case when o_orderstatus = 'P' then 'EDIT' else 'GENERATE' end as action, o_orderkey % 4 = 0 forced from orders),
    d as (select *, coalesce(max(case when action = 'EDIT' then 1 else 0 end) over (partition by project_id order by seq rows between unbounded preceding and 1 preceding), 0) = 1 edited from c)
    select project_id, seq, row_number() over (partition by project_id order by seq) as version from d where action = 'EDIT' or not edited or forced"""
)
def l7_doc_versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    changes = o.select(F.col("o_custkey").alias("project_id"), F.lit("d").alias("doc_type"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "P", "EDIT").otherwise("GENERATE").alias("action"), (F.col("o_orderkey") % 4 == 0).alias("forced"))
    return O.versions(changes).select("project_id", "seq", "version")


# --- retrieval -------------------------------------------------------------------------------------------------------

TOKENS = "(select doc_id, t, cast(coalesce(sum((length(t) + 3) // 4) over (partition by doc_id order by p rows between unbounded preceding and 1 preceding), 0) as int) pos, cast(sum((length(t) + 3) // 4) over (partition by doc_id) as int) total, p from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]+')) t, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]+'), 1) p from documents))"


@query(
    f"""select doc_id, cast(w as int) as chunk_index, cast(count(*) as int) as n_tokens, md5(string_agg(t, ' ' order by p)) as digest from (
      select *, 0 as w from {TOKENS} where total <= 800 union all
      select x.*, g.w from {TOKENS} x, (select unnest(generate_series(0, 4000)) w) g where total > 800 and g.w * 350 <= greatest(total - 51, 0) and x.pos >= g.w * 350 and x.pos < g.w * 350 + 400 and g.w between (x.pos - 399) // 350 - 1 and x.pos // 350 + 1) group by 1, 2"""
)
def k1_token_windows(spark, sf_dir):
    return K.token_windows(spread(table(spark, sf_dir, "documents")), "doc_id").select("doc_id", "chunk_index", "n_tokens", F.md5("content").alias("digest"))


def vector_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings")
    queries = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.lit("p").alias("project_id"), F.col("embedding").alias("q"))
    return queries, v.select(F.lit("p").alias("project_id"), F.col("vec_id").alias("id"), "embedding")


def vector_hits(spark, sf_dir, k=5) -> DataFrame:
    return K.nearest(*vector_tables(spark, sf_dir), k)


VECTOR = "(select query_id, id, score from (select q.vec_id query_id, v.vec_id id, list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])) score, row_number() over (partition by q.vec_id order by list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])) desc, v.vec_id) r from embeddings q, embeddings v where q.vec_id % 50 = 0) where r <= 5)"


@query(f"select query_id, id, round(score, 4) as score from {VECTOR}")
def k2_nearest_vectors(spark, sf_dir):
    return vector_hits(spark, sf_dir).select("query_id", "id", F.round("score", 4).alias("score"))


@query("select count(*) * 5 as exact, true as enough from embeddings where vec_id % 50 = 0")
def k2_bucket_recall(spark, sf_dir):
    """Nearest vectors by buckets of random projections, held against the exact ones: recall of 0.9 at least."""
    queries, vectors = vector_tables(spark, sf_dir)
    found = N.recall(N.nearest_by_buckets(queries, vectors, 5), K.nearest(queries, vectors, 5))
    return found.select("exact", (F.col("recall") >= 0.9).alias("enough"))


STOP = ", ".join(f"'{x}'" for x in K.STOP_WORDS)
KEYWORDS = f"(select conv_id, turn, (select string_agg(w, ' ' order by f) from (select w, min(p) f from (select unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) w, generate_subscripts(regexp_extract_all(lower(text), '[a-z]{{3,}}'), 1) p) where w not in ({STOP}) group by w order by f limit 8)) words from conversations where role = 'user')"


@query(f"select conv_id, turn, coalesce(words, '') as words from {KEYWORDS}")
def k3_keywords(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", F.array_join(K.keywords(F.col("text")), " ").alias("words"))


def turn_queries(spark, sf_dir) -> DataFrame:
    """Each turn of a user as a query, known by its conversation and turn."""
    c = spread(table(spark, sf_dir, "conversations").filter("role = 'user'"))
    return c.select(F.struct("conv_id", "turn").alias("query_id"), F.lit("p").alias("project_id"), K.keywords(F.col("text")).alias("keywords"))


def word_queries(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role = 'user' and conv_id % 50 = 0")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.lit("p").alias("project_id"), K.keywords(F.col("text")).alias("keywords"))


def chunks(spark, sf_dir) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))
    return d.select(F.lit("p").alias("project_id"), F.col("source").alias("file"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("content"))


def hits_sql(which: str) -> str:
    return f"""(select query_id, file, chunk_index, 0.5 score from (select c.conv_id * 100 + c.turn query_id, d.source file, d.doc_id chunk_index, row_number() over (partition by c.conv_id, c.turn order by d.doc_id, d.source) r
  from {KEYWORDS} c, documents d where {which}len(list_filter(string_split(c.words, ' '), lambda w: contains(lower(d.text), w) or contains(lower(d.source), w))) > 0) where r <= 8)"""


HITS = hits_sql("c.conv_id % 50 = 0 and ")


@query(f"select query_id, file, chunk_index, cast(score as double) as score from {hits_sql('')}")
def k4_keyword_hits(spark, sf_dir):
    """The first chunks for each turn of a user."""
    hits = K.keyword_hits(turn_queries(spark, sf_dir), chunks(spark, sf_dir))
    return hits.select((F.col("query_id.conv_id") * 100 + F.col("query_id.turn")).alias("query_id"), "file", "chunk_index", "score")


def both_hits(spark, sf_dir, k=6) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file"))
    near = vector_hits(spark, sf_dir).join(d, "id").select(F.col("query_id"), "file", F.col("id").alias("chunk_index"), "score")
    words = K.keyword_hits(word_queries(spark, sf_dir), chunks(spark, sf_dir)).withColumn("query_id", F.floor(F.col("query_id") / 20).cast("long"))
    return K.merged(near, words, k)


def merged_sql(k: int) -> str:
    return f"""(with m as (select v.query_id, d.source file, v.id chunk_index, v.score from {VECTOR} v join documents d on d.doc_id = v.id union all select query_id // 20, file, chunk_index, score from {HITS}),
    g as (select query_id, file, chunk_index, round(max(score), 4) score from m group by 1, 2, 3)
    select query_id, file, chunk_index, score from (select *, row_number() over (partition by query_id order by score desc, file, chunk_index) r from g) where r <= {k})"""


@query(f"select * from {merged_sql(6)}")
def e4_hybrid_hits(spark, sf_dir):
    return both_hits(spark, sf_dir)


@query(f"select * from {merged_sql(8)}")
def k5_final_hits(spark, sf_dir):
    return both_hits(spark, sf_dir, 8)


@query(
    f"""select h.query_id, string_agg('[' || h.file || ':' || h.chunk_index || ']' || chr(10) || left(d.text, 600), chr(10) || chr(10) order by h.score desc, h.chunk_index) as context
    from {merged_sql(6)} h join documents d on d.doc_id = h.chunk_index and d.source = h.file group by 1"""
)
def k6_context(spark, sf_dir):
    c = chunks(spark, sf_dir).select("file", "chunk_index", "content")
    hits = both_hits(spark, sf_dir).join(c, ["file", "chunk_index"])
    return K.context(hits.select("query_id", F.struct((-F.col("score")).alias("s"), "chunk_index").alias("rank"), "file", F.col("chunk_index").alias("start_line"), F.lit(None).cast("string").alias("symbol"), "content"))


@query(
    """with a as (select event_id id, event_id % 7 f, event_id // 7 % 50 l from events)
    select id as answer_id, concat('src/f', f, '.py') as file, cast(l as int) as line from a where l between 10 and 40"""
)
def j7_citations(spark, sf_dir):
    """Each event answers with a reference by whole path or by base name; hits span lines 10 to 40."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("answer_id"), (F.col("event_id") % 7).alias("f"), (F.floor(F.col("event_id") / 7) % 50).alias("l"))
    whole = F.when(F.col("answer_id") % 2 == 0, F.lit("src/")).otherwise(F.lit(""))
    answers = e.select("answer_id", F.concat(F.lit("see ["), whole, F.lit("f"), "f", F.lit(".py:"), "l", F.lit("], or [none.py:3]")).alias("text"))
    hits = e.select("answer_id", F.concat(F.lit("src/f"), "f", F.lit(".py")).alias("file"), F.lit(10).alias("start_line"), F.lit(40).alias("end_line"))
    return K.citations(answers, hits)


# --- flagship --------------------------------------------------------------------------------------------------------


def project_health(spark, sf_dir) -> DataFrame:
    """Health of each project (source) from its documents: size, findings, scores. Each text is exploded once; findings of a
    file are summed up where its lines are, then by file, then by project."""
    lines = source_code.doc_lines(spark, sf_dir)
    text, keys = F.col("text"), file_keys(lines)
    each = lines.select(*keys, "line", F.size(R.line_hits(text)).alias("hits"), R.numbers_of(text).alias("numbers"), (F.trim(text) != "").alias("full"))
    numbers = F.array_sort(F.collect_list(F.when(F.size("numbers") > 0, F.struct("line", "numbers"))))
    file = each.groupBy(*keys).agg(F.sum("hits").alias("hits"), F.count_if("full").alias("loc"), numbers.alias("numbers"))
    smells = F.sum(F.size(R.first_numbers(F.col("numbers"))))
    own = file.groupBy("project_id").agg(F.count("*").alias("file_count"), F.sum("loc").alias("loc_total"), F.sum("hits").alias("vulnerabilities"), smells.alias("code_smells"))
    none = {c: F.lit(None).cast("double") for c in ("duplication_rate", "coverage_rate", "complexity")}
    flags = {c: F.lit(False) for c in ("truncated", "has_backend", "has_frontend", "has_top_dir")}
    full = own.withColumns(none | flags).withColumn("bugs", F.lit(0)).withColumn("skipped_big", F.lit(0)).withColumn("frameworks", F.array().cast("array<string>"))
    return C.scored(full).select("project_id", "file_count", "loc_total", "vulnerabilities", "code_smells", "quality", "health", "level")


HITS_OF = f"""(case when {source_code.SECURE} then 1 else (case when {source_code.CALL} is not null then 1 else 0 end)
  + (case when regexp_matches(text, {source_code.q(R.SQL_WORD)}) and regexp_matches(text, {source_code.q(R.SQL_JOIN)}) then 1 else 0 end) + (case when regexp_matches(text, {source_code.q(R.PASSWORD_COMPARE)}) then 1 else 0 end) end)"""
OWN = f"""(select project_id, count(distinct (analysis_id, path)) file_count, count(*) filter (trim(text) <> '') loc_total, cast(sum({HITS_OF}) as bigint) vulnerabilities, coalesce(max(smells), 0) code_smells, 0 bugs,
  null::double duplication_rate, null::double coverage_rate, null::double complexity, false has_backend, false has_frontend, false has_top_dir, 0 n_frameworks
  from {source_code.LINES} left join (select project_id, count(*) smells from {source_code.magic_sql(source_code.LINES)} group by 1) using (project_id) group by 1)"""


@query(f"select project_id, file_count, loc_total, vulnerabilities, code_smells, quality, health, {LEVEL} as level from {HEALTH.replace(SCAN, OWN)}")
def flagship_project_health(spark, sf_dir):
    return project_health(spark, sf_dir)
