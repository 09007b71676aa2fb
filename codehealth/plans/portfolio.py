"""Portfolio and chat queries: customers as projects, orders as runs, conversations as chats, events as issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.operators import portfolio as P
from codehealth.plans.graph import work_folder
from codehealth.plans.registry import query, table
from codehealth.sources import catalog

STATUS = "case o_orderstatus when 'F' then 'SUCCEEDED' when 'O' then 'RUNNING' else 'FAILED' end"
RUNS = f"(select o_custkey project_id, o_orderkey id, {STATUS} status, cast(cast(o_totalprice as bigint) % 101 as bigint) score, strftime(o_orderdate, '%Y-%m-%d') created from orders)"


def runs(spark, sf_dir) -> DataFrame:
    status = STATUS.replace("\n", " ")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("id"), F.expr(status).alias("status"), F.expr("cast(floor(o_totalprice) as bigint) % 101").alias("score"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created")
    )


RUNS = RUNS.replace("cast(o_totalprice as bigint)", "cast(floor(o_totalprice) as bigint)")
PROJECTS = """(select c_custkey project_id, c_name as name, case c_nationkey % 3 when 0 then 'READY' when 1 then 'FAILED' else 'CREATED' end status, case when c_custkey % 10 = 0 then 1 else 0 end deleted,
  case when c_custkey % 7 <> 0 then cast(floor(c_acctbal) as bigint) end loc_total, concat('2024-', lpad(cast(c_custkey % 12 + 1 as varchar), 2, '0'), '-01') created_at,
  case when c_custkey % 5 <> 0 then concat('2024-', lpad(cast(c_custkey % 11 + 1 as varchar), 2, '0'), '-15') end last_analyzed_at, c_mktsegment segment, c_acctbal from customer)"""


def projects(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    month = lambda n: F.lpad((F.col("c_custkey") % n + 1).cast("string"), 2, "0")
    return c.select(
        F.col("c_custkey").alias("project_id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_nationkey") % 3 == 0, "READY").when(F.col("c_nationkey") % 3 == 1, "FAILED").otherwise("CREATED").alias("status"),
        F.when(F.col("c_custkey") % 10 == 0, 1).otherwise(0).alias("deleted"),
        F.when(F.col("c_custkey") % 7 != 0, F.floor("c_acctbal").cast("long")).alias("loc_total"),
        F.concat(F.lit("2024-"), month(12), F.lit("-01")).alias("created_at"),
        F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("2024-"), month(11), F.lit("-15"))).alias("last_analyzed_at"),
        F.create_map(F.col("c_mktsegment"), F.lit(60.0), F.lit("OTHER"), F.lit(40.0)).alias("lang_stats"),
        F.array(F.col("c_mktsegment"), F.lit("x")).alias("framework_tags"),
        F.col("c_acctbal"),
    )


SCORED = f"(select p.*, r.health_score from {PROJECTS} p left join (select project_id, arg_max(score, id) health_score from {RUNS} where status = 'SUCCEEDED' group by 1) r using (project_id))"


def scored(spark, sf_dir) -> DataFrame:
    return P.with_latest_score(projects(spark, sf_dir), runs(spark, sf_dir))


@query(f"select project_id, health_score from {SCORED}")
def j1_latest_score(spark, sf_dir):
    return scored(spark, sf_dir).select("project_id", "health_score")


LAST = f"(select project_id, max(id) analysis_id from {RUNS} where status = 'SUCCEEDED' group by 1)"


@query(f"select l_orderkey as analysis_id, l_linenumber as line, o_custkey as project_id from lineitem join orders on l_orderkey = o_orderkey where (o_custkey, l_orderkey) in (select (project_id, analysis_id) from {LAST})")
def j2_latest_snapshot(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").alias("project_id"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("analysis_id"), F.col("l_linenumber").alias("line")).join(own, "analysis_id")
    return P.latest_snapshot(rows, runs(spark, sf_dir))


@query(f"select r.project_id, r.id, r.score, p.name from {RUNS} r join {PROJECTS} p using (project_id) qualify row_number() over (partition by r.project_id order by r.id desc) = 1")
def j3_latest_report(spark, sf_dir):
    last = P.latest_rows(runs(spark, sf_dir), "project_id", "id")
    return last.join(projects(spark, sf_dir), "project_id").select("project_id", "id", "score", "name")


@query(f"select project_id, name from {PROJECTS} where deleted = 0 and contains(name, '7') and segment = 'BUILDING' and status = 'READY'")
def f7_project_filter(spark, sf_dir):
    return P.project_filter(projects(spark, sf_dir), "7", "BUILDING", "READY").select("project_id", "name")


@query(f"select status, count(*) as n from {PROJECTS} where deleted = 0 group by 1")
def f9_soft_delete(spark, sf_dir):
    return P.distribution(P.visible(projects(spark, sf_dir)), F.col("status"), "status")


@query(
    """select 'orphan:project_id' as rule, count(*) filter (o_custkey % 7 = 0) as n from orders where o_orderkey % 4 <> 0 union all select 'null:id', 0 union all select 'null:project_id', 0 union all select 'null:status', 0
    union all select 'enum:status', 0 union all select 'enum:stage', 0 union all select 'unique:id', 0 union all select 'rows', count(*) from orders where o_orderkey % 4 <> 0"""
)
def f9_typed_tables(spark, sf_dir):
    """Orders as runs and customers as projects in typed tables: deleted rows are seen by no read and no check."""
    root = f"{work_folder(spark)}/tables"
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("READY").alias("status"), F.when(F.col("c_custkey") % 7 == 0, 1).otherwise(0).alias("deleted"))
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("SUCCEEDED")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), status.alias("status"), F.lit("SCAN").alias("stage"), F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0).alias("deleted"))
    catalog.write(c, root, "project")
    catalog.write(o, root, "analysis")
    return catalog.broken_rules(spark, root, "analysis").unionByName(catalog.read(spark, root, "analysis").agg(F.count("*").alias("n")).select(F.lit("rows").alias("rule"), "n"))


@query("select doc_id, source from documents where lang = 'en' and contains(source, '1')")
def f8_file_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.filter((F.col("lang") == "en") & F.col("source").contains("1")).select("doc_id", "source")


@query(f"select project_id, health_score from {SCORED} order by health_score desc nulls last, project_id limit 25 offset 25")
def o1_project_page(spark, sf_dir):
    return P.page(scored(spark, sf_dir), P.project_order("healthScore", True), 2, 25).select("project_id", "health_score")


@query("select doc_id, n_chars from documents order by n_chars desc, doc_id limit 100 offset 100")
def o2_file_page(spark, sf_dir):
    return P.page(table(spark, sf_dir, "documents"), [F.desc("n_chars"), F.asc("doc_id")], 2, 500).select("doc_id", "n_chars")


@query(f"select id, created from {RUNS} where status = 'RUNNING' order by created desc, id desc limit 50")
def o3_debt_page(spark, sf_dir):
    return P.page(runs(spark, sf_dir).filter("status = 'RUNNING'"), [F.desc("created"), F.desc("id")], 1, 50).select("id", "created")


@query(f"select project_id, name from {PROJECTS} order by coalesce(last_analyzed_at, created_at, '') desc, project_id limit 8")
def o5_recent(spark, sf_dir):
    return P.recent(projects(spark, sf_dir)).select("project_id", "name")


@query(f"select project_id, id, score from (select *, row_number() over (partition by project_id order by id desc) r from {RUNS} where status = 'SUCCEEDED') where r <= 3 and id % 4 <> 0")
def o6_report_history(spark, sf_dir):
    r = runs(spark, sf_dir)
    return P.report_history(r.drop("score"), r.filter("id % 4 <> 0").select("id", "score"), 3).select("project_id", "id", "score")


@query("select conv_id, turn, role from conversations order by conv_id, turn limit 40 offset 40")
def o7_message_page(spark, sf_dir):
    return P.page(table(spark, sf_dir, "conversations"), [F.asc("conv_id"), F.asc("turn")], 2, 40).select("conv_id", "turn", "role")


@query(f"select coalesce(round(avg(health_score), 4), 0.0) as avg_score, count(*) filter (status = 'READY') as ready, count(*) filter (status = 'FAILED') as failed, cast(sum(coalesce(loc_total, 0)) as bigint) as loc from {SCORED}")
def a7_kpis(spark, sf_dir):
    return P.kpis(scored(spark, sf_dir))


@query(f"select case when health_score is null then 'none' when health_score >= 80 then 'high' when health_score >= 60 then 'mid' else 'low' end as bucket, count(*) as n from {SCORED} group by 1")
def a8_score_histogram(spark, sf_dir):
    return P.distribution(scored(spark, sf_dir), P.score_bucket(F.col("health_score")), "bucket")


@query(f"select project_id, case when health_score >= 80 then 'EXCELLENT' when health_score >= 60 then 'GOOD' when health_score >= 40 then 'FAIR' else 'POOR' end as level from {SCORED}")
def c10_display_level(spark, sf_dir):
    return scored(spark, sf_dir).select("project_id", P.display_level(F.col("health_score")).alias("level"))


@query(f"select language, round(sum(share), 1) as share from (select segment as language, 60.0 as share from {PROJECTS} union all select 'OTHER', 40.0 from {PROJECTS}) group by 1 order by 2 desc, 1 limit 8")
def a9_language_composition(spark, sf_dir):
    return P.language_composition(projects(spark, sf_dir))


@query(f"select status, count(*) as n from {RUNS} group by 1")
def a10_status_distribution(spark, sf_dir):
    return P.distribution(runs(spark, sf_dir), F.col("status"), "status")


@query(f"select project_id, segment as top_language, segment as framework, loc_total from {PROJECTS}")
def a14_chat_context(spark, sf_dir):
    return P.chat_context(projects(spark, sf_dir))


ISSUES = "(select user_id project_id, event_id id, upper(event_type) kind, case event_id % 3 when 0 then 'CRITICAL' when 1 then 'MAJOR' else 'MINOR' end severity from events)"


def issues(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_id") % 3 == 0, "CRITICAL").when(F.col("event_id") % 3 == 1, "MAJOR").otherwise("MINOR")
    return e.select(F.col("user_id").alias("project_id"), F.col("event_id").alias("id"), F.upper("event_type").alias("kind"), level.alias("severity"))


@query(f"select project_id, id from {ISSUES} where severity = 'CRITICAL' and kind = 'CLICK'")
def f6_issue_filter(spark, sf_dir):
    return P.issue_filter(issues(spark, sf_dir), severity=" critical", kind="click", status=" ").select("project_id", "id")


KINDS = f"(select project_id, id, severity, case kind when 'CLICK' then 'BUG' when 'VIEW' then 'VULNERABILITY' else kind end kind from {ISSUES})"


@query(
    f"""select project_id, count(*) filter (kind = 'BUG') as bugs, count(*) filter (kind = 'VULNERABILITY') as vulnerabilities, count(*) filter (kind not in ('BUG', 'VULNERABILITY')) as code_smells,
    count(*) filter (severity = 'CRITICAL' and kind = 'BUG') as total, count(*) filter (severity = 'CRITICAL' and kind = 'BUG') > 0 as available from {KINDS} group by 1"""
)
def a5_quality_metrics(spark, sf_dir):
    i = issues(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "CLICK", "BUG").when(F.col("kind") == "VIEW", "VULNERABILITY").otherwise(F.col("kind")))
    return P.quality_metrics(i, P.issue_filter(i, severity="CRITICAL", kind="BUG"))


def messages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), F.col("turn").alias("at"), F.upper("role").alias("role"), F.col("text").alias("content"))


@query("select s.session_id, coalesce(m.n, 0) as messages, m.last_at from (select distinct conv_id session_id from conversations) s left join (select conv_id, count(*) n, max(turn) last_at from conversations where role = 'user' group by 1) m on s.session_id = m.conv_id")
def a11_sessions(spark, sf_dir):
    m = messages(spark, sf_dir)
    return P.sessions(m.select("session_id").distinct(), m.filter("role = 'USER'"))


@query("select conv_id as session_id, turn as id from (select *, row_number() over (partition by conv_id order by turn desc) - 1 b from conversations) where b between 1 and 12")
def w4_chat_window(spark, sf_dir):
    return P.chat_window(messages(spark, sf_dir)).select("session_id", "id")


@query(
    """select session_id, id from (select user_id session_id, event_id id, event_type, ts, lag(event_type) over w b, lag(ts) over w bt from events window w as (partition by user_id order by ts, event_id))
    where event_type = b and ts <= bt + interval 6 hours"""
)
def w5_repeated_submits(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.lit("USER").alias("role"), F.col("event_type").alias("content"))
    return P.repeated_submits(e, "6 hours").select("session_id", "id")


@query("select conv_id as session_id, left(arg_min(text, turn), 20) as title from conversations where role = 'user' group by 1")
def w6_session_titles(spark, sf_dir):
    return P.session_titles(messages(spark, sf_dir))


@query(f"select project_id, id, score, score - lag(score) over (partition by project_id order by id) as delta from {RUNS} where status = 'SUCCEEDED'")
def w2_score_deltas(spark, sf_dir):
    return P.score_deltas(runs(spark, sf_dir)).select("project_id", "id", "score", "delta")


@query(f"select id, concat_ws(',', lag(id, 1) over w, lag(id, 2) over w, lag(id, 3) over w) as earlier from {RUNS} where status = 'SUCCEEDED' window w as (partition by project_id order by id)")
def w3_earlier_runs(spark, sf_dir):
    return P.earlier_runs(runs(spark, sf_dir)).select("id", F.array_join("earlier", ",").alias("earlier"))


@query(
    """with t as (select p_brand project_id, p_type section, p_name as text, 5 most from part union all select p_brand, 'EDGES', concat(p_name, ' -> ', p_type), 7 from part
      union all select p_brand, 'VIOLATIONS', concat(p_name, ' -> ', p_type), 3 from part where p_size > 45),
    r as (select *, row_number() over (partition by project_id, section order by text) k from t)
    select project_id, section, count(*) as n, string_agg(text, ', ' order by text) filter (k <= most) as body from r group by 1, 2"""
)
def a12_architecture_doc(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("project_id", F.col("p_brand"))
    nodes = p.select("project_id", F.col("p_type").alias("node_type"), F.col("p_name").alias("name"))
    edges = p.select("project_id", F.col("p_name").alias("source"), F.col("p_type").alias("target"), "p_size")
    return P.architecture_doc(nodes, edges.drop("p_size"), edges.filter("p_size > 45").drop("p_size"), 5, 7, 3)


@query(
    """with f as (select o_custkey p, 'f' || o_orderkey path, row_number() over (partition by o_custkey order by 'f' || o_orderkey) r from orders),
    l as (select p, string_agg(path, chr(10) order by path) files from f where r <= 30 group by 1)
    select c_custkey as project_id, concat_ws(chr(10), c_mktsegment || ' 60.0%, OTHER 40.0%', c_mktsegment || ', x',
    coalesce(cast(case when c_custkey % 7 <> 0 then cast(floor(c_acctbal) as bigint) end as varchar), 'null') || ' lines', files) as doc from customer left join l on p = c_custkey"""
)
def a13_profile_doc(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.concat(F.lit("f"), "o_orderkey").alias("path"))
    return P.profile_doc(projects(spark, sf_dir), files)
