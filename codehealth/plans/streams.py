"""Streaming queries: tables are dealt into files, streamed, drained and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.operators import line_rules as R
from codehealth.plans import source_code
from codehealth.plans.graph import work_folder
from codehealth.plans.registry import query, table
from codehealth.streaming import jobs as J


def streamed(rows: DataFrame, order: str, parts: int = 3) -> tuple[DataFrame, str]:
    """rows as a stream of slices that arrive in the order of a column, each as several files that are one batch, and a folder
    for what the job writes."""
    spark, folder = rows.sparkSession, work_folder(rows.sparkSession)
    files = spark.sparkContext.defaultParallelism
    spark.conf.set(*J.STATE_STORE)
    key = F.col(order).cast("long") if dict(rows.dtypes)[order] == "bigint" else F.unix_micros(F.col(order).cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)]).alias("c")).first()["c"] or []
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows if low is None else rows.filter(key > low)
        part = part if high is None else part.filter(key <= high)
        part.repartition(files, F.xxhash64(*part.columns)).write.mode("append").option("maxRecordsPerFile", 0).parquet(f"{folder}/in")
    return J.file_stream(spark, f"{folder}/in", files), folder


def event_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("select user_id as analysis_id, arg_max(event_type, event_id) as stage, arg_max(event_id % 100, event_id) as progress, max(event_id) as seq from events group by 1")
def t1_latest_progress(spark, sf_dir):
    e = event_rows(spark, sf_dir).select(F.col("user_id").alias("analysis_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), (F.col("event_id") % 100).alias("progress"))
    stream, folder = streamed(e, "seq")
    return J.latest_by_batch(J.run_to_table(J.latest_progress(stream), "update", folder), ["analysis_id"])


@query("select strftime(date_trunc('week', ts), '%Y-%m-%d') as week, count(*) as commits, cast(sum(event_id % 90) as bigint) as added from events group by 1")
def t2_weekly_stream(spark, sf_dir):
    e = event_rows(spark, sf_dir).select(F.col("ts").alias("committed_at"), (F.col("event_id") % 90).alias("added"))
    stream, folder = streamed(e, "committed_at")
    return J.latest_by_batch(J.run_to_table(J.weekly(stream, "30 days"), "update", folder), ["week"])


@query(
    """select session_id, id from (select user_id session_id, event_id id, event_type, ts, lag(event_type) over w b, lag(ts) over w bt from events window w as (partition by user_id order by ts, event_id))
    where event_type = b and ts <= bt + interval 6 hours"""
)
def t3_repeated_submits(spark, sf_dir):
    e = event_rows(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), F.col("event_type").alias("content"), F.col("ts").alias("at"))
    stream, folder = streamed(e, "at")
    return J.run_to_table(J.repeated_submits(stream, 6 * 3600), "append", folder).drop("batch_id")


FIRST_SQL = """with recursive m as (select user_id s, event_type c, event_id id, ts, row_number() over (partition by user_id, event_type order by ts, event_id) k from events),
    r as (select s, c, id, k, ts + interval 6 hours gone from m where k = 1
      union all select m.s, m.c, case when m.ts > r.gone then m.id end, m.k, case when m.ts > r.gone then m.ts + interval 6 hours else r.gone end from r join m on m.s = r.s and m.c = r.c and m.k = r.k + 1)
    select s as session_id, id from r where id is not null"""


@query(FIRST_SQL)
def t3_first_of_each(spark, sf_dir):
    """A fold over each session's messages of one content."""
    e = event_rows(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), F.col("event_type").alias("content"), F.col("ts").alias("at"))
    return J.first_within(e, 6 * 3600)


@query(FIRST_SQL)
def t3_first_of_each_stream(spark, sf_dir):
    e = event_rows(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), F.col("event_type").alias("content"), F.col("ts").alias("at"))
    stream, folder = streamed(e, "at")
    return J.run_to_table(J.first_within_stream(stream, 6 * 3600), "append", folder).drop("batch_id")


@query()
def t3_unrepeated(spark, sf_dir):
    e = event_rows(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), F.col("event_type").alias("content"), F.col("ts").alias("at"))
    stream, folder = streamed(e, "at")
    return J.run_to_table(J.unrepeated(stream, "6 hours"), "append", folder).select("session_id", "id")


SILENT_SQL = """with e as (select user_id, event_id, ts, case event_id % 3 when 0 then 'RUNNING' when 1 then 'PENDING' else 'SUCCEEDED' end status from events),
    l as (select *, lead(ts) over (partition by user_id order by ts, event_id) after_ from e), z as (select max(ts) - interval 1 minute last from events)
    select user_id as analysis_id, 'FAILED' as status, 5003 as error_code, count(*) as times from l, z where status <> 'SUCCEEDED' and coalesce(after_, last) > ts + interval 12 hours group by 1"""


@query(SILENT_SQL)
def t4_silences(spark, sf_dir):
    """Batch twin of the stuck runs: how often a run stayed without an event for twelve hours, up to the last event of all."""
    status = F.when(F.col("event_id") % 3 == 0, "RUNNING").when(F.col("event_id") % 3 == 1, "PENDING").otherwise("SUCCEEDED")
    e = event_rows(spark, sf_dir).select(F.col("user_id").alias("analysis_id"), F.col("event_id").alias("seq"), status.alias("status"), F.col("ts").alias("at"))
    return J.silences(e, 720).groupBy("analysis_id", "status", "error_code").agg(F.count("*").alias("times"))


@query(SILENT_SQL)
def t4_stuck_runs(spark, sf_dir):
    status = F.when(F.col("event_id") % 3 == 0, "RUNNING").when(F.col("event_id") % 3 == 1, "PENDING").otherwise("SUCCEEDED")
    e = event_rows(spark, sf_dir).select(F.col("user_id").alias("analysis_id"), F.col("event_id").alias("seq"), status.alias("status"), F.col("ts").alias("at"))
    stream, folder = streamed(e, "at", 6)
    found = J.run_to_table(J.stuck_runs(stream, 720), "append", folder).drop("batch_id")
    return found.groupBy("analysis_id", "status", "error_code").agg(F.count("*").alias("times"))


@query(f"select {source_code.KEYS}, line, 'SECRET-HARDCODED' as rule_key from {source_code.LINES} where {source_code.SECURE}")
def t5_rule_scan_stream(spark, sf_dir):
    stream, folder = streamed(source_code.files(spark, sf_dir), "doc_id")
    found = R.scan_lines(R.lines_of(stream)).filter("rule_key = 'SECRET-HARDCODED'")
    return J.run_to_table(found, "append", folder).select(*source_code.HIT)


#: Every fifth file comes again, with another secret on its second line instead of its text.
AGAIN = "token = 'abcdefgh12345'"


@query(
    f"""select {source_code.KEYS}, line, 'SECRET-HARDCODED' as rule_key from {source_code.lines_sql("(select * from " + source_code.FILES + " where doc_id % 5 <> 0)")} where {source_code.SECURE}
    union all select {source_code.KEYS}, 2, 'SECRET-HARDCODED' from {source_code.FILES} where doc_id % 10 = 0"""
)
def t5_snapshot_stream(spark, sf_dir):
    """Findings of arriving files as a snapshot: a file that comes again replaces its own, or has none any more; and a second run over the
    same files, as after a failure, leaves one copy."""
    first = source_code.files(spark, sf_dir).withColumn("seq", F.col("doc_id"))
    later = F.when(F.col("doc_id") % 10 == 0, F.lit(f"x\n{AGAIN}\n")).otherwise("clean")
    again = first.filter("doc_id % 5 = 0").withColumns({"content": later, "seq": F.col("doc_id") + 1_000_000_000_000})
    stream, folder = streamed(first.unionByName(again), "seq", 4)
    find = lambda rows: R.scan_lines(R.lines_of(rows)).filter("rule_key = 'SECRET-HARDCODED'").select(*source_code.HIT)
    keys = tuple(source_code.KEYS.split(", "))
    for state in ("a", "b"):  # the second has lost where it was, but the table knows
        found = J.run_to_snapshot(stream, find, f"{folder}/issues", f"{folder}/{state}", keys, "rules", "seq")
    return found.select(*source_code.HIT)


@query("select conv_id as session_id, case when max(case when role = 'system' and conv_id % 3 = 0 then 'error' end) is null then string_agg(text, '' order by turn) else 'error' end as answer, max(case when role = 'system' and conv_id % 3 = 0 then 'error' end) is not null as failed from conversations group by 1")
def t6_answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    error = F.when((F.col("role") == "system") & (F.col("conv_id") % 3 == 0), "error")
    stream, folder = streamed(c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "text", error.alias("error")), "session_id")
    return J.latest_by_batch(J.run_to_table(J.answers(stream), "update", folder), ["session_id"])
