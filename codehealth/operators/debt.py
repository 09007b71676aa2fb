"""Technical debt: what is collected, who may change it, and the life of projects and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codehealth.functions.text import clipped

DEBT = ("project_id", "source", "level", "title", "suggestion")


def _row(rows: DataFrame, source: str, level: Column, title: Column, suggestion: Column) -> DataFrame:
    return rows.select("project_id", F.lit(source).alias("source"), level.alias("level"), F.coalesce(clipped(title, 60), F.lit("(untitled)")).alias("title"), suggestion.alias("suggestion"))


def architecture_debt(violations: DataFrame, cycles_too: bool = False) -> DataFrame:
    """Violations HIGH or MEDIUM; with cycles_too MAJOR ones count as MEDIUM."""
    level = F.when((F.col("severity") == "MAJOR") & F.lit(cycles_too), "MEDIUM").otherwise(F.col("severity"))
    return _row(violations.withColumn("level", level).filter("level in ('HIGH', 'MEDIUM')"), "ARCH", F.col("level"), F.col("reason"), F.lit(None).cast("string"))


def quality_debt(issues: DataFrame) -> DataFrame:
    level = F.when(F.col("severity") == "BLOCKER", "HIGH").when(F.col("severity") == "CRITICAL", "MEDIUM")
    return _row(issues.withColumn("level", level).filter("level is not null"), "QUALITY", F.col("level"), F.col("message"), F.lit(None).cast("string"))


def evolution_debt(hotspots: DataFrame) -> DataFrame:
    """Hotspots HIGH, with their evidence as suggestion."""
    return _row(hotspots.filter("risk_level = 'HIGH'"), "EVOLUTION", F.col("risk_level"), F.col("module"), F.array_join("evidence", "；"))


def dependency_debt(deps: DataFrame) -> DataFrame:
    advice = F.when(F.col("latest").isNotNull(), F.concat(F.lit("upgrade to "), "latest")).otherwise(F.col("suggestion"))
    return _row(deps.filter("risk_level in ('HIGH', 'MEDIUM')"), "DEPEND", F.col("risk_level"), F.col("name"), advice)


def rebuilt(old: DataFrame, projects: DataFrame, *found: DataFrame, sources: tuple[str, ...] = ("ARCH", "QUALITY", "EVOLUTION", "DEPEND")) -> DataFrame:
    """Debt rows after a rebuild of `projects` (project_id): their rows of the four sources are replaced by those found, which
    may be none; their other rows and other projects stay."""
    gone = projects.select("project_id").distinct().crossJoin(old.sparkSession.createDataFrame([(x,) for x in sources], "source string"))
    out = old.join(gone, ["project_id", "source"], "left_anti").select(*DEBT)
    for rows in found:
        out = out.unionByName(rows.join(projects.select("project_id").distinct(), "project_id", "left_semi").select(*DEBT))
    return out


#: Allowed changes of status.
CHANGES = {"OPEN": ("DOING", "DONE", "WONTFIX"), "DOING": ("DONE",), "DONE": (), "WONTFIX": ()}


def status_changes(events: DataFrame, key: str = "debt_id") -> DataFrame:
    """events (key, seq, target, note, reason) with before, accepted, why. A rejected event does not change the status, so the
    verdict of one depends on those before: a fold over each debt's events."""
    allowed = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)).cast("array<string>") for pair in CHANGES.items() for x in pair])
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    item = "array<struct<seq:bigint,target:string,before:string,why:string>>"

    def step(acc: Column, e: Column) -> Column:
        why = (
            F.when(~F.array_contains(F.coalesce(F.try_element_at(allowed, acc["status"]), F.array().cast("array<string>")), e["target"]), "illegal change")
            .when((e["target"] == "DONE") & blank(e["note"]), "missing note")
            .when((e["target"] == "WONTFIX") & blank(e["reason"]), "missing reason")
        )
        row = F.array(F.struct(e["seq"].cast("long").alias("seq"), e["target"].alias("target"), acc["status"].alias("before"), why.alias("why")))
        return F.struct(F.when(why.isNull(), e["target"]).otherwise(acc["status"]).alias("status"), F.concat(acc["out"], row).alias("out"))

    start = F.struct(F.lit("OPEN").alias("status"), F.array().cast(item).alias("out"))
    own = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "target", "note", "reason"))).alias("e"))
    rows = own.select(key, F.explode(F.aggregate("e", start, step, lambda acc: acc["out"])).alias("r")).select(key, "r.*")
    return rows.withColumn("accepted", F.col("why").isNull())


def intake(rows: DataFrame) -> DataFrame:
    """rows (title, source, level) with level and reason: why a row is rejected, null if it is not."""
    title = F.trim("title")
    reason = F.when(title.isNull() | (title == ""), "title missing").when(F.char_length(title) > 200, "title too long").when(~F.coalesce(F.col("source").isin("MANUAL", "AI_DOCTOR"), F.lit(False)), "unknown source")
    level = F.when(F.upper("level").isin("HIGH", "MEDIUM", "LOW"), F.upper("level")).otherwise("MEDIUM")
    return rows.withColumn("level", level).withColumn("reason", reason)


# --- lifecycle ------------------------------------------------------------------------------------------------------


def purged(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows without those of the purged keys."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


#: Tables with a project_id, and tables that reach it in two hops: over which table, by which columns (own, that table's).
OF_PROJECT = (
    "file_node", "quality_issue", "architecture_node", "architecture_edge", "arch_violation", "commit_stat", "file_change_stat", "hotspot",
    "chat_session", "knowledge_chunk", "tech_debt", "generated_doc", "dependency", "analysis",
)
BY_WAY = {"chat_message": ("chat_session", "session_id", "session_id"), "analysis_report": ("analysis", "analysis_id", "analysis_id")}


def purge(tables: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without what belongs to the projects in gone (project_id), and the runs of these that were cancelled first.
    Tables by name: `project`, those of OF_PROJECT, those of BY_WAY, as many as are given; others stay as they are."""
    gone, out = gone.select("project_id").distinct(), dict(tables)
    stopped = gone.sparkSession.createDataFrame([], "project_id string, status string")
    if "analysis" in tables:
        runs = tables["analysis"]
        stopped = cancelled(runs.filter("status = 'RUNNING'").join(gone, "project_id", "left_semi"), gone)
    for name in ("project", *OF_PROJECT):
        if name in tables:
            out[name] = purged(tables[name], gone, "project_id")
    for name, (over, own, other) in BY_WAY.items():
        if name in tables and over in tables:
            lost = tables[over].join(gone, "project_id", "left_semi").select(F.col(other).alias(own))
            out[name] = purged(tables[name], lost, own)
    return out, stopped


def cancelled(runs: DataFrame, gone: DataFrame, key: str = "project_id") -> DataFrame:
    """Running runs of purged projects are CANCELLED before they go."""
    mark = gone.select(key).distinct().withColumn("__gone", F.lit(True))
    rows = runs.join(mark, key, "left")
    return rows.withColumn("status", F.when(F.col("__gone") & (F.col("status") == "RUNNING"), "CANCELLED").otherwise(F.col("status"))).drop("__gone")


def recovered(runs: DataFrame, projects: DataFrame, key: str = "project_id") -> tuple[DataFrame, DataFrame]:
    """Pending and running runs fail with 5003; their projects, if analysing, are ready again."""
    stuck = F.col("status").isin("PENDING", "RUNNING")
    fixed = runs.withColumn("error_code", F.when(stuck, 5003)).withColumn("status", F.when(stuck, "FAILED").otherwise(F.col("status")))
    hit = runs.filter(stuck).select(key).distinct().withColumn("__hit", F.lit(True))
    own = projects.join(hit, key, "left").withColumn("status", F.when(F.col("__hit") & (F.col("status") == "ANALYZING"), "READY").otherwise(F.col("status"))).drop("__hit")
    return fixed, own


def several_active(runs: DataFrame, key: str = "project_id") -> DataFrame:
    """Projects with more than one pending or running run."""
    return runs.groupBy(key).agg(F.count_if(F.col("status").isin("PENDING", "RUNNING")).alias("active")).filter("active > 1")


def audit(df: DataFrame, unique: list[str], not_null: list[str] = (), enums: dict[str, list] | None = None, foreign: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """rule, n: how many rows break each constraint. One pass for columns, one shuffle for the key, one join per reference."""
    counts = [F.count_if(F.col(c).isNull()).alias(f"null:{c}") for c in not_null] + [F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*v)).alias(f"enum:{c}") for c, v in (enums or {}).items()]
    twice = df.groupBy(*unique).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count") - 1)), F.lit(0)).alias("n")).select(F.lit("unique:" + ",".join(unique)).alias("rule"), "n")
    out = twice
    if counts:
        names = [c for c in df.agg(*counts).columns]
        out = out.unionByName(df.agg(*counts).select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("n")) for c in names])).alias("r")).select("r.rule", "r.n"))
    for column, (other, key) in (foreign or {}).items():
        known = other.select(F.col(key).alias("__key")).distinct()
        orphan = df.filter(F.col(column).isNotNull()).join(known, F.col(column) == F.col("__key"), "left_anti")
        out = out.unionByName(orphan.agg(F.count("*").alias("n")).select(F.lit(f"orphan:{column}").alias("rule"), "n"))
    return out
