"""Portfolio and chat: latest reports, lists, distributions, sessions. Rows of `runs` are (project_id, id, status, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_value(runs: DataFrame, project: str, order: str, value: str, name: str) -> DataFrame:
    """value of the row with the greatest `order` of each project: one shuffle, no window."""
    return runs.groupBy(project).agg(F.max_by(value, order).alias(name))


def with_latest_score(projects: DataFrame, runs: DataFrame, key: str = "project_id") -> DataFrame:
    """Projects, and the score of their latest succeeded run (null if none)."""
    return projects.join(latest_value(runs.filter("status = 'SUCCEEDED'"), key, "id", "score", "health_score"), key, "left")


def latest_snapshot(rows: DataFrame, runs: DataFrame, key: str = "project_id", run: str = "analysis_id") -> DataFrame:
    """The rows of each project's latest succeeded run."""
    last = runs.filter("status = 'SUCCEEDED'").groupBy(key).agg(F.max("id").alias(run))
    return rows.join(last, [key, run], "left_semi")


def latest_rows(runs: DataFrame, key: str, order: str) -> DataFrame:
    """The whole latest row of each key."""
    first = Window.partitionBy(key).orderBy(F.desc(order))
    return runs.withColumn("__rank", F.row_number().over(first)).filter("__rank = 1").drop("__rank")


def visible(rows: DataFrame) -> DataFrame:
    """Rows that are not softly deleted."""
    return rows.filter("deleted = 0")


def project_filter(projects: DataFrame, keyword: str | None = None, language: str | None = None, status: str | None = None) -> DataFrame:
    out = visible(projects)
    if keyword:
        out = out.filter(F.col("name").contains(keyword))
    if language:
        out = out.filter(F.map_contains_key("lang_stats", language))
    if status:
        out = out.filter(F.col("status") == status)
    return out


def issue_filter(issues: DataFrame, **equal: str | None) -> DataFrame:
    """Equality on trimmed upper-case values; blank values do not filter."""
    for name, value in equal.items():
        if value and value.strip():
            issues = issues.filter(F.col(name) == value.strip().upper())
    return issues


#: Sort keys of the project list and whether they run downwards by default.
SORTS = {"createdAt": ("created_at", True), "lastAnalyzedAt": ("last_analyzed_at", True), "locTotal": ("loc_total", False), "name": ("name", False), "healthScore": ("health_score", False)}


def page(rows: DataFrame, order: list[Column], number: int, size: int, most: int = 100) -> DataFrame:
    """Page `number` (from 1) of `size` rows, which `most` bounds. `order` ends in a unique key."""
    size = max(1, min(size, most))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def project_order(sort: str | None, descending: bool | None = None, unique: str = "project_id") -> list[Column]:
    """Unknown sorts are createdAt. Null scores come last; of the other keys nulls are first downwards, last upwards."""
    column, down = SORTS.get(sort or "", SORTS["createdAt"])
    down = down if descending is None else descending
    if column == "health_score":
        first = F.desc_nulls_last(column) if down else F.asc_nulls_last(column)
    else:
        first = F.desc_nulls_first(column) if down else F.asc_nulls_last(column)
    return [first, F.asc(unique)]


def recent(projects: DataFrame, n: int = 8, unique: str = "project_id") -> DataFrame:
    """The n projects with the latest analysis, or else creation."""
    return projects.orderBy(F.coalesce("last_analyzed_at", "created_at", F.lit("")).desc(), F.asc(unique)).limit(n)


def report_history(runs: DataFrame, reports: DataFrame, n: int, key: str = "project_id") -> DataFrame:
    """Reports of the last n (1..20) succeeded runs of each project; runs without a report count but do not show."""
    ranked = runs.filter("status = 'SUCCEEDED'").withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("id"))))
    return ranked.filter(F.col("rank") <= min(20, max(1, n))).join(reports, "id")


def kpis(projects: DataFrame) -> DataFrame:
    scored = F.col("health_score").isNotNull()
    return projects.agg(
        F.coalesce(F.round(F.avg(F.when(scored, F.col("health_score"))), 4), F.lit(0.0)).alias("avg_score"),
        F.count_if(F.col("status") == "READY").alias("ready"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.sum(F.coalesce("loc_total", F.lit(0))).alias("loc"),
    )


def score_bucket(score: Column) -> Column:
    return F.when(score.isNull(), "none").when(score >= 80, "high").when(score >= 60, "mid").otherwise("low")


def display_level(score: Column) -> Column:
    """The list's scale; no score is POOR."""
    return F.when(score >= 80, "EXCELLENT").when(score >= 60, "GOOD").when(score >= 40, "FAIR").otherwise("POOR")


def distribution(rows: DataFrame, value: Column, name: str) -> DataFrame:
    return rows.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def language_composition(projects: DataFrame, n: int = 8) -> DataFrame:
    """Sum of the shares of each language over all projects, the n greatest."""
    each = projects.select(F.explode("lang_stats").alias("language", "share"))
    return each.groupBy("language").agg(F.round(F.sum("share"), 1).alias("share")).orderBy(F.desc("share"), "language").limit(n)


def chat_context(projects: DataFrame) -> DataFrame:
    """project_id, top language, first framework, loc."""
    top = projects.select("project_id", F.explode_outer("lang_stats").alias("language", "share")).groupBy("project_id").agg(F.max_by("language", F.struct("share", "language")).alias("top_language"))
    return projects.join(top, "project_id").select("project_id", "top_language", F.get("framework_tags", F.lit(0)).alias("framework"), "loc_total")


def quality_metrics(issues: DataFrame, shown: DataFrame, key: str = "project_id") -> DataFrame:
    """Counts by kind over all issues of a project; available if the filtered issues are not empty."""
    all_ = issues.groupBy(key).agg(
        F.count_if(F.col("kind") == "BUG").alias("bugs"),
        F.count_if(F.col("kind") == "VULNERABILITY").alias("vulnerabilities"),
        F.count_if(~F.coalesce(F.col("kind").isin("BUG", "VULNERABILITY"), F.lit(False))).alias("code_smells"),
    )
    total = shown.groupBy(key).agg(F.count("*").alias("total"))
    return all_.join(total, key, "left").select(key, "bugs", "vulnerabilities", "code_smells", F.coalesce("total", F.lit(0)).alias("total"), (F.coalesce("total", F.lit(0)) > 0).alias("available"))


def sessions(sessions_: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with number of messages and last message time."""
    own = messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.max("at").alias("last_at"))
    return sessions_.join(own, "session_id", "left").withColumn("messages", F.coalesce("messages", F.lit(0)))


def chat_window(messages: DataFrame, n: int = 12) -> DataFrame:
    """The last n messages of each session before its latest one."""
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("id")))
    return messages.withColumn("back", rank - 1).filter(F.col("back").between(1, n))


def repeated_submits(messages: DataFrame, within: str = "2 seconds") -> DataFrame:
    """Messages that repeat the session's previous user message within the time."""
    own = Window.partitionBy("session_id").orderBy("at", "id")
    user = messages.filter("role = 'USER'").withColumn("before", F.lag("content").over(own)).withColumn("before_at", F.lag("at").over(own))
    return user.filter((F.col("content") == F.col("before")) & (F.col("at") <= F.col("before_at") + F.expr(f"interval {within}"))).drop("before", "before_at")


def session_titles(messages: DataFrame, most: int = 20) -> DataFrame:
    """First user message of each session, cut."""
    return messages.filter("role = 'USER'").groupBy("session_id").agg(F.substring(F.min_by("content", "id"), 1, most).alias("title"))


def score_deltas(runs: DataFrame, back: int = 1, key: str = "project_id") -> DataFrame:
    """Score and its change against the run `back` runs ago."""
    before = F.lag("score", back).over(Window.partitionBy(key).orderBy("id"))
    return runs.filter("status = 'SUCCEEDED'").withColumn("delta", F.col("score") - before)


def earlier_runs(runs: DataFrame, n: int = 3, key: str = "project_id") -> DataFrame:
    """Each succeeded run with the ids of the n before it, newest first."""
    own = Window.partitionBy(key).orderBy("id").rowsBetween(-n, -1)
    return runs.filter("status = 'SUCCEEDED'").withColumn("earlier", F.reverse(F.collect_list("id").over(own)))


def architecture_doc(nodes: DataFrame, edges: DataFrame, violations: DataFrame, names: int = 30, n_edges: int = 50, n_violations: int = 20, key: str = "project_id") -> DataFrame:
    """project, section, n, body: names of each layer, edges and violations, each list cut."""

    def section(rows: DataFrame, label: Column, text: Column, most: int) -> DataFrame:
        named = rows.select(key, label.alias("section"), text.alias("text"))
        ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy(key, "section").orderBy("text")))
        cut = ranked.groupBy(key, "section").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.col("text")))).alias("t"))
        return cut.select(key, "section", "n", F.array_join("t", ", ").alias("body"))

    arrow = F.concat("source", F.lit(" -> "), "target")
    return section(nodes, F.col("node_type"), F.col("name"), names).unionByName(section(edges, F.lit("EDGES"), arrow, n_edges)).unionByName(section(violations, F.lit("VIOLATIONS"), arrow, n_violations))


def profile_doc(projects: DataFrame, files: DataFrame, most: int = 30) -> DataFrame:
    """project_id, doc: languages, frameworks, size and the first files by path."""
    ranked = files.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy("path"))).filter(F.col("rank") <= most)
    listed = ranked.groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_list("path")), "\n").alias("files"))
    shares = F.array_join(F.transform(F.array_sort(F.map_entries("lang_stats"), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1)), lambda e: F.format_string("%s %.1f%%", e["key"], e["value"])), ", ")
    doc = F.concat_ws("\n", shares, F.array_join("framework_tags", ", "), F.format_string("%d lines", "loc_total"), "files")
    return projects.join(listed, "project_id", "left").select("project_id", doc.alias("doc"))
