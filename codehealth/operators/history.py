"""Commit history: trends, authors, churn, hotspots, dependency results. Every function is keyed by `keys`, so one job
covers all projects. Commits have (commit_hash, author_name, committed_at, added, removed), files (commit_hash, path,
added, removed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE_DAYS = {"30d": 30, "90d": 90, "180d": 180}


def week_start(ts: Column) -> Column:
    """Monday of the week in UTC; '' if there is no time."""
    return F.coalesce(F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd"), F.lit(""))


def weekly_trend(commits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return commits.groupBy(*(keys or []), week_start(F.col("committed_at")).alias("week")).agg(
        F.count("*").alias("commits"), F.sum("added").cast("long").alias("added"), F.sum("removed").cast("long").alias("removed")
    )


def author_totals(commits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    author = F.coalesce(F.nullif(F.col("author_name"), F.lit("")), F.lit("unknown"))
    return commits.groupBy(*(keys or []), author.alias("author")).agg(F.count("*").alias("commits"), F.sum("added").cast("long").alias("added"))


def file_churn(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Commits that touch each file, lines added and removed. A path twice in one commit counts once."""
    keys = keys or []
    once = files.groupBy(*keys, "commit_hash", "path").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    return once.groupBy(*keys, "path").agg(F.count("*").alias("commits"), F.sum("added").cast("long").alias("added"), F.sum("removed").cast("long").alias("removed"))


def top_files(files: DataFrame, n: int = 10, keys: list[str] | None = None) -> DataFrame:
    """The n most touched files of each key, then by lines added, then by path."""
    order = [F.desc("commits"), F.desc("added"), F.asc("path")]
    churn = file_churn(files, keys)
    if not keys:
        return churn.orderBy(*order).limit(n)
    ranked = churn.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n).drop("rank")


def hotspots(files: DataFrame, keys: list[str] | None = None, top: int = 10, share: float = 0.15, min_added: int = 300, huge_added: int = 2000, min_commits: int = 3) -> DataFrame:
    """Risk of the top files: HIGH by share of commits with many lines, or by lines alone; MEDIUM by touches; others go."""
    keys = keys or []
    total = files.groupBy(*keys).agg(F.countDistinct("commit_hash").alias("total")) if keys else files.agg(F.countDistinct("commit_hash").alias("total"))
    best = top_files(files, top, keys)
    rows = best.join(total, keys) if keys else best.crossJoin(F.broadcast(total))  # one row of totals
    part = F.col("commits") / F.col("total")
    level = F.when(((part >= share) & (F.col("added") >= min_added)) | (F.col("added") >= huge_added), "HIGH").when(F.col("commits") >= min_commits, "MEDIUM")
    evidence = F.array(
        F.format_string("commits: %d", "commits"),
        F.format_string("share: %d%%", F.rint(part * 100).cast("long")),
        F.format_string("added: %d", "added"),
        F.format_string("removed: %d", "removed"),
    )
    return rows.select(*keys, F.col("path").alias("module"), level.alias("risk_level"), evidence.alias("evidence")).filter("risk_level is not null")


def in_last_days(frame: DataFrame, ts: str, as_of: str, days: int | None) -> DataFrame:
    """Rows of the last 1..3650 days before as_of; None or 0: all."""
    if not days:
        return frame
    if not 1 <= days <= 3650:
        raise ValueError("days must be 1..3650")
    return frame.filter(F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days"))


def in_range(frame: DataFrame, ts: str, as_of: str, name: str) -> DataFrame:
    """A range by name: 30d, 90d, 180d, all; any other is 30d."""
    return in_last_days(frame, ts, as_of, None if name == "all" else RANGE_DAYS.get(name, 30))


def history_bundle(commits: DataFrame, files: DataFrame, as_of: str, name: str, top: int = 10) -> DataFrame:
    """kind, key, a, b: trend and authors of the range, and top files of the whole history."""
    recent = in_range(commits, "committed_at", as_of, name)
    trend = weekly_trend(recent).select(F.lit("trend").alias("kind"), F.col("week").alias("key"), F.col("commits").alias("a"), F.col("added").alias("b"))
    authors = author_totals(recent).select(F.lit("author").alias("kind"), F.col("author").alias("key"), F.col("commits").alias("a"), F.col("added").alias("b"))
    best = top_files(files, top).select(F.lit("file").alias("kind"), F.col("path").alias("key"), F.col("commits").alias("a"), F.col("added").alias("b"))
    return trend.unionByName(authors).unionByName(best)


ECOSYSTEMS = {"maven": "MAVEN", "npm": "NPM", "pip": "PIP"}


def dependency_results(deps: DataFrame) -> DataFrame:
    """Suggestion and ecosystem code of each dependency (ecosystem, name, version, latest, risk_reason, is_eol)."""
    advice = F.when(F.col("is_eol") & F.col("latest").isNotNull(), F.concat(F.lit("upgrade to "), "latest")).when(
        F.col("is_eol"), F.concat(F.lit("confirm support: "), F.coalesce("risk_reason", F.lit("")))
    )
    code = F.lit("OTHER")
    for name, value in ECOSYSTEMS.items():
        code = F.when(F.lower("ecosystem") == name, value).otherwise(code)
    return deps.withColumn("suggestion", advice).withColumn("ecosystem_code", code)


def dependency_stats(deps: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return deps.groupBy(*(keys or [])).agg(F.count("*").alias("total"), F.count_if(F.col("is_eol")).alias("eol"), F.count_if(F.col("risk_level") == "HIGH").alias("high"))
