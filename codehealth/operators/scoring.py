"""Health scores and reports. Rounding is half-even, as the level borders depend on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehealth.functions.text import json_object

TOP_DIRS = ("src", "backend", "frontend", "lib", "app")
WEIGHTS = (("quality", 0.4), ("structure", 0.3), ("dependency", 0.15), ("scale", 0.15))


def quality_with_metrics(bugs: Column, vulnerabilities: Column, smells: Column, duplication: Column, coverage: Column, complexity: Column) -> Column:
    """85 less what the metrics cost, 40 at least; a null metric costs nothing."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    cost = 3 * F.least(zero(bugs), F.lit(5)) + 5 * F.least(zero(vulnerabilities), F.lit(3))
    cost = cost + F.when(smells > 50, F.least(F.floor((smells - 50) / 50), F.lit(10))).otherwise(0)
    cost = cost + F.when(duplication > 10, F.least(F.floor(F.floor(duplication - 10) / 5), F.lit(6))).otherwise(0)
    cost = cost + F.when(coverage < 50, 8).otherwise(0) + F.when(complexity > 5, 5).otherwise(0)
    return F.greatest(F.lit(85) - cost, F.lit(40)).cast("long")


def quality_by_proxy(big_files: Column, truncated: Column) -> Column:
    return F.greatest(F.lit(75) - 5 * F.least(big_files, F.lit(3)) - F.when(truncated, 5).otherwise(0), F.lit(40)).cast("long")


def structure(has_backend: Column, has_frontend: Column, has_top_dir: Column, has_files: Column) -> Column:
    sides = F.when(has_backend & has_frontend, 10).when(has_backend | has_frontend, 5).otherwise(0)
    return F.least(F.lit(70) + sides + F.when(has_top_dir, 10).otherwise(0) + F.when(has_files, 5).otherwise(0), F.lit(95)).cast("long")


def dependency(frameworks: Column) -> Column:
    return F.when(F.size(frameworks) > 0, 75).otherwise(70).cast("long")


def scale(loc: Column) -> Column:
    return F.when(loc < 1_000, 95).when(loc < 10_000, 90).when(loc < 50_000, 80).when(loc < 200_000, 65).otherwise(50).cast("long")


def health(quality: Column, structure_: Column, dependency_: Column, scale_: Column) -> Column:
    return F.rint(quality * 0.4 + structure_ * 0.3 + dependency_ * 0.15 + scale_ * 0.15).cast("long")


def level(score: Column) -> Column:
    """The report's scale."""
    return F.when(score >= 90, "EXCELLENT").when(score >= 75, "GOOD").when(score >= 60, "FAIR").otherwise("POOR")


def stars(score: Column) -> Column:
    return F.least(F.greatest(F.rint(score / 20), F.lit(1)), F.lit(5)).cast("long")


def scored(scan: DataFrame) -> DataFrame:
    """scan (loc_total, file_count, frameworks, has_backend, has_frontend, has_top_dir, skipped_big, truncated, and the quality
    metrics or null bugs) with all scores, health and level."""
    with_metrics = quality_with_metrics(*map(F.col, ("bugs", "vulnerabilities", "code_smells", "duplication_rate", "coverage_rate", "complexity")))
    out = scan.withColumn("quality", F.when(F.col("bugs").isNotNull(), with_metrics).otherwise(quality_by_proxy(F.col("skipped_big"), F.col("truncated"))))
    out = out.withColumn("structure", structure(F.col("has_backend"), F.col("has_frontend"), F.col("has_top_dir"), F.col("file_count") > 0))
    out = out.withColumn("dependency", dependency(F.col("frameworks"))).withColumn("scale", scale(F.col("loc_total")))
    out = out.withColumn("health", health(*map(F.col, ("quality", "structure", "dependency", "scale"))))
    return out.withColumn("level", level(F.col("health")))


def risks() -> Column:
    """Risks of a scan, in order, as an array of (title, level)."""
    risk = lambda c, title, level_: F.when(c, F.struct(F.lit(title).alias("title"), F.lit(level_).alias("level")))
    return F.array_compact(
        F.array(
            risk(F.col("vulnerabilities") > 0, "vulnerabilities", "HIGH"),
            risk(F.col("bugs") > 0, "bugs", "MEDIUM"),
            risk(F.col("code_smells") > 0, "code smells", "LOW"),
            risk(F.col("skipped_big") > 0, "big files", "HIGH"),
            risk(F.col("loc_total") > 200_000, "large code base", "MEDIUM"),
            risk(F.size("frameworks") == 0, "unknown frameworks", "LOW"),
            risk(F.col("truncated"), "truncated scan", "MEDIUM"),
        )
    )


def phases() -> Column:
    """Recommendations in three phases; phases without items are dropped."""
    item = lambda c, text: F.when(c, F.lit(text))
    phase = lambda name, *items: F.struct(F.lit(name).alias("phase"), F.array_compact(F.array(*items)).alias("items"))
    all_ = F.array(
        phase("now", item(F.col("vulnerabilities") > 0, "close vulnerabilities"), item(F.col("bugs") > 0, "fix bugs")),
        phase("next", item(F.col("skipped_big") > 0, "split big files"), item(F.col("code_smells") > 50, "clean up")),
        phase("later", item(F.col("loc_total") > 50_000, "cut modules")),
    )
    return F.filter(all_, lambda p: F.size(p["items"]) > 0)


REPORT = "healthScore double, level string, dimensions array<struct<key:string,score:double>>, risks array<struct<title:string,level:string>>, recommendations array<struct<phase:string,items:array<string>>>"


def validated(candidates: DataFrame, base: str = "base_health") -> DataFrame:
    """candidates (report_json, base) with health_score, level, source: a report with the four dimensions, titled risks and
    filled recommendations counts, its score held within 10 of the base and in 0..100; any other falls back to the base. Prose and
    code fences around a report do not matter."""
    r = json_object(F.col("report_json"), REPORT)
    rows = candidates.withColumn("__r", r)
    keys = F.transform("__r.dimensions", lambda d: d["key"])
    good = (
        (keys == F.array(*[F.lit(k) for k, _ in WEIGHTS]))
        & F.forall("__r.dimensions", lambda d: d["score"].isNotNull())
        & F.forall(F.coalesce("__r.risks", F.array().cast("array<struct<title:string,level:string>>")), lambda x: F.coalesce(F.trim(x["title"]) != "", F.lit(False)))
        & F.forall(F.coalesce("__r.recommendations", F.array().cast("array<struct<phase:string,items:array<string>>>")), lambda x: F.coalesce(F.size(x["items"]) > 0, F.lit(False)))
        & F.col("__r.healthScore").isNotNull()
    )
    ok = F.coalesce(good, F.lit(False))
    near = F.least(F.greatest(F.rint("__r.healthScore"), F.col(base) - 10), F.col(base) + 10)
    score = F.when(ok, F.least(F.greatest(near, F.lit(0)), F.lit(100))).otherwise(F.col(base)).cast("long")
    return rows.withColumn("health_score", score).withColumn("level", F.when(ok, F.coalesce("__r.level", level(score))).otherwise(level(score))).withColumn("source", F.when(ok, "CANDIDATE").otherwise("RULES")).drop("__r")


def report_rows(reports: DataFrame, key: str = "analysis_id") -> DataFrame:
    """key, part, name, value: dimensions and risks of stored reports; unreadable JSON gives one row of nulls."""
    r = reports.withColumn("__r", F.from_json("report_json", REPORT))
    dims = r.select(key, F.lit("dimension").alias("part"), F.explode_outer("__r.dimensions").alias("d")).select(key, "part", F.col("d.key").alias("name"), F.col("d.score").cast("string").alias("value"))
    return dims.unionByName(r.select(key, F.lit("risk").alias("part"), F.explode("__r.risks").alias("d")).select(key, "part", F.col("d.title").alias("name"), F.col("d.level").alias("value")))


def risk_diff(before: DataFrame, after: DataFrame, key: str = "project_id") -> DataFrame:
    """key, title, change (added, removed, kept) between two reports (key, title)."""
    a = before.select(key, "title").distinct().withColumn("a", F.lit(True))
    b = after.select(key, "title").distinct().withColumn("b", F.lit(True))
    change = F.when(F.col("a") & F.col("b"), "kept").when(F.col("a"), "removed").otherwise("added")
    return a.join(b, [key, "title"], "full_outer").select(key, "title", change.alias("change"))


def dimension_compare(base: DataFrame, now: DataFrame, key: str = "project_id") -> DataFrame:
    """key, dimension, score, base_score (null if the base lacks it) of the current dimensions."""
    return now.join(base.select(key, "dimension", F.col("score").alias("base_score")), [key, "dimension"], "left").select(key, "dimension", "score", "base_score")
