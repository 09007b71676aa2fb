"""Sinks that replace snapshots, and the policies of what to keep."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


#: Runs after which a table's visible rows are written anew and its history goes.
RUNS = 16


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the whole generations of a table, in order: each has the visible rows of the one before and the runs since."""
    if not exists(spark, path):
        return []
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    names = sorted(x.getPath().getName() for x in found)
    return [n for n in names if n.startswith("g") and exists(spark, f"{path}/{n}/marks/_SUCCESS")]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def replace_snapshot(rows: DataFrame, path: str, refreshed: DataFrame, keys: tuple[str, ...] = ("project_id", "analysis_id"), batch: tuple[str, int] | None = None, runs: int = RUNS) -> bool:
    """Puts rows in place of what the table at path has for the keys in `refreshed`, which may have no new rows: these are
    cleared. Other keys stay. Writing twice leaves one copy. batch: the name of a stream and the number of its batch; one that is
    there already is not written again. Returns whether it wrote.

    A run appends its rows, then a mark for each of its keys, and of a key only the rows of its last mark are seen. So nothing
    is read to be written over, no folder is made per key, and rows of a run that failed stay unseen. After `runs` runs the
    visible rows become the next generation of the table, and what is no longer seen is deleted. One writer at a time."""
    spark, gone = rows.sparkSession, refreshed.select(*keys).distinct()
    found = _folders(spark, path)
    folder, version = f"{path}/{found[-1] if found else 'g000000'}", 0
    if found:
        marks = spark.read.parquet(f"{folder}/marks")
        version, done = marks.agg(F.max("version"), F.max(F.when(F.col("stream") == batch[0], F.col("batch")) if batch else F.lit(None))).first()
        if batch and done is not None and done >= batch[1]:
            return False
    run = F.lit(uuid.uuid4().hex).alias("run")
    rows.join(gone, list(keys), "left_semi").select("*", run).write.mode("append").parquet(f"{folder}/rows")
    mark = gone.select("*", run, F.lit(version + 1).alias("version"), F.lit(None).cast("string").alias("stream"), F.lit(None).cast("long").alias("batch"))
    if batch:
        mark = mark.unionByName(_no_key(mark).withColumns({"version": F.lit(version + 1), "stream": F.lit(batch[0]), "batch": F.lit(batch[1]).cast("long")}))
    mark.write.mode("append").parquet(f"{folder}/marks")
    if version + 1 > runs:
        compact(spark, path, keys)
    return True


def _no_key(like: DataFrame) -> DataFrame:
    """One row of nulls."""
    return like.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def compact(spark: SparkSession, path: str, keys: tuple[str, ...] = ("project_id", "analysis_id")) -> None:
    """The visible rows as a new generation, which counts once its marks are whole; then the older ones go. What streams have
    written stays known."""
    found = _folders(spark, path)
    old, new = f"{path}/{found[-1]}", f"{path}/g{int(found[-1][1:]) + 1:06d}"
    marks = spark.read.parquet(f"{old}/marks")
    run = F.lit(uuid.uuid4().hex).alias("run")
    rows = snapshot(spark, path, keys)
    rows.select("*", run).write.mode("overwrite").parquet(f"{new}/rows")
    own = rows.select(*keys).distinct().select("*", run, F.lit(0).alias("version"), F.lit(None).cast("string").alias("stream"), F.lit(None).cast("long").alias("batch"))
    streams = marks.filter("stream is not null").groupBy("stream").agg(F.max("batch").alias("batch"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in own.schema.fields if f.name in (*keys, "run")]
    own.unionByName(streams.select(*none, F.lit(0).alias("version"), "stream", "batch")).write.mode("overwrite").parquet(f"{new}/marks")
    for name in found:
        _delete(spark, f"{path}/{name}")


def snapshot(spark: SparkSession, path: str, keys: tuple[str, ...] = ("project_id", "analysis_id")) -> DataFrame:
    """The rows of a snapshot table."""
    folder = f"{path}/{_folders(spark, path)[-1]}"
    last = spark.read.parquet(f"{folder}/marks").filter("run is not null").groupBy(*keys).agg(F.max_by("run", "version").alias("run"))
    return spark.read.parquet(f"{folder}/rows").join(last, [*keys, "run"], "left_semi").drop("run")


def rebuild_index(chunks: DataFrame, path: str, projects: DataFrame) -> None:
    """All chunks (project_id, file, chunk_index, content, ...) of `projects` (project_id) are replaced, by none if they have none;
    the chunks of other projects stay."""
    replace_snapshot(chunks, path, projects, ("project_id",))


def refreshed(old: DataFrame, new: DataFrame, status: DataFrame, project: str = "project_id", run: str = "analysis_id") -> DataFrame:
    """old after a refresh. status (project, run, action): keep leaves all, clear drops the project's rows, replace drops the
    run's rows and takes new ones."""
    cleared = status.filter("action = 'clear'").select(project)
    replaced = status.filter("action = 'replace'").select(project, run)
    rest = old.join(cleared, project, "left_anti").join(replaced, [project, run], "left_anti")
    return rest.unionByName(new.join(replaced, [project, run], "left_semi"))


def replaced_issues(old: DataFrame, new: DataFrame, refreshed: DataFrame, project: str = "project_id") -> DataFrame:
    """All issues of the projects in `refreshed` are replaced by those in `new`, which may have none for some of them; other
    projects stay. Blank fields take defaults."""
    filled = new.withColumn("source", F.coalesce("source", F.lit("SONAR"))).withColumn("severity", F.coalesce("severity", F.lit("INFO"))).withColumn("kind", F.coalesce("kind", F.lit("SMELL"))).withColumn("suggestion", F.nullif(F.trim("suggestion"), F.lit("")))
    gone = refreshed.select(project).distinct()
    return old.join(gone, project, "left_anti").unionByName(filled.join(gone, project, "left_semi"))


def report_columns(reports: DataFrame, key: str = "analysis_id", order: str = "seq") -> DataFrame:
    """Score (cut to an integer), level and summary of the latest report of each analysis; the JSON stays as it is."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    rows = reports.withColumn("__rank", F.row_number().over(last)).filter("__rank = 1").drop("__rank")
    field = lambda name: F.get_json_object("report_json", f"$.{name}")
    return rows.select(key, field("healthScore").try_cast("double").cast("int").alias("health_score"), field("level").alias("level"), field("summary").alias("summary"), "report_json")


def backfilled(reports: DataFrame, existing: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Reports without columns yet: scores that are plain numbers, rounded."""
    raw = F.get_json_object("report_json", "$.healthScore")
    score = F.when(raw.rlike(r"^\d+(\.\d+)?$"), F.round(raw.try_cast("double")).cast("int"))
    return reports.join(existing, key, "left_anti").select(key, score.alias("health_score"))


def markdown(reports: DataFrame, key: str = "project_id") -> DataFrame:
    """Latest report of each project (project, id, health_score, dimensions, risks, recommendations) as Markdown."""
    last = Window.partitionBy(key).orderBy(F.desc("id"))
    rows = reports.withColumn("__rank", F.row_number().over(last)).filter("__rank = 1")
    table = F.array_join(F.transform("dimensions", lambda d: F.format_string("| %s | %d |", d["key"], d["score"].cast("long"))), "\n")
    risks = F.array_join(F.transform("risks", lambda r: F.concat(F.when(r["level"] == "HIGH", "!! ").when(r["level"] == "MEDIUM", "! ").otherwise("- "), r["title"])), "\n")
    advice = F.array_join(F.transform("recommendations", lambda x: F.concat(F.lit("1. "), x)), "\n")
    text = F.concat_ws("\n", F.format_string("# Health %d", "health_score"), F.lit("| dimension | score |\n| --- | --- |"), table, F.lit("## Risks"), risks, F.lit("## Next"), advice)
    return rows.select(key, text.alias("markdown"))
