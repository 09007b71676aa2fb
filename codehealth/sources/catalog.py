"""The engine's tables: declared schemas, allowed values, keys, and reads that never show a softly deleted row."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codehealth.operators.debt import audit

#: What the enum columns may hold.
ANALYSIS_STATUS = ("PENDING", "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED")
PROJECT_STATUS = ("CREATED", "ANALYZING", "READY", "FAILED")
STAGES = ("QUEUED", "SCAN", "SCAN_DONE", "REPORT", "DONE")


class Table(NamedTuple):
    schema: str
    unique: tuple[str, ...] = ("id",)
    not_null: tuple[str, ...] = ("id",)
    enums: dict[str, tuple[str, ...]] = {}
    foreign: dict[str, str] = {}  # column: table whose id it is
    deleted: bool = False


_RUN = {"project_id": "project", "analysis_id": "analysis"}
_OWN = ("id", "project_id", "analysis_id")
TABLES = {
    "project": Table("id long, name string, description string, source_type string, repo_url string, storage_path string, status string, lang_stats map<string,double>, framework_tags array<string>, loc_total long, file_count int, ignored_count int, last_analyzed_at timestamp, created_at timestamp, updated_at timestamp, deleted int", not_null=("id", "name"), enums={"status": PROJECT_STATUS}, deleted=True),
    "analysis": Table("id long, project_id long, type string, status string, progress int, stage string, error_code int, error_message string, report_source string, prompt_version string, regenerated_at timestamp, started_at timestamp, finished_at timestamp, created_at timestamp, deleted int", not_null=("id", "project_id", "status"), enums={"status": ANALYSIS_STATUS, "stage": STAGES}, foreign={"project_id": "project"}, deleted=True),
    "file_node": Table("id long, project_id long, analysis_id long, path string, language string, loc int, size_bytes long", not_null=(*_OWN, "path"), foreign=_RUN),
    "quality_issue": Table("id long, project_id long, analysis_id long, source string, severity string, kind string, rule_key string, file_path string, line int, message string, ai_explanation string, ai_suggestion string, status string", not_null=_OWN, foreign=_RUN),
    "architecture_node": Table("id long, project_id long, analysis_id long, node_key string, name string, node_type string, file_path string, line int", ("analysis_id", "node_key"), (*_OWN, "node_key"), foreign=_RUN),
    "architecture_edge": Table("id long, project_id long, analysis_id long, source_node_id long, target_node_id long, relation string", ("analysis_id", "source_node_id", "target_node_id", "relation"), _OWN, foreign=_RUN | {"source_node_id": "architecture_node", "target_node_id": "architecture_node"}),
    "arch_violation": Table("id long, project_id long, analysis_id long, violation_type string, severity string, description string, suggestion string, source_node_id long, target_node_id long", not_null=_OWN, foreign=_RUN),
    "commit_stat": Table("id long, project_id long, analysis_id long, commit_hash string, author_name string, author_email string, committed_at timestamp, message string, files_changed int, added long, removed long", ("analysis_id", "commit_hash"), (*_OWN, "commit_hash"), foreign=_RUN),
    "file_change_stat": Table("id long, project_id long, analysis_id long, file_path string, change_count int, added long, removed long", ("analysis_id", "file_path"), (*_OWN, "file_path"), foreign=_RUN),
    "tech_debt": Table("id long, project_id long, source string, level string, title string, description string, suggestion string, status string, resolve_note string, wonfix_reason string, ref_analysis_id long, created_at timestamp, resolved_at timestamp, deleted int", not_null=("id", "project_id", "title"), enums={"status": ("OPEN", "DOING", "DONE", "WONTFIX")}, foreign={"project_id": "project"}, deleted=True),
    "generated_doc": Table("id long, project_id long, analysis_id long, doc_type string, title string, content string, version int, edited boolean, created_at timestamp, deleted int", not_null=("id", "project_id"), foreign={"project_id": "project"}, deleted=True),
    "chat_session": Table("id long, project_id long, title string, created_at timestamp, deleted int", not_null=("id", "project_id"), foreign={"project_id": "project"}, deleted=True),
    "chat_message": Table("id long, session_id long, role string, content string, citations array<struct<file:string,line:int,excerpt:string>>, created_at timestamp", not_null=("id", "session_id"), foreign={"session_id": "chat_session"}),
    "knowledge_chunk": Table("id long, project_id long, file string, chunk_index int, content string, symbol string, lang string, start_line int, end_line int, embedding array<float>", ("project_id", "file", "chunk_index"), ("id", "project_id", "file"), foreign={"project_id": "project"}),
    "hotspot": Table("id long, project_id long, analysis_id long, module string, risk_level string, evidence array<string>", not_null=_OWN, foreign=_RUN),
    "dependency": Table("id long, project_id long, analysis_id long, ecosystem string, name string, version string, latest_version string, risk_level string, risk_reason string, suggestion string, file string, is_eol boolean", not_null=_OWN, foreign=_RUN),
    "analysis_report": Table("analysis_id long, health_score int, level string, summary string, report_json string", ("analysis_id",), ("analysis_id", "report_json"), foreign={"analysis_id": "analysis"}),
}


def typed(rows: DataFrame, name: str) -> DataFrame:
    """rows with the columns of the table, in order and of their types: missing ones are null (not deleted, if that is missing), others
    go. A value that its type cannot hold is an error."""
    have = {c.lower(): c for c in rows.columns}
    fields = rows.sparkSession.createDataFrame([], TABLES[name].schema).schema.fields
    empty = lambda f: F.lit(0 if f.name == "deleted" else None)
    return rows.select(*[(F.col(f"`{have[f.name]}`") if f.name in have else empty(f)).cast(f.dataType).alias(f.name) for f in fields])


def write(rows: DataFrame, root: str, name: str, mode: str = "error") -> None:
    """Rows that break a not-null rule or hold a value that is not allowed are an error, and nothing of a task that meets one stays."""
    table, out = TABLES[name], typed(rows, name)
    for c in table.not_null:
        out = out.withColumn(c, F.coalesce(c, F.raise_error(F.lit(f"{name}.{c} is null")).cast(out.schema[c].dataType)))
    for c, allowed in table.enums.items():
        wrong = F.raise_error(F.concat(F.lit(f"{name}.{c} may not be "), F.col(c)))
        out = out.withColumn(c, F.when(F.col(c).isNull() | F.col(c).isin(*allowed), F.col(c)).otherwise(wrong.cast("string")))
    out.write.mode(mode).parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table without softly deleted rows and without the column that marks them, so that no query can forget or undo it; the
    condition reaches the scan."""
    rows = spark.read.schema(TABLES[name].schema).parquet(f"{root}/{name}")
    return rows.filter("deleted = 0").drop("deleted") if TABLES[name].deleted else rows


def broken_rules(spark: SparkSession, root: str, name: str) -> DataFrame:
    """rule, n of the table's constraints: keys, nulls, allowed values, rows whose other table does not have their id."""
    table = TABLES[name]
    foreign = {c: (read(spark, root, other), "id") for c, other in table.foreign.items()}
    return audit(read(spark, root, name), list(table.unique), list(table.not_null), {c: list(v) for c, v in table.enums.items()}, foreign)
