"""Documents derived from source files: endpoint inventories and generated documents with versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codehealth.functions.keys import file_keys


def carried(lines: DataFrame, prefix: str, value: str) -> DataFrame:
    """keys, line, prefix, value: group 1 of `value` on each line, with group 1 of the latest line above that has `prefix`."""
    keys = file_keys(lines)
    own = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = F.nullif(F.regexp_extract("text", prefix, 1), F.lit(""))
    rows = lines.withColumn("prefix", F.last(head, ignorenulls=True).over(own)).withColumn("value", F.regexp_extract("text", value, 1))
    return rows.filter("value <> ''").select(*keys, "line", "prefix", "value")


CLASS_MAPPING, METHOD_MAPPING = r'@RequestMapping\(\s*(?:value\s*=\s*)?"([^"]*)"', r'@(Get|Post|Put|Delete|Patch)Mapping(?:\(\s*(?:value\s*=\s*)?(?:"([^"]*)")?[^)]*\))?'
SIGNATURE = r"(?:public|private|protected)\s+[\w<>,\s\[\]?]+\s+(\w+)\s*\("


def endpoints(lines: DataFrame) -> DataFrame:
    """keys, line, verb, route, method of the mappings of controller files: the class's route is carried forward, the method's
    name comes from the first signature before the next mapping."""
    keys = file_keys(lines)
    own = Window.partitionBy(*keys).orderBy("line")
    up, down = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    rows = lines.withColumn("base", F.last(F.nullif(F.regexp_extract("text", CLASS_MAPPING, 1), F.lit("")), ignorenulls=True).over(up))
    rows = rows.withColumn("verb", F.nullif(F.upper(F.regexp_extract("text", METHOD_MAPPING, 1)), F.lit("")))
    rows = rows.withColumn("block", F.count("verb").over(up)).withColumn("signature", F.nullif(F.regexp_extract("text", SIGNATURE, 1), F.lit("")))
    block = Window.partitionBy(*keys, "block").orderBy("line").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("method", F.first("signature", ignorenulls=True).over(block))
    route = F.concat(F.coalesce("base", F.lit("")), F.coalesce(F.nullif(F.regexp_extract("text", METHOD_MAPPING, 2), F.lit("")), F.lit("")))
    return rows.filter("verb is not null").select(*keys, "line", "verb", route.alias("route"), "method")


def versions(changes: DataFrame, keys: tuple[str, ...] = ("project_id", "doc_type"), order: str = "seq") -> DataFrame:
    """changes (keys, seq, action, forced) with version: generations of an edited document do not count unless forced."""
    own = Window.partitionBy(*keys).orderBy(order)
    edited = F.coalesce(F.max(F.when(F.col("action") == "EDIT", 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    accepted = changes.withColumn("accepted", (F.col("action") == "EDIT") | ~edited | F.col("forced"))
    return accepted.filter("accepted").withColumn("version", F.row_number().over(own)).drop("accepted")
