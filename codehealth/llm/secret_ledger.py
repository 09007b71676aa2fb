"""Secret scans over all historical versions, incremental, in DataFrame functions only.

Every version of a file is content-addressed: its blob id is the SHA-256 of its text. The ledger is a table of the
(blob, rule, rule version) pairs that have been scanned, with what was found. A run (`scan_into`) scans each unseen pair
once, on one copy of the blob, appends the pairs to the ledger and joins the findings back to every path that holds the
blob. A rule of a new version is scanned anew, alone.

Offsets count code points, ends are exclusive. Null text: as the empty text, which has no finding. Repeated
rows: each gets its row. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codehealth.llm.shared import fresh_path, saved


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    #: A match whose `group` is shorter than this is dropped after the scan.
    group: int
    at_least: int
    #: Every match holds this: texts without it are not searched.
    mark: str = ""


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(any_case, ("password", "passwd", "secret", "token"))) + f"|{any_case('api')}_?{any_case('key')})" + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"

#: Public formats of credentials. In this order at equal starts.
BASE_RULES = (
    Rule("assign", 1, ASSIGN, 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", 1, "[0-9a-f]{24,}", 0, 24),
)
ADDED_RULES = (
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "PRIVATE KEY-----"),
    Rule("jwt", 1, "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 20, ".eyJ"),
    Rule("forge", 1, "gh[opsur]_[A-Za-z0-9]{36,}", 0, 40, "gh"),
    Rule("chat", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, "xox"),
    Rule("url", 1, "[a-z][a-z0-9+.-]*://[^/:@\\x20\\x09-\\x0D]+:[^/:@\\x20\\x09-\\x0D]+@", 0, 8, "://"),
)
RULES = BASE_RULES + ADDED_RULES

_SPANS = "array<struct<at:int,to:int>>"
FOUND = "array<struct<kind:string,rank:int,version:int,at:int,to:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """Start and end of the rule's leftmost non-overlapping matches. The text between matches and the matches
    themselves, both in order, give the places: no position function is needed."""
    between = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.char_length)
    part = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.char_length)
    walked = F.aggregate(
        F.arrays_zip(between.alias("gap"), whole.alias("size"), part.alias("part")),
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(
                x["part"] >= rule.at_least,
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("at"), (acc["at"] + x["gap"] + x["size"]).alias("to")))),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.contains(text, F.lit(rule.mark)) & text.rlike(rule.pattern), walked).otherwise(F.array().cast(_SPANS))


def named(rule: Rule, rank: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(rule.kind).alias("kind"), F.lit(rank).alias("rank"), F.lit(rule.version).alias("version"), x["at"].alias("at"), x["to"].alias("to"))


def versions_of(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """path, blob of every version."""
    return files.select(files[path_col].alias("path"), F.sha2(F.coalesce(files[text_col].cast("string"), F.lit("")), 256).alias("blob"))


def unseen(versions: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame) -> DataFrame:
    """path, pending: one path of each blob with unseen pairs, and the rules to scan it with."""
    one = versions.groupBy("blob").agg(F.min("path").alias("path"))
    every = F.array(*[F.lit(f"{r.kind}/{r.version}") for r in rules])
    seen = ledger.join(one.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("seen"))  # a list per run
    left = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return one.join(seen, "blob", "left").select("blob", "path", left.alias("pending")).filter(F.size("pending") > 0)


def scan(files: DataFrame, pending: DataFrame, rules: tuple[Rule, ...], path_col: str, text_col: str) -> DataFrame:
    """blob, pending, found (array of kind, rank, version, at, to) of each blob to scan. Text crosses one shuffle, and
    only paths are keys, which are spread evenly however often a blob is copied."""
    text = F.coalesce(files[text_col].cast("string"), F.lit(""))
    # of rows with the same path and the same text one is enough
    rows = files.select(files[path_col].alias("path"), text.alias("text")).join(
        pending.withColumnRenamed("path", "one"), F.col("path").eqNullSafe(F.col("one"))
    ).filter(F.sha2("text", 256) == F.col("blob"))
    found = F.flatten(
        F.array(
            *[
                F.when(
                    F.array_contains("pending", f"{r.kind}/{r.version}"),
                    F.transform(spans(F.col("text"), r), named(r, k)),
                ).otherwise(F.array().cast(FOUND))
                for k, r in enumerate(rules)
            ]
        )
    )
    return rows.select("blob", "pending", found.alias("found"))


LEDGER = f"blob string, pairs array<string>, found {FOUND}"


def new_ledger(spark: SparkSession, path: str) -> str:
    """An empty ledger at path."""
    spark.createDataFrame([], LEDGER).write.parquet(path)
    return path


def scan_into(files: DataFrame, ledger_path: str, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, found (sorted by start, then rule order) of every version. What the ledger has not seen yet is scanned and
    appended to it first, in one pass over the texts."""
    spark = files.sparkSession
    versions = versions_of(files, path_col, text_col)
    # as a table, so that its rules are data: were they literals, Spark would scan every copy of a blob below the join
    pending = saved(unseen(versions, rules, spark.read.schema(LEDGER).parquet(ledger_path)), "pending")
    scanned = scan(files, pending, rules, path_col, text_col)
    scanned.select("blob", F.col("pending").alias("pairs"), "found").write.mode("append").parquet(ledger_path)
    return located(versions, spark.read.schema(LEDGER).parquet(ledger_path), rules)


def located(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """path, found of every version: what the ledger has for these versions of the rules. Of the ledger only the blobs of these
    versions are taken up."""
    current = F.concat_ws("/", "f.kind", "f.version").isin([f"{r.kind}/{r.version}" for r in rules])
    own = ledger.filter(F.size("found") > 0).join(versions.select("blob").distinct(), "blob", "left_semi")
    each = own.select("blob", F.explode("found").alias("f")).filter(current).groupBy("blob").agg(F.collect_set("f").alias("found"))
    ordered = F.array_sort("found", lambda a, b: F.when(a["at"] != b["at"], a["at"] - b["at"]).otherwise(a["rank"] - b["rank"]))
    return versions.join(each.select("blob", ordered.alias("found")), "blob", "left").select(
        "path", F.coalesce("found", F.array().cast(FOUND)).alias("found")
    )


def secret_report(files: DataFrame, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """scan_into with a ledger of its own."""
    spark = files.sparkSession
    return scan_into(files, new_ledger(spark, fresh_path(spark, "ledger")), path_col, text_col, rules)


def digest(found: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans in order, comma-joined."""
    rows = F.filter(found, lambda x: x["kind"].isin(*kinds)) if kinds else found
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["at"].cast("string"), x["to"].cast("string"))), ",")
