"""Manifests, exported tool results and commit logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def blocks(content: Column, tag: str) -> Column:
    """Inner texts of all <tag>…</tag>."""
    return F.regexp_extract_all(content, F.lit(rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>"), F.lit(1))


def inner(content: Column, tag: str) -> Column:
    return F.nullif(F.regexp_extract(content, rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1), F.lit(""))


def tag_blocks(files: DataFrame, tag: str, unique: str) -> DataFrame:
    """unique, pos, block of every block of a tag."""
    return files.select(unique, F.posexplode(blocks(F.col("content"), tag)).alias("pos", "block"))


def maven(manifests: DataFrame) -> DataFrame:
    """project_id, ecosystem, name, version of the pom.xml at each project's root: managed and parent versions do not count, a dependency without a
    version takes the project's, the first of equal names stays."""
    bare = F.regexp_replace(F.regexp_replace("content", r"(?s)<dependencyManagement>.*?</dependencyManagement>", ""), r"(?s)<parent>.*?</parent>", "")
    own = inner(F.regexp_replace(bare, r"(?s)<dependency>.*?</dependency>", ""), "version")
    rows = manifests.filter("path = 'pom.xml'").select("project_id", own.alias("own"), F.posexplode(blocks(bare, "dependency")).alias("pos", "b"))
    found = rows.select(
        "project_id", "pos", F.lit("maven").alias("ecosystem"), F.concat_ws(":", inner(F.col("b"), "groupId"), inner(F.col("b"), "artifactId")).alias("name"), F.coalesce(inner(F.col("b"), "version"), "own").alias("version")
    )
    return first_of(found, ["project_id", "name"], "pos").drop("pos")


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def npm_version(raw: Column) -> Column:
    """First number like 1.2.3; none for links."""
    link = raw.rlike(r"^(git\+|github:|file:|http:|https:)")
    return F.when(~link, F.nullif(F.regexp_extract(raw, r"(\d+(\.\d+)*)", 1), F.lit("")))


def npm(manifests: DataFrame) -> DataFrame:
    """project_id, ecosystem, name, version of the package.json at each project's root: dependencies before devDependencies."""
    rows = manifests.filter("path = 'package.json'")
    parsed = rows.select("project_id", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>").alias("j"))
    part = lambda k, name: parsed.select("project_id", F.lit(k).alias("rank"), F.explode(f"j.{name}").alias("name", "raw"))
    both = part(0, "dependencies").unionByName(part(1, "devDependencies"))
    return first_of(both, ["project_id", "name"], "rank").select("project_id", F.lit("npm").alias("ecosystem"), "name", npm_version(F.col("raw")).alias("version"))


def json_map(rows: DataFrame, unique: str, content: str) -> DataFrame:
    """unique, name, version of a column that holds a flat JSON object."""
    return rows.select(unique, F.explode(F.from_json(content, "map<string,string>")).alias("name", "raw")).select(unique, "name", npm_version(F.col("raw")).alias("version"))


COMMIT = "^@([0-9a-f]+)\t([^\t\n]*)\t([^\t\n]*)(\n|$)"
CHANGE = "^([0-9]+|-)\t([0-9]+|-)\t(.+)$"


def commit_log(logs: DataFrame, key: str = "project_id", parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """commits and files (see commits_of) of logs (key, content): a line `@hash<tab>author<tab>time`, then numstat lines. A log is
    cut before each such line, so a commit is a row of its own and nothing is put in order."""
    return commits_of(logs.select(key, F.explode(F.split("content", "(?m)(?=^@[0-9a-f]+\t[^\t\n]*\t[^\t\n]*$)")).alias("piece")), key, parts)


def read_commit_logs(spark: SparkSession, path: str, key: str = "project_id") -> DataFrame:
    """key, piece: the commits of exported logs, for commits_of. The key is that of a folder `key=value`, else the file's name without
    extension. A record ends where a line begins with the mark of a commit, so one large file is read by as many tasks as
    it has splits, and none holds more than a commit."""
    rows = spark.read.option("lineSep", "\n@").text(path)
    name = F.col(key) if key in rows.columns else F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "")
    return rows.select(name.alias(key), F.when(F.col("value").startswith("@"), F.col("value")).otherwise(F.concat(F.lit("@"), "value")).alias("piece"))


def commits_of(pieces: DataFrame, key: str = "project_id", parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """commits (key, commit_hash, author_name, committed_at, files_changed, added, removed) and files (key, commit_hash, path,
    added, removed) of pieces of logs (key, piece), a commit each. '-' counts as 0; what is no commit is left out.
    parts: into how many parts commits are dealt, where the number that the session shuffles into is too small for them."""
    pieces = pieces.filter(F.col("piece").rlike(COMMIT))
    part = lambda k: F.regexp_extract("piece", COMMIT, k)
    number = lambda line, k: F.coalesce(F.regexp_extract(line, CHANGE, k).try_cast("long"), F.lit(0))
    lines = F.filter(F.split("piece", "\n"), lambda x: x.rlike(CHANGE))
    each = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, CHANGE, 3).alias("path"), number(x, 1).alias("added"), number(x, 2).alias("removed")))
    rows = pieces.select(key, part(1).alias("commit_hash"), F.struct(part(2).alias("author_name"), F.try_to_timestamp(part(3)).alias("committed_at")).alias("head"), each.alias("changes"))
    files = rows.select(key, "commit_hash", F.inline("changes")).groupBy(key, "commit_hash", "path").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    # a commit's changes stand in its piece, so a piece is added up where it is read and a change is no row
    total = lambda c: F.aggregate(f"changes.{c}", F.lit(0).cast("long"), lambda x, y: x + y).alias(c)
    own = rows.select(key, "commit_hash", "head", F.array_distinct("changes.path").alias("paths"), total("added"), total("removed"))
    own = own.repartition(parts, key, "commit_hash") if parts else own
    # a hash that a log has several times: each piece with the changes of all
    same = own.groupBy(key, "commit_hash").agg(F.collect_list("head").alias("heads"), F.collect_set("paths").alias("paths"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    count = F.size(F.array_distinct(F.flatten("paths"))).cast("long").alias("files_changed")
    commits = same.select(key, "commit_hash", F.explode("heads").alias("head"), count, "added", "removed")
    return commits.select(key, "commit_hash", "head.author_name", "head.committed_at", "files_changed", "added", "removed"), files


#: Fields of an exported finding.
PAGE = "issues array<struct<key:string,rule:string,severity:string,component:string,line:string,message:string,type:string>>, __bad string"


def read_issue_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """findings (page, component, rule_key, severity, kind, line, message) of exported pages, one JSON object a file, and the pages that
    could not be read (page, reason, content): no JSON, no list of findings, or a finding without a rule."""
    pages = spark.read.schema(PAGE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(path)
    pages = pages.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("page"), "issues", "__bad")
    broken = F.filter("issues", lambda x: x.isNull() | (F.coalesce(x["rule"], F.lit("")) == ""))
    reason = F.when(F.col("__bad").isNotNull(), "no JSON object").when(F.col("issues").isNull(), "no list of findings").when(F.size(broken) > 0, F.format_string("%d findings without a rule", F.size(broken)))
    bad = pages.select("page", reason.alias("reason"), F.col("__bad").alias("content")).filter("reason is not null")
    rows = pages.filter("__bad is null").select("page", F.explode("issues").alias("i")).filter("i.rule <> ''")
    return rows.select("page", "i.component", F.col("i.rule").alias("rule_key"), "i.severity", F.col("i.type").alias("kind"), F.col("i.line").try_cast("int").alias("line"), "i.message"), bad


def imported_issues(issues: DataFrame) -> DataFrame:
    """Exported findings: the project prefix leaves the component; severity and kind have defaults."""
    return issues.withColumn("path", F.regexp_replace("component", "^[^:]*:", "")).withColumn("severity", F.coalesce("severity", F.lit("INFO"))).withColumn("kind", F.coalesce("kind", F.lit("CODE_SMELL")))


def imported_metrics(measures: DataFrame, metrics: list[str], key: str = "project_id") -> DataFrame:
    """One row per project with a column per metric: numbers rounded to 2, null if unreadable."""
    wide = measures.groupBy(key).pivot("metric", metrics).agg(F.max("value"))
    return wide.select(key, *[F.round(F.col(m).try_cast("double"), 2).alias(m) for m in metrics])


def unsafe_entry(name: Column) -> Column:
    """Whether an archive entry's name is empty, absolute, on a drive, climbs up or holds a NUL."""
    path = F.regexp_replace(name, r"\\", "/")
    return (path == "") | path.startswith("/") | path.rlike("^[A-Za-z]:") | F.array_contains(F.split(path, "/"), "..") | path.contains("\x00")


def upload_audit(entries: DataFrame, max_bytes: int = 500 << 20, max_files: int = 50_000, visible: tuple[str, ...] = (".github", ".gitignore")) -> DataFrame:
    """archive, entries, bytes, unsafe, hidden, ok of each upload (archive, name, size_bytes)."""
    hidden = F.exists(F.split("name", "/"), lambda x: x.startswith(".") & ~x.isin(*visible, "..", "."))
    out = entries.groupBy("archive").agg(F.count("*").alias("entries"), F.sum("size_bytes").cast("long").alias("bytes"), F.count_if(unsafe_entry(F.col("name"))).alias("unsafe"), F.count_if(hidden).alias("hidden"))
    return out.withColumn("ok", (F.col("unsafe") == 0) & (F.col("hidden") == 0) & (F.col("bytes") <= max_bytes) & (F.col("entries") <= max_files))
