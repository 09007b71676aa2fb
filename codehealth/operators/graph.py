"""Call graphs: nodes (keys, node_key, name, node_type, file_path, line) and edges (keys, source, target). A graph belongs to a
project or, where tables have an analysis_id, to one analysis of it. Cycles: see operators/cycles.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codehealth.functions.keys import file_keys

#: Words in a name that tell its layer, first hit wins; calls between layers that break the rules.
LAYERS = {
    "CONTROLLER": ("controller", "view", "api"),
    "SERVICE": ("service",),
    "REPOSITORY": ("repository", "repos", "dao", "mapper", "store"),
    "ENTITY": ("entity", "model", "domain", "dto", "vo", "po", "schema"),
    "UTIL": ("util", "helper", "common", "support", "config"),
}
FORBIDDEN = (
    ("CONTROLLER", "REPOSITORY", "HIGH", "controller calls repository without a service"),
    ("CONTROLLER", "ENTITY", "MEDIUM", "controller uses an entity itself"),
    ("SERVICE", "ENTITY", "MEDIUM", "service uses an entity without a repository"),
)


def layer(name: Column, file_name: Column, layers: dict[str, tuple[str, ...]] = LAYERS) -> Column:
    text = F.lower(F.concat_ws(" ", name, file_name))
    return F.coalesce(*[F.when(text.rlike("|".join(words)), label) for label, words in layers.items()], F.lit("OTHER"))


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "_", "")


#: What tells graphs apart, as many of them as a table has.
GRAPH_KEYS = ("project_id", "analysis_id")


def graph_keys(df: DataFrame, key: str | None = None) -> list[str]:
    """The key columns of df: the one given, else those of GRAPH_KEYS that it has."""
    return [key] if key else [c for c in GRAPH_KEYS if c in df.columns]


def distinct_nodes(nodes: DataFrame, key: str | None = None) -> DataFrame:
    """The first row, by file and line, of each node key of a graph."""
    own = Window.partitionBy(*graph_keys(nodes, key), "node_key").orderBy("file_path", "line")
    return nodes.withColumn("__rank", F.row_number().over(own)).filter("__rank = 1").drop("__rank")


def distinct_edges(edges: DataFrame, key: str | None = None) -> DataFrame:
    return edges.select(*graph_keys(edges, key), "source", "target").distinct()


def resolved_calls(calls: DataFrame, nodes: DataFrame, key: str | None = None) -> DataFrame:
    """keys, source, target: calls (source, called) matched to nodes by normal name; of several the least key, never itself."""
    keys = graph_keys(nodes, key)
    named = nodes.groupBy(*keys, normal_name(F.col("name")).alias("n")).agg(F.min("node_key").alias("target"))
    return calls.withColumn("n", normal_name(F.col("called"))).join(named, [*keys, "n"]).filter("source <> target").select(*keys, "source", "target").distinct()


def violations(edges: DataFrame, nodes: DataFrame, rules=FORBIDDEN, key: str | None = None) -> DataFrame:
    """Edges between layers that a rule forbids, with severity and reason."""
    keys = graph_keys(edges, key)
    table = edges.sparkSession.createDataFrame(list(rules), "from_type string, to_type string, severity string, reason string")
    kind = nodes.select(*keys, "node_key", "node_type")
    rows = edges.join(kind.select(*keys, F.col("node_key").alias("source"), F.col("node_type").alias("from_type")), [*keys, "source"])
    rows = rows.join(kind.select(*keys, F.col("node_key").alias("target"), F.col("node_type").alias("to_type")), [*keys, "target"])
    return rows.join(F.broadcast(table), ["from_type", "to_type"]).select(*keys, "source", "target", "severity", "reason")


def without_dangling(edges: DataFrame, nodes: DataFrame, key: str | None = None) -> DataFrame:
    """Edges with both ends among the nodes."""
    keys = graph_keys(edges, key)
    known = nodes.select(*keys, "node_key").distinct()
    return edges.join(known.withColumnRenamed("node_key", "source"), [*keys, "source"], "left_semi").join(known.withColumnRenamed("node_key", "target"), [*keys, "target"], "left_semi")


def degrees(edges: DataFrame, nodes: DataFrame, key: str | None = None) -> DataFrame:
    """in_degree, out_degree, dep_count of every node, 0 if isolated."""
    keys = graph_keys(edges, key)
    outs = edges.groupBy(*keys, F.col("source").alias("node_key")).agg(F.count("*").alias("o"))
    ins = edges.groupBy(*keys, F.col("target").alias("node_key")).agg(F.count("*").alias("i"))
    rows = nodes.select(*keys, "node_key").join(outs, [*keys, "node_key"], "left").join(ins, [*keys, "node_key"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(*keys, "node_key", zero("i").alias("in_degree"), zero("o").alias("out_degree"), zero("o").alias("dep_count"))


def highlighted(edges: DataFrame, found: DataFrame, key: str | None = None) -> DataFrame:
    """edges with whether they are among the violations."""
    keys = graph_keys(edges, key)
    bad = found.select(*keys, "source", "target").distinct().withColumn("bad", F.lit(True))
    return edges.join(bad, [*keys, "source", "target"], "left").withColumn("violation", F.coalesce("bad", F.lit(False))).drop("bad")


#: Declarations by language: patterns with the name as group 2, the first that matches counts. Java: classes, inner ones
#: too; Go: the receiver's type owns its methods; the others: what stands at the left edge.
DECLARATIONS = {
    "java": (r"^\s*((?:public|private|protected|static|final|abstract|sealed)\s+)*class\s+(\w+)",),
    "py": (r"^(async\s+)?(?:def|class)\s+(\w+)",),
    "go": (r"^func\s+(\()\s*(?:\w+\s+)?\*?\s*(\w+)[^)]*\)", r"^func\s+()(\w+)\s*[\[(]"),
    "js": (r"^(export\s+(?:default\s+)?)?(?:async\s+)?(?:function\s*\*?|class|const|let|var)\s+(\w+)",),
    "ts": (r"^(export\s+(?:default\s+)?)?(?:async\s+)?(?:function\s*\*?|class|const|let|var)\s+(\w+)",),
}
#: A line at the left edge that is no declaration ends the owner, where blocks are told by indentation.
ENDS = {"py": r"^[^\s#@)\]}'\"]"}
#: A field with its type (groups 2 and 1), for languages where calls go through fields.
FIELDS = {"java": r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:private|protected|public|static|final)\s+)+(\w+)(?:<[^=;]*>)?\s+(\w+)\s*(?:=|;)"}
COMMENT = {"py": "#.*$"}
STRING = "\"[^\"]*\"|'[^']*'"
NO_CALLS = ("if", "for", "while", "switch", "catch", "return", "def", "func", "function", "class", "new")


def symbols_and_calls(lines: DataFrame, declarations: dict[str, str | tuple[str, ...]] = DECLARATIONS) -> tuple[DataFrame, DataFrame]:
    """nodes and calls (keys but path, source, called) from lines (keys, language, line, text). A line's owner is the last
    declaration above it; a call is a dotted name before a bracket, outside strings and comments, of which the root and the
    last part count. In Java the part before the last counts for the root, and a field of the file for its declared type.
    This reads line by line, with any table of patterns: a head or a string that goes over several lines is read by its first
    one. operators/symbols.py reads whole files of the five languages that it knows."""
    keys = file_keys(lines)
    own_keys = [c for c in keys if c != "path"]
    text, language = F.col("text"), F.col("language")
    patterns = [(k, x) for k, p in declarations.items() for x in ((p,) if isinstance(p, str) else p)]
    name = F.coalesce(*[F.when((language == k) & text.rlike(p), F.regexp_extract(text, p, 2)) for k, p in patterns])
    ended = F.coalesce(*[F.when((language == k) & text.rlike(p), F.lit("")) for k, p in ENDS.items()])
    comment = F.coalesce(*[F.when(language == k, F.lit(p)) for k, p in COMMENT.items()], F.lit("//.*$"))
    own = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("declared", name).withColumn("owner", F.nullif(F.last(F.coalesce("declared", ended), ignorenulls=True).over(own), F.lit("")))
    key = F.concat("path", F.lit("#"))
    nodes = rows.filter("declared is not null").select(*own_keys, F.concat(key, "declared").alias("node_key"), F.col("declared").alias("name"), layer(F.col("declared"), F.col("path")).alias("node_type"), F.col("path").alias("file_path"), "line")
    bare = F.regexp_replace(F.regexp_replace(text, F.lit(STRING), F.lit("S")), comment, F.lit(""))
    calls = rows.filter("owner is not null").select(*keys, "language", F.concat(key, "owner").alias("source"), "declared", F.explode(F.regexp_extract_all(bare, F.lit(r"([A-Za-z_][\w.]*)\s*\("), F.lit(1))).alias("dotted"))
    parts = F.split("dotted", r"\.")
    calls = calls.withColumn("leaf", F.element_at(parts, -1)).withColumn("root", F.when((language == "java") & (F.size(parts) > 2), F.get(parts, F.size(parts) - 2)).otherwise(F.get(parts, F.lit(0))))
    field = F.coalesce(*[F.when((language == k) & text.rlike(p), F.struct(F.regexp_extract(text, p, 2).alias("root"), F.regexp_extract(text, p, 1).alias("type"))) for k, p in FIELDS.items()])
    fields = lines.select(*keys, "line", field.alias("f")).filter("f is not null").groupBy(*keys, F.col("f.root").alias("root")).agg(F.max_by("f.type", "line").alias("type"))
    # a name of one part is a call, not a field
    typed = calls.join(fields, [*keys, "root"], "left").withColumn("root", F.when(F.size(F.split("dotted", r"\.")) == 2, F.coalesce("type", "root")).otherwise(F.col("root")))
    called = typed.select(*own_keys, "source", "declared", F.explode(F.array_distinct(F.array("root", "leaf"))).alias("called"))
    return distinct_nodes(nodes), called.filter((F.col("called") != "") & ~F.col("called").isin(*NO_CALLS) & ~F.col("called").eqNullSafe(F.col("declared"))).drop("declared").distinct()


#: Releases that are out of support. First rule in order wins: ecosystem, name, by prefix, version prefix,
#: latest, reason, risk.
EOL_RULES = (
    ("maven", "org.springframework.boot:spring-boot", True, "2.5.", "3.2+", "Spring Boot 2.5 is out of support", "HIGH"),
    ("maven", "org.springframework.boot:spring-boot", True, "2.6.", "3.2+", "Spring Boot 2.6 is out of support", "HIGH"),
    ("maven", "org.springframework.boot:spring-boot", True, "2.7.", "3.2+", "Spring Boot 2.7 is out of support", "HIGH"),
    ("maven", "org.springframework:spring-core", True, "5.3.", "6.x", "Spring 5.3 is out of support", "HIGH"),
    ("npm", "vue", False, "2.", "3.x", "Vue 2 is out of support", "HIGH"),
    ("npm", "react", False, "16.", "18+", "React 16 is out of support", "HIGH"),
    ("npm", "react", False, "17.", "18+", "React 17 is out of support", "HIGH"),
    ("npm", "node", False, "14.", "18+", "Node 14 is out of support", "HIGH"),
    ("npm", "node", False, "16.", "18+", "Node 16 is out of support", "HIGH"),
    ("npm", "node", False, "17.", "18+", "Node 17 is out of support", "HIGH"),
    ("pip", "python", False, "3.7", "3.10+", "Python 3.7 is out of support", "HIGH"),
    ("pip", "python", False, "3.8", "3.10+", "Python 3.8 is out of support", "HIGH"),
    ("pip", "django", False, "2.", "4.x", "Django 2 is out of support", "HIGH"),
)


def eol_matches(deps: DataFrame, rules=EOL_RULES) -> DataFrame:
    """deps (ecosystem, name, version) with latest, reason, risk_level of the first rule that matches; unknown stays null. The
    rules are a short literal, so there is no join."""
    hit = F.coalesce(
        *[
            F.when(
                (F.col("ecosystem") == eco) & (F.col("name").startswith(name) if prefix else F.col("name") == name) & F.col("version").startswith(version),
                F.struct(F.lit(latest).alias("latest"), F.lit(reason).alias("reason"), F.lit(risk).alias("risk_level")),
            )
            for eco, name, prefix, version, latest, reason, risk in rules
        ]
    )
    return deps.withColumn("__hit", hit).select(*deps.columns, "__hit.latest", "__hit.reason", "__hit.risk_level", F.col("__hit").isNotNull().alias("is_eol"))
