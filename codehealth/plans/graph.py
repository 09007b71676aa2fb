"""Graph, manifest and sink queries: suppliers as nodes, successive line items of an order as edges."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codehealth.operators import graph as G
from codehealth.operators import retrieval as K
from codehealth.operators import symbols as Y
from codehealth.operators.cycles import cycles
from codehealth.operators.line_rules import lines_of
from codehealth.plans.registry import parts_for, query, spread, table
from codehealth.plans.source_code import CODE_LINES, KEYS, braces_sql, code_files, code_lines, indents_sql, q, same_file
from codehealth.sources import manifests as M
from codehealth.sources import snapshots as S


def work_folder(spark: SparkSession) -> str:
    """A fresh folder in spark.checkpoint.dir, which all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-work-", dir="/tmp")
    return f"{root.rstrip('/')}/plans-{uuid.uuid4().hex}"


#: Items by return flag as projects: three graphs over the same suppliers.
EDGES = "(select distinct a.l_returnflag as project_id, a.l_suppkey as source, b.l_suppkey as target from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1)"


def edges(spark, sf_dir) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    after = i.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("target"))
    return i.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_returnflag").alias("project_id"), F.col("l_suppkey").alias("source"), "target")


TYPE = "case s_nationkey % 4 when 0 then 'CONTROLLER' when 1 then 'SERVICE' when 2 then 'REPOSITORY' else 'ENTITY' end"
NODES = f"(select unnest(['A', 'N', 'R']) as project_id, s_suppkey node_key, s_name as name, {TYPE} node_type from supplier)"


def nodes(spark, sf_dir) -> DataFrame:
    flags = F.explode(F.array(*map(F.lit, "ANR"))).alias("project_id")
    return table(spark, sf_dir, "supplier").select(flags, F.col("s_suppkey").alias("node_key"), F.col("s_name").alias("name"), F.expr(TYPE).alias("node_type"), F.lit("f").alias("file_path"), F.lit(1).alias("line"))


WORDS = {"CONTROLLER": ("standard", "small"), "SERVICE": ("medium",), "ENTITY": ("economy", "large")}


@query("select p_partkey, case when regexp_matches(lower(p_name || ' ' || p_type), 'standard|small') then 'CONTROLLER' when regexp_matches(lower(p_name || ' ' || p_type), 'medium') then 'SERVICE' when regexp_matches(lower(p_name || ' ' || p_type), 'economy|large') then 'ENTITY' else 'OTHER' end as layer from part")
def g1_layers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", G.layer(F.col("p_name"), F.col("p_type"), WORDS).alias("layer"))


ALL_LINES = "(select path, line, text, case when regexp_matches(text, '^[A-Za-z]+ [a-z]+') then regexp_extract(text, '^([A-Za-z]+) [a-z]+', 1) end declared from (select source || '/' || doc_id path, unnest(string_split(text, chr(10))) text, generate_subscripts(string_split(text, chr(10)), 1) line, len(string_split(text, chr(10))) n from documents) where not (line = n and text = ''))"


@query(f"select path as file_path, declared as name, cast(min(line) as int) as line from {ALL_LINES} where declared is not null group by all")
def g2_symbols(spark, sf_dir):
    """Every line of every document."""
    d = spread(table(spark, sf_dir, "documents"))
    files = d.select(F.col("source").alias("project_id"), F.concat("source", F.lit("/"), "doc_id").alias("path"), F.lit("x").alias("language"), F.col("text").alias("content"))
    return G.symbols_and_calls(lines_of(files, "language"), {"x": "^()([A-Za-z]+) [a-z]+"})[0].select("file_path", "name", "line")


(JAVA,), (PY,) = G.DECLARATIONS["java"], G.DECLARATIONS["py"]
WRITTEN = f"""(select *, path like '%.py' py, case when path like '%.py' and regexp_matches(text, {q(PY)}) then regexp_extract(text, {q(PY)}, 2) when path like '%.java' and regexp_matches(text, {q(JAVA)}) then regexp_extract(text, {q(JAVA)}, 2) end declared,
  regexp_replace(regexp_replace(text, {q(G.STRING)}, 'S', 'g'), case when path like '%.py' then '#.*$' else '//.*$' end, '') bare from {CODE_LINES})"""


def code_symbols(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lines = code_lines(spark, sf_dir)
    return G.symbols_and_calls(lines.withColumn("language", F.when(F.col("path").endswith(".py"), "py").otherwise("java")))


@query(f"select project_id, path || '#' || declared as node_key, min(line) as line from {WRITTEN} where declared is not null group by all")
def g2_code_symbols(spark, sf_dir):
    return code_symbols(spark, sf_dir)[0].select("project_id", "node_key", "line")


@query(
    f"""with w as (select *, nullif(last_value(coalesce(declared, case when py and regexp_matches(text, {q(G.ENDS["py"])}) then '' end) ignore nulls) over (partition by {KEYS} order by line rows between unbounded preceding and current row), '') owner from {WRITTEN}),
    f as (select {KEYS}, regexp_extract(text, {q(G.FIELDS["java"])}, 2) root, max_by(regexp_extract(text, {q(G.FIELDS["java"])}, 1), line) t from {CODE_LINES} where path like '%.java' and regexp_matches(text, {q(G.FIELDS["java"])}) group by all),
    d as (select {KEYS}, py, owner, declared, string_split(unnest(regexp_extract_all(bare, '([A-Za-z_][\\w.]*)\\s*\\(', 1)), '.') p from w where owner is not null),
    r as (select *, case when not py and len(p) > 2 then p[-2] else p[1] end root from d),
    c as (select project_id, path || '#' || owner as source, declared, unnest([case when len(p) = 2 then coalesce(f.t, root) else root end, p[-1]]) called from r left join f using ({KEYS}, root))
    select distinct project_id, source, called from c where called <> '' and called not in ({", ".join(f"'{x}'" for x in G.NO_CALLS)}) and called is distinct from declared"""
)
def g2_code_calls(spark, sf_dir):
    return code_symbols(spark, sf_dir)[1].select("project_id", "source", "called")


#: Files of four languages with marks inside strings and comments, heads over several lines and blocks inside blocks.
LEXED = {
    "java": (
        "/* class No {{ x(); }} */",
        "@Service",
        '@Mapping("/{name}(b)")',
        "public class",
        "    A{key} extends Base<X> {{",
        "  private final Repo{size} repo;",
        "  Helper helper;",
        "  void a(int x) throws E {{",
        "    repo.load(1); // gone(1) \"",
        "    this.part.save(x);",
        '    String s = "no(1) // \\" {{";',
        '    String t = """',
        "      class T {{ q(); }}",
        '      """;',
        "    char c = '{{';",
        "    new Maker(2).run();",
        "    Thing z = new Thing();",
        "    a.b.c(helper.go());",
        "    if (x > {size}) {{ more(x); }}",
        "  }}",
        "  static class Inner{key} {{",
        "    int b() {{ return deep(1); }}",
        "  }}",
        "  void later() {{ class Local {{ }} after(); }}",
        "}}",
        "interface I {{ class Hidden {{ void h(); }} }}",
        "class Second{size} {{ }}",
    ),
    "py": (
        '"""class Doc:',
        "def no(): pass",
        '"""',
        "import os",
        "def f{key}(",
        "a,",
        "    b=first(),",
        "):",
        '    x = f"{{call(1)}} and {{y}}"',
        '    """ z(1) """',
        "    g(a)  # no(1) '",
        "    s = 'q(\"' + h.i.j({size})",
        "",
        "run(1)",
        "@deco",
        "def decorated():",
        "    lost()",
        "async def go{size}(): await k.m()",
        "class C{key}(Base):",
        '    @prop("{name}")',
        "    def m(self):",
        "        self.x.y('z(1)')",
        "    class D: pass",
    ),
    "go": (
        "package main",
        "// func No() {{}}",
        "func (s *S{key}) Get(id int) interface{{}} {{",
        "  s.repo.Find(id)",
        '  q := `raw func X() {{ "`',
        "  if check(q) {{",
        "  }}",
        "}}",
        "func (",
        "  T{size},",
        ") Put() {{",
        "}}",
        "var x = top()",
        "func main{key}() {{",
        "  func() {{ New(1) }}()",
        "}}",
    ),
    "ts": (
        "export default class A{key} {{",
        "  b(x: number): void {{ return c.d(); }}",
        "  e = () => first(1)",
        "}}",
        "export const e{size} = (",
        "  x,",
        ") =>",
        "  f(`a ${{g(x)}} {{ b`)",
        "run(1)",
        "const h = 1, i = j()",
        "function k({{ a }}: T): {{ b: number }} {{",
        "  /* const no = 1 */",
        "  return function inner() {{ l?.m(); }};",
        "}}",
        "  let n{key} = [1].map(o)",
        "abstract class Abs {{ p() {{}} }}",
        "async function",
        "  q() {{ await r(); }}",
    ),
}
#: What the languages' own grammars make of them: name, line, names called.
LEXED_SYMBOLS = {
    "java": (("A{key}", 2, "Repo{size} load part save Maker run b c Helper go more deep after"), ("Inner{key}", 21, "deep"), ("Second{size}", 27, "")),
    "py": (("f{key}", 5, "first call g h j"), ("go{size}", 18, "k m"), ("C{key}", 19, "prop self y")),
    "go": (("S{key}", 3, "s Find check"), ("T{size}", 9, ""), ("main{key}", 14, "New")),
    "ts": (("A{key}", 1, "c d first"), ("e{size}", 5, "f g"), ("h", 10, "j"), ("k", 11, "l m"), ("n{key}", 15, "map"), ("q", 17, "r")),
}


def lexed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = spread(table(spark, sf_dir, "part"))
    column = {"name": F.col("p_name"), "key": F.col("p_partkey").cast("string"), "size": F.col("p_size").cast("string")}
    path = F.concat(F.lit("src/m"), F.expr("p_partkey div 8"), F.lit("."))
    content, extension = F.lit(None).cast("string"), F.lit("")
    for k, (name, lines) in enumerate(LEXED.items()):
        parts = re.split(r"\{(name|key|size)\}", "\n".join(lines).replace("{{", "\x01").replace("}}", "\x02"))
        text = F.concat(*[column[x] if i % 2 else F.lit(x.replace("\x01", "{").replace("\x02", "}")) for i, x in enumerate(parts)])
        content, extension = (F.when(F.col("p_partkey") % len(LEXED) == k, x).otherwise(rest) for x, rest in ((text, content), (F.lit(name), extension)))
    project = F.concat(F.lit("k"), F.expr("p_partkey div 4 % 2"))
    return Y.symbols_and_calls_of(p.select(project.alias("project_id"), (F.col("p_partkey") % 3).alias("analysis_id"), F.concat(path, extension).alias("path"), content.alias("content")))


def _of_part(text: str) -> str:
    return "concat('', " + ", ".join({"key": "p_partkey", "size": "p_size"}[x] if i % 2 else q(x) for i, x in enumerate(re.split(r"\{(key|size)\}", text))) + ")"


def lexed_sql(columns: str) -> str:
    found = ", ".join(f"({k}, {q(name)}, {_of_part(symbol)}, {line}, {_of_part(called)})" for k, name in enumerate(LEXED) for symbol, line, called in LEXED_SYMBOLS[name])
    return f"""select {columns} from (select concat('k', p_partkey // 4 % 2) project_id, p_partkey % 3 analysis_id, concat('src/m', p_partkey // 8, '.', l.language, '#', l.symbol) node_key, l.symbol as name, cast(l.line as int) line, l.called words
      from part, lateral (values {found}) l(k, language, symbol, line, called) where p_partkey % {len(LEXED)} = l.k)"""


@query(lexed_sql("project_id, analysis_id, node_key, name, line"))
def g2_lexed_symbols(spark, sf_dir):
    return lexed(spark, sf_dir)[0].select("project_id", "analysis_id", "node_key", "name", "line")


@query("select distinct project_id, analysis_id, source, unnest(string_split(words, ' ')) as called from (" + lexed_sql("project_id, analysis_id, node_key as source, words") + ") where words <> ''")
def g2_lexed_calls(spark, sf_dir):
    return lexed(spark, sf_dir)[1].select("project_id", "analysis_id", "source", "called")


PY_SPANS = indents_sql(f"(select * from {CODE_LINES} where path like '%.py')", f"regexp_matches(text, {q(K.PY_SYMBOL)})")
JAVA_SPANS = braces_sql(f"(select * from {CODE_LINES} where path like '%.java')", f"regexp_matches(text, {q(K.JAVA_SYMBOL)})")


@query(
    f"""with a as (select * from {PY_SPANS} union all select * from {JAVA_SPANS}),
    s as (select * from a where not exists (select 1 from a o where {same_file("o", "a")} and o.start < a.start and o.end >= a.start)),
    p as (select {KEYS}, start k, start + 1 as start_line, s.end + 1 as end_line, max(case when line = start + 1 then coalesce(nullif(regexp_extract(text, {q(K.NAME)}, 1), ''), nullif(regexp_extract(text, {q(K.NAME)}, 2), '')) end) symbol, string_agg(text, chr(10) order by line) content
      from s join {CODE_LINES} using ({KEYS}) where line between start + 1 and s.end + 1 group by all
      union all select {KEYS}, 1000000, 1, max(n), null, string_agg(text, chr(10) order by line) filter (not exists (select 1 from s where {same_file("s", "l")} and l.line between s.start + 1 and s.end + 1)) from (select *, max(line) over (partition by {KEYS}) n from {CODE_LINES}) l group by {KEYS})
    select {KEYS}, cast(row_number() over (partition by {KEYS} order by k) - 1 as int) as chunk_index, symbol, cast(start_line as int) as start_line, cast(end_line as int) as end_line, md5(content) as digest from p where regexp_matches(content, '[^\\s]')"""
)
def k1_source_chunks(spark, sf_dir):
    """Chunks of symbols and of what is left of the module; the files are too short for windows."""
    return K.source_chunks(code_files(spark, sf_dir)).select("project_id", "analysis_id", "path", "chunk_index", "symbol", "start_line", "end_line", F.md5("content").alias("digest"))


@query(f"select * from {EDGES}")
def g3_distinct_edges(spark, sf_dir):
    return G.distinct_edges(edges(spark, sf_dir))


@query(
    f"""with recursive e as (select * from {EDGES}), r(p, a, b) as (select project_id, source, target from e union select r.p, r.a, e.target from r join e on r.p = e.project_id and r.b = e.source),
    m as (select x.p, x.a, least(x.a, min(x.b)) root from r x join r y on x.p = y.p and x.a = y.b and x.b = y.a where x.a <> x.b group by x.p, x.a)
    select p as project_id, array_to_string(list(a order by a), ',') as members, min(a) as source, max(a) as target, 'MAJOR' as severity from m group by p, root
    union all select project_id, cast(source as varchar), source, source, 'MAJOR' from e where source = target"""
)
def g4_cycles(spark, sf_dir):
    found = cycles(edges(spark, sf_dir), work_folder(spark))
    return found.select("project_id", F.array_join("members", ",").alias("members"), "source", "target", "severity")


#: Line items point from their part to a later one of the same order, in eleven projects by part: many small components.
LINKS_OF = "(select distinct a.l_partkey % 11 as project_id, a.l_partkey as source, b.l_partkey as target from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_partkey % 11 = b.l_partkey % 11)"


@query(
    f"""with recursive e as (select * from {LINKS_OF}), r(p, a, b) as (select project_id, source, target from e union select r.p, r.a, e.target from r join e on r.p = e.project_id and r.b = e.source),
    m as (select x.p, x.a, least(x.a, min(x.b)) root from r x join r y on x.p = y.p and x.a = y.b and x.b = y.a where x.a <> x.b group by x.p, x.a)
    select p as project_id, array_to_string(list(a order by a), ',') as members, min(a) as source, max(a) as target from m group by p, root union all select project_id, cast(source as varchar), source, source from e where source = target"""
)
def g4_part_cycles(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    after = i.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("target"))
    own = i.join(after, ["l_orderkey", "l_linenumber"]).filter("l_partkey % 11 = target % 11").select((F.col("l_partkey") % 11).alias("project_id"), F.col("l_partkey").alias("source"), "target")
    found = cycles(own, work_folder(spark))
    return found.select("project_id", F.array_join("members", ",").alias("members"), "source", "target")


@query(f"select project_id, analysis_id, node_key, least(count(distinct source), 1) as calls from (select n.project_id, a analysis_id, node_key from {NODES} n, range(3) r(a)) left join (select project_id, source % 3 analysis_id, source, source node_key from {EDGES}) using (project_id, analysis_id, node_key) group by all")
def g3_nodes_of_analyses(spark, sf_dir):
    """Nodes of several analyses of a project that share keys and paths, each with whether it has calls of its own analysis."""
    n = nodes(spark, sf_dir).withColumn("analysis_id", F.explode(F.array(*map(F.lit, range(3)))))
    own = edges(spark, sf_dir).withColumn("analysis_id", (F.col("source") % 3).cast("int"))
    found = G.degrees(G.distinct_edges(own), G.distinct_nodes(n.unionByName(n)))
    return found.select("project_id", "analysis_id", "node_key", F.least("out_degree", F.lit(1)).alias("calls"))


@query("with n as (select regexp_replace(lower(p_brand), '#', '') n, min(p_partkey) target from part group by 1) select distinct p_partkey as source, target from part join n on regexp_replace(lower(p_brand), '#', '') = n where p_partkey <> target")
def j4_resolved_calls(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.lit("p").alias("project_id"), F.col("p_partkey").alias("node_key"), F.regexp_replace("p_brand", "#", "_").alias("name"))
    calls = p.select("project_id", F.col("node_key").alias("source"), F.upper("name").alias("called"))
    return G.resolved_calls(calls, p).select("source", "target")


VIOLATIONS = f"(select e.project_id, e.source, e.target, r.severity from {EDGES} e join {NODES} a on a.project_id = e.project_id and a.node_key = e.source join {NODES} b on b.project_id = e.project_id and b.node_key = e.target join (values ('CONTROLLER', 'REPOSITORY', 'HIGH'), ('CONTROLLER', 'ENTITY', 'MEDIUM'), ('SERVICE', 'ENTITY', 'MEDIUM')) r(f, t, severity) on a.node_type = r.f and b.node_type = r.t)"


def violations(spark, sf_dir) -> DataFrame:
    return G.violations(G.distinct_edges(edges(spark, sf_dir)), nodes(spark, sf_dir))


@query(f"select * from {VIOLATIONS}")
def j5_layer_violations(spark, sf_dir):
    return violations(spark, sf_dir).select("project_id", "source", "target", "severity")


@query("select p_partkey as id, case when p_type like 'STANDARD%' and p_brand like 'Brand#1%' then 'first' when p_type = 'ECONOMY BRASS' and p_brand like 'Brand#2%' then 'second' when p_type like 'STANDARD%' and p_brand like 'Brand#%' then 'third' end as latest from part")
def j6_eol_rules(spark, sf_dir):
    deps = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("x").alias("ecosystem"), F.col("p_type").alias("name"), F.col("p_brand").alias("version"))
    rules = (("x", "STANDARD", True, "Brand#1", "first", "", "HIGH"), ("x", "ECONOMY BRASS", False, "Brand#2", "second", "", "HIGH"), ("x", "STANDARD", True, "Brand#", "third", "", "MEDIUM"))
    return G.eol_matches(deps, rules).select("id", "latest")


@query(f"select * from {EDGES} where source % 5 <> 0 and target % 5 <> 0")
def j8_dangling_edges(spark, sf_dir):
    return G.without_dangling(G.distinct_edges(edges(spark, sf_dir)), nodes(spark, sf_dir).filter("node_key % 5 <> 0"))


@query(f"select e.*, v.severity is not null as violation from {EDGES} e left join {VIOLATIONS} v using (project_id, source, target)")
def j10_highlighted(spark, sf_dir):
    e = G.distinct_edges(edges(spark, sf_dir))
    return G.highlighted(e, violations(spark, sf_dir)).select("project_id", "source", "target", "violation")


@query(
    f"""with e as (select * from {EDGES}), i as (select project_id, target k, count(*) n from e group by all), o as (select project_id, source k, count(*) n from e group by all)
    select p.project_id, p.node_key, coalesce(i.n, 0) as in_degree, coalesce(o.n, 0) as out_degree, coalesce(o.n, 0) as dep_count from {NODES} p left join i on i.project_id = p.project_id and i.k = p.node_key left join o on o.project_id = p.project_id and o.k = p.node_key"""
)
def a4_degrees(spark, sf_dir):
    return G.degrees(G.distinct_edges(edges(spark, sf_dir)), nodes(spark, sf_dir))


# --- manifests -------------------------------------------------------------------------------------------------------


@query("select page_id, cast(unnest(generate_series(0, len(regexp_extract_all(html, '<p>\\s*((?s).*?)\\s*</p>', 1)) - 1)) as int) as pos, unnest(regexp_extract_all(html, '<p>\\s*((?s).*?)\\s*</p>', 1)) as block from pages")
def s3_tag_blocks(spark, sf_dir):
    return M.tag_blocks(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content")), "p", "page_id")


@query(
    """select o_custkey as project_id, 'maven' as ecosystem, 'g:a' || o_orderkey % 9 as name, case when bool_or(o_orderkey % 2 = 1) then '9.0' else '1.' || min(o_orderkey % 5) end as version
    from orders group by o_custkey, o_orderkey % 9"""
)
def s3_maven(spark, sf_dir):
    """Each customer's orders as a pom."""
    o = table(spark, sf_dir, "orders")
    dep = F.format_string("<dependency><groupId>g</groupId><artifactId>a%d</artifactId>%s</dependency>", F.col("o_orderkey") % 9, F.when(F.col("o_orderkey") % 2 == 0, F.format_string("<version>1.%d</version>", F.col("o_orderkey") % 5)).otherwise(""))
    poms = o.groupBy(F.col("o_custkey").alias("project_id")).agg(F.concat(F.lit("<project><version>9.0</version>"), F.array_join(F.array_sort(F.collect_list(dep)), ""), F.lit("</project>")).alias("content"))
    return M.maven(poms.withColumn("path", F.lit("pom.xml")))


@query("select event_id, unnest(json_keys(props)) as name, nullif(regexp_extract(json_extract_string(props, '$.' || unnest(json_keys(props))), '([0-9]+([.][0-9]+)*)', 1), '') as version from events")
def s4_json_map(spark, sf_dir):
    return M.json_map(table(spark, sf_dir, "events"), "event_id", "props")


@query("select l_orderkey as commit_hash, count(distinct l_partkey) as files_changed, cast(sum(cast(l_quantity as bigint)) as bigint) as added, cast(sum(case when l_linenumber = 1 then 0 else l_linenumber end) as bigint) as removed from lineitem group by 1")
def s5_commit_log(spark, sf_dir):
    """Line items as logs of about a thousand orders each, so their number follows the table and their size does not."""
    i = table(spark, sf_dir, "lineitem")
    n = i.count()
    logs, parts = max(1, n // 4_000), parts_for(spark, n)
    change = F.concat_ws("\t", F.col("l_quantity").cast("long").cast("string"), F.when(F.col("l_linenumber") == 1, F.lit("-")).otherwise(F.col("l_linenumber").cast("string")), F.concat(F.lit("p"), "l_partkey"))
    entry = i.select("l_orderkey", change.alias("change")).repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.collect_list("change"), "\n").alias("changes"))
    head = F.concat(F.lit("@"), F.lower(F.hex("l_orderkey")), F.lit("\tann\t2024-01-01 00:00:00\n"), F.col("changes"))
    entry = entry.select(F.pmod(F.xxhash64("l_orderkey"), F.lit(logs)).alias("project_id"), head.alias("entry")).repartition(parts, "project_id")
    texts = entry.groupBy("project_id").agg(F.array_join(F.collect_list("entry"), "\n").alias("content"))
    commits, _ = M.commit_log(texts, parts=parts)
    return commits.select(F.conv("commit_hash", 16, 10).cast("long").alias("commit_hash"), "files_changed", "added", "removed")


@query("select concat('log', l_orderkey % 3) as project_id, l_orderkey as commit_hash, count(distinct l_partkey) as files_changed, cast(sum(cast(l_quantity as bigint)) as bigint) as added from lineitem group by all")
def s5_read_logs(spark, sf_dir):
    """Logs of three projects as text files, cut by the mark of a commit."""
    i, folder = table(spark, sf_dir, "lineitem"), work_folder(spark)
    change = F.concat_ws("\t", F.col("l_quantity").cast("long").cast("string"), F.lit("-"), F.concat(F.lit("p"), "l_partkey"))
    parts = parts_for(spark, i.count())
    entry = i.select("l_orderkey", change.alias("change")).repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.collect_list("change"), "\n").alias("changes"))
    text = entry.select(F.concat(F.lit("@"), F.lower(F.hex("l_orderkey")), F.lit("\tann\t2024-01-01 00:00:00\n"), F.col("changes")).alias("value"), F.concat(F.lit("log"), F.col("l_orderkey") % 3).alias("project_id"))
    text.write.partitionBy("project_id").text(f"{folder}/logs")
    commits, _ = M.commits_of(M.read_commit_logs(spark, f"{folder}/logs"), parts=parts)
    return commits.select("project_id", F.conv("commit_hash", 16, 10).cast("long").alias("commit_hash"), "files_changed", "added")


@query(
    """with e as (select event_id, user_id, event_id // 50 page, event_id // 50 % 7 k from events)
    select 'finding' as kind, concat('c', user_id) as path, case when event_id % 3 = 0 then 'INFO' else 'MAJOR' end as detail, count(*) as n from e where k not in (1, 2) and (k <> 3 or event_id % 50 <> 7) group by all
    union all select 'page', null, case k when 1 then 'no JSON object' when 2 then 'no list of findings' else '1 findings without a rule' end, count(distinct page) from e where k in (1, 2) or k = 3 and event_id % 50 = 7 group by all"""
)
def s7_read_pages(spark, sf_dir):
    """Exported pages as JSON files, some cut off, some without a list, some with a finding that has no rule."""
    e, folder = table(spark, sf_dir, "events"), work_folder(spark)
    page, kind = F.floor(F.col("event_id") / 50), F.floor(F.col("event_id") / 50) % 7
    issue = F.struct(
        F.concat(F.lit("k"), "event_id").alias("key"), F.when((kind != 3) | (F.col("event_id") % 50 != 7), F.lit("java:S1")).alias("rule"), F.when(F.col("event_id") % 3 != 0, "MAJOR").alias("severity"),
        F.concat(F.lit("proj:c"), "user_id").alias("component"), (F.col("event_id") % 9 + 1).cast("string").alias("line"), F.lit("m").alias("message"), F.lit("BUG").alias("type"),
    )
    pages = e.groupBy(page.alias("page"), kind.alias("kind")).agg(F.to_json(F.struct(F.collect_list(issue).alias("issues"))).alias("json"))
    text = F.when(F.col("kind") == 1, F.expr("left(json, length(json) - 5)")).when(F.col("kind") == 2, '{"errors": []}').otherwise(F.col("json"))
    # a file each, in one folder; tasks move their own into place
    spread(pages.select(text.alias("value"))).write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(f"{folder}/pages")
    found, bad = M.read_issue_pages(spark, f"{folder}/pages")
    issues = M.imported_issues(found).select(F.lit("finding").alias("kind"), "path", F.col("severity").alias("detail"))
    return issues.unionByName(bad.select(F.lit("page").alias("kind"), F.lit(None).cast("string").alias("path"), F.col("reason").alias("detail"))).groupBy("kind", "path", "detail").agg(F.count("*").alias("n"))


@query("select event_id as id, concat('c', user_id) as path, case when event_id % 3 = 0 then 'INFO' else 'MAJOR' end as severity, case when event_id % 4 = 0 then 'CODE_SMELL' else 'BUG' end as kind from events")
def s7_imported_issues(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("id"), F.concat(F.lit("proj:c"), "user_id").alias("component"), F.when(F.col("event_id") % 3 != 0, "MAJOR").alias("severity"), F.when(F.col("event_id") % 4 != 0, "BUG").alias("kind"))
    return M.imported_issues(rows).select("id", "path", "severity", "kind")


@query("select user_id as project_id, round(max(value) filter (event_type = 'click'), 2) as click, round(max(value) filter (event_type = 'view'), 2) as view from events group by 1")
def s8_imported_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("event_type").alias("metric"), F.format_string("%020.10f", "value").alias("value"))
    return M.imported_metrics(e, ["click", "view"])


@query(
    """select o_orderstatus as status, cast(year(o_orderdate) as int) as analysis_id, case when year(o_orderdate) > 1994 then 'new' else 'old' end as v, count(*) as n from orders
    where not (o_orderstatus = 'F' and year(o_orderdate) = 1993) group by all"""
)
def s9_replace_snapshot(spark, sf_dir):
    """Written, written again in part with one key cleared, and that again: no copies, and other keys stay."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("project_id"), F.year("o_orderdate").alias("analysis_id"), "o_orderkey", F.lit("old").alias("v"))
    path = f"{work_folder(spark)}/snapshot"
    S.replace_snapshot(rows, path, rows)
    later, cleared = rows.filter("analysis_id > 1994").withColumn("v", F.lit("new")), rows.filter("project_id = 'F' and analysis_id = 1993")
    for _ in range(2):
        S.replace_snapshot(later, path, later.unionByName(cleared))
    return S.snapshot(spark, path).groupBy(F.col("project_id").alias("status"), F.col("analysis_id").cast("int").alias("analysis_id"), "v").agg(F.count("*").alias("n"))


@query("select source as project_id, count(*) as chunks, cast(sum(length(text)) as bigint) as chars from documents where source <> 'src2' and (source <> 'src1' or doc_id % 2 = 0) group by 1")
def k7_rebuilt_index(spark, sf_dir):
    """An index of all projects; then one is rebuilt with fewer chunks and one with none."""
    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.col("source").alias("project_id"), F.lit("f").alias("file"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("content"))
    path = f"{work_folder(spark)}/index"
    S.rebuild_index(chunks, path, chunks)
    S.rebuild_index(chunks.filter("project_id = 'src1' and chunk_index % 2 = 0"), path, chunks.filter("project_id in ('src1', 'src2')"))
    return S.snapshot(spark, path, ("project_id",)).groupBy("project_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))


@query(
    """select o_custkey as project_id, o_orderkey as analysis_id, v from (select o_custkey, o_orderkey, 'old' v from orders where o_custkey % 3 <> 1 and not (o_custkey % 3 = 2 and o_orderkey % 2 = 0)
    union all select o_custkey, o_orderkey, 'new' from orders where o_custkey % 3 = 2 and o_orderkey % 2 = 0)"""
)
def s10_refreshed(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("analysis_id"))
    action = F.when(F.col("project_id") % 3 == 1, "clear").when((F.col("project_id") % 3 == 2) & (F.col("analysis_id") % 2 == 0), "replace").otherwise("keep")
    return S.refreshed(rows.withColumn("v", F.lit("old")), rows.withColumn("v", F.lit("new")), rows.withColumn("action", action))


@query("select user_id as project_id, event_id as id, case when user_id % 2 = 0 then 'SONAR' else 'OLD' end as source, case when user_id % 2 = 0 then 'INFO' else 'MINOR' end as severity from events where user_id % 10 <> 7")
def s11_replaced_issues(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("id"), F.lit(" ").alias("suggestion"))
    old = e.withColumns({"source": F.lit("OLD"), "severity": F.lit("MINOR"), "kind": F.lit("BUG")})
    none = F.lit(None).cast("string")
    new = e.filter("project_id % 2 = 0").withColumns({"source": none, "severity": none, "kind": none})
    refreshed = e.filter("project_id % 2 = 0 or project_id % 10 = 7").select("project_id")  # the latter have no issues any more
    return S.replaced_issues(old, new, refreshed).select("project_id", "id", "source", "severity")


@query("select user_id as analysis_id, cast(floor(cast(json_extract_string(arg_max(props, event_id), '$.k') as double)) as int) as health_score from events group by 1")
def s12_report_columns(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("analysis_id"), F.col("event_id").alias("seq"), F.regexp_replace("props", '"k"', '"healthScore"').alias("report_json"))
    return S.report_columns(e).select("analysis_id", "health_score")


@query("select event_id as analysis_id, cast(round(cast(json_extract_string(props, '$.k') as double)) as int) as health_score from events where event_id % 3 <> 0")
def s13_backfilled(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("analysis_id"), F.regexp_replace("props", '"k"', '"healthScore"').alias("report_json"))
    return S.backfilled(e, e.filter("analysis_id % 3 = 0").select("analysis_id"))


@query(
    """select o_custkey as project_id, concat_ws(chr(10), '# Health ' || arg_max(cast(floor(o_totalprice) as bigint) % 101, o_orderkey), '| dimension | score |', '| --- | --- |', '| quality | ' || max(o_orderkey) % 100 || ' |',
    '## Risks', arg_max(case when o_orderstatus = 'F' then '!! ' else '- ' end || o_orderpriority, o_orderkey), '## Next', '1. go on') as markdown from orders group by 1"""
)
def s14_markdown(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    reports = o.select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("id"), (F.floor("o_totalprice") % 101).cast("int").alias("health_score"),
        F.array(F.struct(F.lit("quality").alias("key"), (F.col("o_orderkey") % 100).alias("score"))).alias("dimensions"),
        F.array(F.struct(F.when(F.col("o_orderstatus") == "F", "HIGH").otherwise("LOW").alias("level"), F.col("o_orderpriority").alias("title"))).alias("risks"),
        F.array(F.lit("go on")).alias("recommendations"),
    )
    return S.markdown(reports)


@query(
    """with e as (select split_part(regexp_replace(url, '^https?://', ''), '/', 1) archive, case when page_id % 50 = 0 then '../x' when page_id % 49 = 0 then '/abs' when page_id % 47 = 0 then 'a/.hid' else url end as name, length(html) n, page_id from pages)
    select archive, count(*) as entries, cast(sum(n) as bigint) as bytes, count(*) filter (page_id % 50 = 0 or page_id % 49 = 0) as unsafe, count(*) filter (name = 'a/.hid') as hidden,
    count(*) filter (name in ('../x', '/abs', 'a/.hid')) = 0 and sum(n) <= 40000 as ok from e group by 1"""
)
def s15_upload_audit(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    name = F.when(F.col("page_id") % 50 == 0, "../x").when(F.col("page_id") % 49 == 0, "/abs").when(F.col("page_id") % 47 == 0, "a/.hid").otherwise(F.col("url"))
    rows = p.select(F.split_part(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit(1)).alias("archive"), name.alias("name"), F.length("html").alias("size_bytes"))
    return M.upload_audit(rows, 40_000)


LINKS = "(select page_id, unnest(string_split(html, chr(10))) text, generate_subscripts(string_split(html, chr(10)), 1) line from pages)"


@query(
    f"""select page_id, line, heading, link from (select page_id, cast(line as int) line, regexp_extract(text, 'href="([^"]*)"', 1) link,
    last_value(nullif(regexp_extract(text, '<title>([^<]*)', 1), '') ignore nulls) over (partition by page_id order by line) heading from {LINKS}) where link <> ''"""
)
def w7_endpoints(spark, sf_dir):
    from codehealth.operators.documents import carried

    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("content"))
    found = carried(lines_of(pages), "<title>([^<]*)", 'href="([^"]*)"')
    return found.select(F.col("path").alias("page_id"), "line", F.col("prefix").alias("heading"), F.col("value").alias("link"))
