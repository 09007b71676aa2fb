"""Source-tree and rule queries: documents as files of a project (source), pages as files with markup."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.functions import text as T
from codehealth.operators import code_blocks as B
from codehealth.operators import line_rules as R
from codehealth.operators import scanners
from codehealth.operators.issues import every_finding
from codehealth.plans.registry import query, spread, table
from codehealth.sources import inventory as I


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: Three analyses of each project have files of the same names, and so have all projects.
KEYS = "project_id, analysis_id, path"


def files(spark, sf_dir) -> DataFrame:
    """Documents as files of a project (source) and one of its analyses; paths repeat among both."""
    d = spread(table(spark, sf_dir, "documents"))
    path = F.concat(F.lit("src/f"), F.expr("doc_id div 3"), F.lit("."), "lang")
    return d.select(F.col("source").alias("project_id"), (F.col("doc_id") % 3).alias("analysis_id"), path.alias("path"), F.col("text").alias("content"), "doc_id")


FILES = "(select source project_id, doc_id % 3 analysis_id, concat('src/f', doc_id // 3, '.', lang) path, text as content, doc_id from documents)"


def lines_sql(files: str) -> str:
    split = "string_split(content, chr(10))"
    return f"(select {KEYS}, cast(line as int) line, text from (select {KEYS}, unnest({split}) text, generate_subscripts({split}, 1) line, len({split}) n from {files}) where not (line = n and text = ''))"


LINES = lines_sql(FILES)


def doc_lines(spark, sf_dir) -> DataFrame:
    return R.lines_of(files(spark, sf_dir))


def pages(spark, sf_dir) -> DataFrame:
    """Pages as files of four projects; paths repeat among these."""
    path = F.concat(F.lit("web/p"), F.expr("page_id div 4"), F.lit(".html"))
    p = spread(table(spark, sf_dir, "pages"))
    return p.select(F.concat(F.lit("site"), F.col("page_id") % 4).alias("project_id"), F.lit(0).alias("analysis_id"), path.alias("path"), F.col("html").alias("content"), F.regexp_replace("url", "^https?://", "").alias("url"))


PAGES = "(select concat('site', page_id % 4) project_id, 0 analysis_id, concat('web/p', page_id // 4, '.html') path, html as content, regexp_replace(url, '^https?://', '') url from pages)"
PAGE_LINES = lines_sql(PAGES)

#: Lines of code made of the columns of a part: file by file, a bit of everything that the default patterns look for.
CODE = (
    "# {name}",
    "def load_{key}(x):",
    "    password = '{name}'",
    "    eval(x) + exec (y)",
    "    q = 'SELECT {type}' + x",
    "    if token == '{name}':",
    "        return hashlib.md5(x)",
    "    for i in range({size}):",
    "        yaml.load(f, Loader=SafeLoader) if i else yaml.load(f)",
    "    try:",
    "        os.system('rm -rf {name}')",
    "    except E{key}:",
    "        # {size}",
    "        pass",
    "    while x and y: x = {key}",
    "    subprocess(a, shell=True)  # TODO {name}",
    "class A{key} {{",
    "  private final Repo{size} repo;",
    "  public void get{key}(int x) {{",
    "    if (x > {key}) {{",
    "      try {{ run(x, {key}{size}); }} catch (E e) {{ }}",
    "    }} else {{ Math.random(); }}",
    "    for (int i = 0; i < {size}; i++) {{",
    "      try {{",
    "        repo.save(this.a.load.find(x)); // no(call)",
    "      }} catch (E e) {{",
    "        // {name}",
    "      }}",
    "    }}",
    "  }}",
    "}}",
)
#: Functions and classes inside others, with branches at several depths.
NESTED = (
    "class A{key} {{",
    "    def outer(x):",
    "        if x == {key}:",
    "            x = 1",
    "        elif x == {size}:",
    "            x = 2",
    "        elif x > 3:",
    "            for y in x:",
    "                while y: y -= 1",
    "        else:",
    "            x = 3",
    "",
    "        def inner(z):",
    "            if z or x:",
    "                return '{name}'",
    "        class B{size}:",
    "            def deep(self): pass",
    "    def last(x): return {size} if x else 0",
    "    public void run{key}(int x) {{",
    "      for (int i = 0; i < {size}; i++) {{",
    "        void twice(int y) {{",
    "          if (y > x) {{",
    "            switch (y) {{ case 1: return; case {size}: break; }}",
    "          }} else if (y > {key}) {{ y--; }}",
    "        }}",
    "        class C{key} {{",
    "        }}",
    "      }}",
    "    }} void after(int z) {{ if (z > 1) {{ z--; }}",
    "    }}",
    "    int plain(int z) {{ return z > 1 ? z : {key}; }}",
    "}}",
)


def always(code: tuple[str, ...]) -> tuple[int, ...]:
    """A part leaves line k out if p_partkey + k is a multiple of 7; lines with braces are always there."""
    return tuple(k for k, x in enumerate(code) if "{{" in x or "}}" in x)


def code_files(spark, sf_dir, code: tuple[str, ...] = CODE) -> DataFrame:
    """A Python and a Java file of each part, of projects by brand; paths repeat among the projects."""
    p = spread(table(spark, sf_dir, "part"))
    column = {"name": F.col("p_name"), "type": F.col("p_type"), "key": F.col("p_partkey").cast("string"), "size": F.col("p_size").cast("string")}

    def text(line: str):
        parts = re.split(r"\{(name|type|key|size)\}", line.replace("{{", "\x01").replace("}}", "\x02"))
        return F.concat(*[column[x] if i % 2 else F.lit(x.replace("\x01", "{").replace("\x02", "}")) for i, x in enumerate(parts)])

    there = always(code)
    chosen = F.array_compact(F.array(*[text(x) if k in there else F.when((F.col("p_partkey") + k) % 7 != 0, text(x)) for k, x in enumerate(code)]))
    content = F.concat(F.array_join(chosen, "\n"), F.lit("\n"))
    path = F.concat(F.lit("src/m"), F.expr("p_partkey div 50"), F.lit("_"), F.col("p_partkey") % 2, F.when(F.col("p_partkey") % 2 == 0, ".py").otherwise(".java"))
    return p.select(F.concat(F.lit("k"), F.col("p_partkey") % 50 - F.col("p_partkey") % 2).alias("project_id"), F.lit(1).alias("analysis_id"), path.alias("path"), content.alias("content"))


def _code_line(line: str) -> str:
    parts = re.split(r"\{(name|type|key|size)\}", line.replace("{{", "\x01").replace("}}", "\x02"))
    names = {"name": "p_name", "type": "p_type", "key": "p_partkey", "size": "p_size"}
    return "concat(" + ", ".join(names[x] if i % 2 else q(x.replace("\x01", "{").replace("\x02", "}")) for i, x in enumerate(parts)) + ")"


def code_lines_sql(code: tuple[str, ...]) -> str:
    there = always(code)
    return (
        "(select project_id, analysis_id, path, line, text from (select concat('k', p_partkey % 50 - p_partkey % 2) project_id, 1 analysis_id, concat('src/m', p_partkey // 50, '_', p_partkey % 2, case when p_partkey % 2 = 0 then '.py' else '.java' end) path, l.text, cast(row_number() over (partition by p_partkey order by l.k) as int) line from part, lateral (values "
        + ", ".join(f"({k}, {'true' if k in there else f'(p_partkey + {k}) % 7 <> 0'}, {_code_line(x)})" for k, x in enumerate(code))
        + ") l(k, taken, text) where l.taken))"
    )


CODE_LINES, NESTED_LINES = code_lines_sql(CODE), code_lines_sql(NESTED)


# --- inventory -------------------------------------------------------------------------------------------------------

TRIM = "regexp_replace({0}, '^[ \\t\\x0c\\x0b]+|[ \\t\\x0c\\x0b]+$', '', 'g')"
LOC = f"(select {KEYS}, count(*) filter (t <> '' and not starts_with(t, '//') and not starts_with(t, '#') and not starts_with(t, '/*')) loc from (select {KEYS}, trim(text) t from {LINES}) group by all)"


@query(f"select {KEYS}, 'kept' as status, 'OTHER' as language, coalesce(loc, 0) as loc from {FILES} f left join {LOC} l using ({KEYS}) where octet_length(encode(content)) <= {I.MAX_BYTES} union all select {KEYS}, 'big', null, null from {FILES} where octet_length(encode(content)) > {I.MAX_BYTES}")
def s1_inventory(spark, sf_dir):
    rows = files(spark, sf_dir).select("project_id", "analysis_id", "path", F.octet_length("content").alias("size_bytes"), F.col("content").cast("binary").alias("content"))
    return I.inventory(rows).select("project_id", "analysis_id", "path", "status", "language", "loc")


#: Files of several folders, and the rules of five projects as the text of their rule files.
FOLDERS = ("src", "dist", "dist/sub", "lib/build/gen", "docs", "web/.cache/x")
RULE_FILES = {
    "src1": "# kept results\n docs \n!dist/f12.en\n\n",
    "src2": "lib\n!dist/sub/f5.de\n!lib/build/gen/f9.fr\nf7.en\n",
    "src3": "docs/\n!docs\n/src/f30.fr\n!web/.cache\n",
    "src4": "!docs/none\nsrc\n! src/f4.en\n#src\n",
    "src5": "!\n/\nf1.en\n!dist/\n",
}
RULE_ROWS = (
    ("src1", 1, "dir", "docs", False), ("src1", 2, "file", "dist/f12.en", True),
    ("src2", 0, "dir", "lib", False), ("src2", 1, "file", "dist/sub/f5.de", True), ("src2", 2, "file", "lib/build/gen/f9.fr", True), ("src2", 3, "dir", "f7.en", False),
    ("src3", 0, "dir", "docs", False), ("src3", 1, "dir", "docs", True), ("src3", 2, "file", "src/f30.fr", False), ("src3", 3, "file", "web/.cache", True),
    ("src4", 0, "file", "docs/none", True), ("src4", 1, "dir", "src", False), ("src4", 2, "file", "src/f4.en", True),
    ("src5", 2, "dir", "f1.en", False), ("src5", 3, "dir", "dist", True),
)


@query(
    f"""with f as (select source project_id, doc_id % 3 analysis_id, concat([{", ".join(map(q, FOLDERS))}][cast(doc_id % {len(FOLDERS)} as int) + 1], '/f', doc_id // 3, '.', lang) path from documents),
    r(project_id, ord, kind, v, negate) as (values {", ".join(f"({q(a)}, {b}, {q(c)}, {q(d)}, {str(e).lower()})" for a, b, c, d, e in RULE_ROWS)}),
    a as (select distinct project_id, unnest(list_transform(generate_series(1, len(s) - 1), lambda i: array_to_string(s[1:i], '/'))) dir from (select project_id, string_split(path, '/') s from f)),
    o as (select a.project_id, dir, arg_max(not negate, ord) out from a join r on r.project_id = a.project_id and kind = 'dir' and list_contains(string_split(dir, '/'), v) group by all),
    g as (select a.*, (list_has_any(string_split(dir, '/'), ['dist', 'build', '.cache']) or coalesce(out, false)) and not exists (select 1 from r where r.project_id = a.project_id and negate and starts_with(v, dir)) pruned from a left join o using (project_id, dir)),
    p as (select f.project_id, analysis_id, path, min_by(dir, length(dir)) pruned_dir from f join g on g.project_id = f.project_id and pruned and starts_with(path, dir || '/') group by all),
    m as (select f.project_id, analysis_id, path, arg_max(not negate, ord) out from f join r on r.project_id = f.project_id and case kind when 'dir' then list_contains(string_split(path, '/'), v) else path = v end group by all)
    select project_id, analysis_id, path, pruned_dir, case when pruned_dir is not null or out then 'ignored' else 'kept' end as status from f left join p using (project_id, analysis_id, path) left join m using (project_id, analysis_id, path)"""
)
def s1_inventory_with_rules(spark, sf_dir):
    """Rule files of many projects with negated rules: what they reach into, and what the last match says."""
    d = spread(table(spark, sf_dir, "documents"))
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.col("doc_id") % len(FOLDERS) + 1).cast("int"))
    path = F.concat(folder, F.lit("/f"), F.expr("doc_id div 3"), F.lit("."), "lang")
    rows = d.select(F.col("source").alias("project_id"), (F.col("doc_id") % 3).alias("analysis_id"), path.alias("path"), F.octet_length("text").alias("size_bytes"), F.col("text").cast("binary").alias("content"))
    kept = spark.createDataFrame([(k, ".rules", v) for k, v in RULE_FILES.items()], "project_id string, path string, content string")
    return I.inventory(rows, rules=I.rules_in(kept, ".rules")).select("project_id", "analysis_id", "path", "pruned_dir", "status")


@query(
    f"""with f as (select source project_id, lang, n_chars, row_number() over (partition by source order by concat(source, '/', doc_id, '.', lang)) k from documents),
    t as (select project_id, sum(n_chars) filter (k <= {I.MAX_FILES}) total, count(*) filter (k <= {I.MAX_FILES}) files, count(*) > {I.MAX_FILES} truncated from f group by 1),
    s as (select project_id, lang, sum(n_chars) n from f where k <= {I.MAX_FILES} group by 1, 2)
    select t.project_id, cast(total as bigint) as loc_total, files as file_count, truncated, (select string_agg(concat(lang, '=', round(n * 100 / total, 1)), ',' order by lang) from s where s.project_id = t.project_id) as lang_stats from t"""
)
def s2_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("source").alias("project_id"), F.concat("source", F.lit("/"), "doc_id", F.lit("."), "lang").alias("path"), F.col("lang").alias("language"), F.col("n_chars").alias("loc"), F.lit("kept").alias("status"))
    shown = F.array_join(F.transform(F.sort_array(F.map_entries("lang_stats")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return I.summary(rows).select("project_id", "loc_total", "file_count", "truncated", shown.alias("lang_stats"))


@query(f"select url, list_has_any(list_slice(string_split(url, '/'), 1, -2), ['item', 'dist', 'build', 'target']) or regexp_matches(url, '(\\.lock|\\.min\\.js|\\.map|\\.pyc|\\.pyo|\\.class|\\.jar)$') as ignored from {PAGES}")
def f1_default_ignore(spark, sf_dir):
    # hosts stand in for directories; a directory of the pages is among the ignored ones
    p = pages(spark, sf_dir)
    named = F.concat_ws("/", F.transform(I.segments(F.col("url")), lambda x: F.when(x == "item", F.lit("dist")).otherwise(x)))
    return p.select("url", I.ignored(named).alias("ignored"))


@query(f"select url, list_has_any(string_split(url, '/'), ['.git', 'node_modules', '.venv', 'venv', 'dist', 'build', '.idea', 'p']) as skipped from {PAGES}")
def f4_scanner_skips(spark, sf_dir):
    return pages(spark, sf_dir).select("url", I.skipped(F.col("url"), (*I.SCANNER_SKIPS, "p")).alias("skipped"))


@query(f"select {KEYS}, regexp_extract(path, '(\\.[^./]+)$', 1) as extension from {FILES} where regexp_extract(path, '(\\.[^./]+)$', 1) in ('.en', '.fr')")
def f5_extension_filter(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("extension", I.extension(F.col("path")))
    return f.filter(F.col("extension").isin(".en", ".fr")).select("project_id", "analysis_id", "path", "extension")


RULES = [("src1", 1, "src", False), ("src1", 2, "src/f7.en", True), ("src2", 1, "nothing", False), ("src3", 1, "src3/", False), ("src3", 2, "src3", True)]


@query(
    f"""with r(of, ord, v, negate) as (values ('src1', 1, 'src', false), ('src1', 2, 'src/f7.en', true), ('src2', 1, 'nothing', false), ('src3', 1, 'src3', false), ('src3', 2, 'src3', true)),
    m as (select {KEYS}, arg_max(negate, ord) negate from {FILES}, r where project_id = of and case when contains(v, '/') then path = v else list_contains(string_split(path, '/'), v) end group by all)
    select {KEYS}, not m.negate as custom from {FILES} f left join m using ({KEYS})"""
)
def f2_custom_ignore(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "project_id string, ord int, value string, negate boolean")
    return I.custom_ignored(files(spark, sf_dir).select("project_id", "analysis_id", "path"), rules).select("project_id", "analysis_id", "path", "custom")


@query(f"select distinct project_id, 'src' as dir from {FILES} where project_id = 'src1'")
def f3_reincluded_dirs(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "project_id string, ord int, value string, negate boolean")
    return I.reincluded(files(spark, sf_dir).select("project_id", F.lit("src").alias("dir")).distinct(), rules)


STACK = {"the": "The", "der": "German", "die": "German", "les": "French", "zzzz": "None"}
STORES = {"and": "And", "und": "Und", "th": "Th"}


@query(
    """with m as (select source project_id, text, case when doc_id % 2 = 0 then 0 else 2 end o, doc_id % 2 = 0 pom from documents),
    k(kw, label, rank) as (values ('the', 'The', 0), ('der', 'German', 1), ('die', 'German', 1), ('les', 'French', 3), ('zzzz', 'None', 4)),
    d(kw, label, rank) as (values ('and', 'And', 0), ('und', 'Und', 1), ('th', 'Th', 2)),
    h as (select project_id, label, min(o * 1000 + rank) rank from m, k where contains(case when pom then text else lower(text) end, kw) group by 1, 2 union all select project_id, 'Maven', -1 from m where pom group by 1),
    g as (select project_id, label, min(o * 1000 + rank) rank from m, d where contains(case when pom then text else lower(text) end, kw) group by 1, 2)
    select p.project_id, (select string_agg(label, ',' order by rank) from h where h.project_id = p.project_id) as frameworks, coalesce((select string_agg(label, ',' order by rank) from g where g.project_id = p.project_id), '') as databases, true as has_backend from (select distinct project_id from m) p"""
)
def f11_stack(spark, sf_dir):
    """Documents stand in for poms and requirements at the roots of their projects."""
    d = spread(table(spark, sf_dir, "documents"))
    rows = d.select(F.col("source").alias("project_id"), F.when(F.col("doc_id") % 2 == 0, "pom.xml").otherwise("requirements.txt").alias("path"), F.col("text").alias("content"))
    found = I.stack(rows, STACK, STORES)
    return found.select("project_id", F.array_join("frameworks", ",").alias("frameworks"), F.array_join("databases", ",").alias("databases"), "has_backend")


# --- rules -----------------------------------------------------------------------------------------------------------

HIT = ("project_id", "analysis_id", "path", "line", "rule_key")


def code_lines(spark, sf_dir) -> DataFrame:
    return R.lines_of(code_files(spark, sf_dir))


@query(f"select {KEYS}, line, 'SECRET-HARDCODED' as rule_key from {LINES} where regexp_matches(text, {q(R.SECRET)})")
def r1_secrets(spark, sf_dir):
    return R.scan_lines(doc_lines(spark, sf_dir)).filter("rule_key = 'SECRET-HARDCODED'").select(*HIT)


def dangerous_sql(patterns) -> str:
    """One engine has no look-ahead: the list's only one, for a safe loader later in the line, is written out for it."""
    plain = lambda p: f"regexp_matches(text, {q(p)})"
    test = lambda p: plain(p) if "(?!" not in p else f"(regexp_matches(text, {q(p.split('|')[0])}) or regexp_matches(regexp_replace(text, '^.*SafeLoader', ''), {q('yaml[.]load' + chr(92) + 's*' + chr(92) + '([^)]*' + chr(92) + ')')}))"
    return "case " + " ".join(f"when {test(p)} then {q(x)}" for p, x in patterns) + " end"


CALL = dangerous_sql(R.DANGEROUS)
SECURE = f"regexp_matches(text, {q(R.SECRET)})"


@query(f"select {KEYS}, line, {CALL} as message from {CODE_LINES} where {CALL} is not null and not {SECURE}")
def r2_dangerous_calls(spark, sf_dir):
    return R.scan_lines(code_lines(spark, sf_dir)).filter("rule_key = 'DANGEROUS-CALL'").select("project_id", "analysis_id", "path", "line", "message")


@query(f"select {KEYS}, line, 'SQL-INJECTION' as rule_key from {CODE_LINES} where regexp_matches(text, {q(R.SQL_WORD)}) and regexp_matches(text, {q(R.SQL_JOIN)}) and not {SECURE}")
def r3_two_marks(spark, sf_dir):
    return R.scan_lines(code_lines(spark, sf_dir)).filter("rule_key = 'SQL-INJECTION'").select(*HIT)


@query(
    f"""with c as (select *, {SECURE} a, {CALL} is not null b, regexp_matches(text, {q(R.SQL_WORD)}) and regexp_matches(text, {q(R.SQL_JOIN)}) c, regexp_matches(text, {q(R.PASSWORD_COMPARE)}) d from {CODE_LINES})
    select {KEYS}, line, rule_key from (select *, unnest(['SECRET-HARDCODED', 'DANGEROUS-CALL', 'SQL-INJECTION', 'PLAINTEXT-PASSWORD-COMPARE']) rule_key from c)
    where case rule_key when 'SECRET-HARDCODED' then a when 'DANGEROUS-CALL' then b and not a when 'SQL-INJECTION' then c and not a else d and not a end"""
)
def r4_rules_on_one_line(spark, sf_dir):
    """All default rules: several may hit a line, a secret ends it."""
    return R.scan_lines(code_lines(spark, sf_dir)).select(*HIT)


MANY = [("ONE", "MAJOR", "<script", True), ("TWO", "MINOR", "<p>", False), ("THREE", "MINOR", "</p>", False)]


@query(
    f"""select {KEYS}, line, rule_key from (select *, unnest(['ONE', 'TWO', 'THREE']) rule_key from {PAGE_LINES})
    where case rule_key when 'ONE' then contains(text, '<script') when 'TWO' then contains(text, '<p>') and not contains(text, '<script') else contains(text, '</p>') and not contains(text, '<script') end"""
)
def x_registered_rules(spark, sf_dir):
    """Rules that come as a table."""
    rules = spark.createDataFrame([(i, key, "S", "K", severity, pattern, last) for i, (key, severity, pattern, last) in enumerate(MANY)], "ord int, rule_key string, source string, kind string, severity string, pattern string, last boolean")
    R.register_rules(rules, "pages")
    return R.scan_lines(R.lines_of(pages(spark, sf_dir)), R.REGISTERED["pages"]).select(*HIT)


WORDS = {"THE": "MINOR", "ER": "MAJOR"}


def mark_sql(words: str) -> str:
    return f"upper(regexp_extract(regexp_extract(text, {q(R.OPENER + '(.*)$')}, 0), {q(f'(?i)({words})' + R.END)}, 1))"


MARK = mark_sql("THE|ER")
LEFT = f"(select * from (select *, row_number() over (partition by {KEYS} order by line) k from (select *, {MARK} marker from {LINES}) where marker <> '') where k <= 10)"


@query(f"select {KEYS}, line, concat('LEFTOVER-', marker) as rule_key from {LEFT}")
def r5_leftovers(spark, sf_dir):
    return R.leftovers(doc_lines(spark, sf_dir), WORDS).select(*HIT)


@query(f"select {KEYS}, line, concat('LEFTOVER-', {mark_sql('TODO|FIXME|HACK|XXX')}) as rule_key from {CODE_LINES} where {mark_sql('TODO|FIXME|HACK|XXX')} <> ''")
def r5_code_leftovers(spark, sf_dir):
    return R.leftovers(code_lines(spark, sf_dir)).select(*HIT)


BARE = f"regexp_replace(regexp_replace(text, {q(R.STRING)}, 'S', 'g'), '(//|#).*$', '', 'g')"
NUMBERS = f"list_filter(regexp_extract_all({BARE}, '[A-Za-z0-9_$]+'), lambda x: regexp_matches(x, '^[0-9]{{3,}}$') and x not in ({', '.join(map(q, R.SAFE_NUMBERS))}))"


def numbers_sql(lines: str) -> str:
    return f"(select {KEYS}, line, numbers from (select *, {NUMBERS} numbers from {lines} where not regexp_matches(text, {q(r'^[ \t]*(//|#|[*]|/[*])')}) and not regexp_matches(ltrim({BARE}), {q(R.DECLARED)}) and not regexp_matches(ltrim({BARE}), {q(R.ASSIGNED)})) where len(numbers) > 0)"


@query(f"select {KEYS}, line, array_to_string(numbers, ',') as numbers from {numbers_sql(LINES)}")
def r6_number_candidates(spark, sf_dir):
    return R.number_candidates(doc_lines(spark, sf_dir)).select("project_id", "analysis_id", "path", "line", F.array_join("numbers", ",").alias("numbers"))


def magic_sql(lines: str) -> str:
    """A fold over the candidate lines of a file: the numbers reported so far, and which one this line adds."""
    return f"""(with recursive c as (select *, row_number() over (partition by {KEYS} order by line) k from {numbers_sql(lines)}),
      f as (select {KEYS}, k, line, [numbers[1]] seen, numbers[1] hit from c where k = 1
        union all select c.project_id, c.analysis_id, c.path, c.k, c.line, case when len(seen) < 5 and n is not null then list_append(seen, n) else seen end, case when len(seen) < 5 then n end
          from f join (select * from c) c on c.project_id = f.project_id and c.analysis_id = f.analysis_id and c.path = f.path and c.k = f.k + 1, lateral (select list_filter(c.numbers, lambda x: not list_contains(f.seen, x))[1] n))
      select {KEYS}, line, hit as message from f where hit is not null)"""


@query(magic_sql(LINES))
def r6_magic_numbers(spark, sf_dir):
    return R.magic_numbers(doc_lines(spark, sf_dir)).select("project_id", "analysis_id", "path", "line", "message")


@query(magic_sql(CODE_LINES))
def r6_code_numbers(spark, sf_dir):
    return R.magic_numbers(code_lines(spark, sf_dir)).select("project_id", "analysis_id", "path", "line", "message")


def swallowed_sql(lines: str, head: str, body: str, comment: str) -> str:
    return f"select {KEYS}, line from (select *, lead(text) over (partition by {KEYS} order by line) after from {lines} where not regexp_matches(text, {q(comment)})) where regexp_matches(text, {q(head)}) and regexp_matches(after, {q(body)})"


@query(swallowed_sql(CODE_LINES, r"^[ \t]*except[^:]*:[ \t]*$", r"^[ \t]*pass[ \t]*$", r"^[ \t]*#"))
def r7_swallowed(spark, sf_dir):
    return R.swallowed(code_lines(spark, sf_dir)).select("project_id", "analysis_id", "path", "line")


@query(swallowed_sql(LINES, "^[^,]*[.]$", "^[A-Z][a-z]+ ", "^An"))
def r7_text_pairs(spark, sf_dir):
    return R.swallowed(doc_lines(spark, sf_dir), "^[^,]*[.]$", "^[A-Z][a-z]+ ", "^An").select("project_id", "analysis_id", "path", "line")


STYLE = {"trailing": "[.]$", "mixed": "^[A-Z][a-z]+ a"}
STYLED = f"""(with s as (select {KEYS}, count(*) filter (regexp_matches(text, '[.]$')) nt, min(line) filter (regexp_matches(text, '[.]$')) t, count(*) filter (regexp_matches(text, '^[A-Z][a-z]+ a')) nm, min(line) filter (regexp_matches(text, '^[A-Z][a-z]+ a')) m from {LINES} group by all)
    select {KEYS}, t as line, 'TRAILING-WHITESPACE' as rule_key from s where nt >= 3 union all select {KEYS}, m, 'MIXED-INDENT' from s where nm >= 1)"""


@query(f"select * from {STYLED}")
def r9_style(spark, sf_dir):
    return R.style(doc_lines(spark, sf_dir), **STYLE).select(*HIT)


@query(
    f"""select {KEYS}, line, rule_key, source from (select {KEYS}, line, 'SECRET-HARDCODED' as rule_key, 'SECURITY' as source from {LINES} where {SECURE}
    union all select {KEYS}, line, 'DANGEROUS-CALL', 'SECURITY' from {LINES} where {CALL} is not null and not {SECURE}
    union all select {KEYS}, line, 'SQL-INJECTION', 'SECURITY' from {LINES} where regexp_matches(text, {q(R.SQL_WORD)}) and regexp_matches(text, {q(R.SQL_JOIN)}) and not {SECURE}
    union all select {KEYS}, line, 'PLAINTEXT-PASSWORD-COMPARE', 'SECURITY' from {LINES} where regexp_matches(text, {q(R.PASSWORD_COMPARE)}) and not {SECURE}
    union all select {KEYS}, line, concat('LEFTOVER-', marker), 'TODO' from {LEFT}
    union all select {KEYS}, line, 'MAGIC-NUMBER', 'MAGIC' from {magic_sql(LINES)}
    union all select *, 'STYLE' from {STYLED})"""
)
def r10_all_issues(spark, sf_dir):
    """The four families of line rules over one explosion of each text."""
    return R.findings(files(spark, sf_dir), markers=WORDS, styles=STYLE).select(*HIT, "source")


ADVICE = [("STANDARD", "plain", "leave"), ("STANDARD POLISHED", "shiny", "dull"), ("PROMO", "loud", "hush"), ("ECONOMY A", "cheap", "check")]


@query(
    """with a(k, impact, fix) as (values ('STANDARD', 'plain', 'leave'), ('STANDARD POLISHED', 'shiny', 'dull'), ('PROMO', 'loud', 'hush'), ('ECONOMY A', 'cheap', 'check')),
    h as (select p_partkey, arg_max(impact, length(k)) impact, arg_max(fix, length(k)) fix from part, a where starts_with(p_type, k) group by 1)
    select p.p_partkey as id, coalesce(h.impact, concat('breaks ', p_type)) as impact, coalesce(h.fix, 'see the rule') as fix from part p left join h using (p_partkey)"""
)
def r11_advice(spark, sf_dir):
    issues = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("rule_key"))
    advice = spark.createDataFrame(ADVICE, "rule_key string, impact string, fix string")
    return R.with_advice(issues, advice).select("id", "impact", "fix")


@query(
    """select event_id as id, case event_type when 'click' then 'a press' else concat(case when starts_with(event_type, 'v') then 'a look' when starts_with(event_type, 'p') then 'a deal' else 'a rule' end, ': ',
    case event_id % 6 when 0 then 'fix at once' when 1 then 'fix first' when 3 then 'fix in passing' when 4 then 'note' else 'plan a fix' end) end as explanation from events"""
)
def r12_explanations(spark, sf_dir):
    level = F.element_at(F.array(*map(F.lit, ("BLOCKER", "CRITICAL", "MAJOR", "MINOR", "INFO", "ODD"))), (F.col("event_id") % 6 + 1).cast("int"))
    issues = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("rule_key"), level.alias("severity"))
    return R.explained(issues, {"click": "a press"}, {"v": "a look", "p": "a deal"}).select("id", "explanation")


@query(
    f"""with i as (select {KEYS}, line, 3 r from {LINES} where {SECURE} union all select {KEYS}, line, case marker when 'ER' then 2 else 1 end from {LEFT})
    select {KEYS}, line, count(i.r) as issues, case max(i.r) when 3 then 'error' when 2 then 'warning' when 1 then 'info' end as class from {LINES} l left join i using ({KEYS}, line) group by all"""
)
def j9_annotated_lines(spark, sf_dir):
    issues = R.findings(files(spark, sf_dir), markers=WORDS, rules=R.SECURITY[:1], numbers=False).filter("source <> 'STYLE'")
    return R.annotated(doc_lines(spark, sf_dir), issues)


# --- blocks ----------------------------------------------------------------------------------------------------------


def depth_sql(lines: str, open_: str, close: str) -> str:
    return f"(select {KEYS}, line, text, sum(len(regexp_extract_all(text, {q(open_)})) - len(regexp_extract_all(text, {q(close)}))) over (partition by {KEYS} order by line) d, max(line) over (partition by {KEYS}) n from {lines})"


def same_file(a: str, b: str) -> str:
    return " and ".join(f"{a}.{k} = {b}.{k}" for k in KEYS.split(", "))


def braces_sql(lines: str, head: str, open_: str = "[{]", close: str = "[}]") -> str:
    """Blocks of the lines that satisfy the condition `head`: start and end from 0."""
    return f"""(with s as (select *, coalesce(lag(d) over (partition by {KEYS} order by line), 0) b from {depth_sql(lines, open_, close)})
    select {KEYS}, cast(line - 1 as int) as start, cast(coalesce((select min(e.line) from s e where {same_file("e", "s")} and e.line > s.line and e.d <= s.b), s.n) - 1 as int) as end from s where {head})"""


def indents_sql(lines: str, head: str) -> str:
    return f"""(with l as (select *, case when trim(text) = '' then 1000000 else length(text) - length(ltrim(text, ' ')) end d, max(line) over (partition by {KEYS}) n from {lines})
    select {KEYS}, cast(line - 1 as int) as start, cast(coalesce((select min(e.line) from l e where {same_file("e", "l")} and e.line > l.line and e.d <= l.d), l.n + 1) - 2 as int) as end from l where {head})"""


def defined(pattern: str) -> str:
    """A condition for a head pattern: one engine has no look-ahead, so the words ruled out are a condition of their own."""
    ruled = r"(?!(?:for|if|while|switch|catch|do)\b)"
    other = "" if ruled not in pattern else f" and not regexp_matches(text, {q('^' + chr(92) + 's*(?:for|if|while|switch|catch|do)' + chr(92) + 'b')})"
    return f"regexp_matches(text, {q(pattern.replace(ruled, ''))}){other}"


def of_language(lines: str, extension: str) -> str:
    return f"(select * from {lines} where path like '%{extension}')"


def cursor_sql(blocks: str) -> str:
    """Of the blocks of a rule and file those that a cursor meets that goes on after the end of each: a query that begins with
    `with recursive` and ends with the table c."""
    k = f"{KEYS}, rule"
    return f"""with recursive b as (select *, row_number() over (partition by {k} order by start) k from ({blocks})),
    r as (select {k}, k, start, "end", true kept, "end" last from b where k = 1
      union all select b.project_id, b.analysis_id, b.path, b.rule, b.k, b.start, b."end", b.start > r.last, case when b.start > r.last then b."end" else r.last end from r join b on {same_file("r", "b")} and b.rule = r.rule and b.k = r.k + 1),
    c as (select {k}, start, "end" from r where kept)"""


@query(f"select * from {braces_sql(PAGE_LINES, "regexp_matches(text, '<(body|ul|div)')", '<[a-z]', '</')}")
def b1_block_ends(spark, sf_dir):
    return B.block_ends(pages(spark, sf_dir), "<(body|ul|div)", "<[a-z]", "</")


@query(f"select * from {braces_sql(CODE_LINES, defined(B.BRACE_CLASS))}")
def b1_classes(spark, sf_dir):
    return B.block_ends(code_files(spark, sf_dir), B.BRACE_CLASS)


@query(f"select * from {indents_sql(PAGE_LINES, "contains(text, '<body')")}")
def b2_indent_ends(spark, sf_dir):
    return B.indent_ends(pages(spark, sf_dir), "<body")


@query(f"select * from {indents_sql(CODE_LINES, defined(B.PY_DEF))}")
def b2_functions(spark, sf_dir):
    return B.indent_ends(code_files(spark, sf_dir))


@query(f"select {KEYS}, 1 as line, 'BLOATED-FILE' as rule_key, cast(count(*) as int) as size from {LINES} group by {KEYS} having count(*) > 50")
def b3_bloated_files(spark, sf_dir):
    return B.long_files(files(spark, sf_dir), 50)


def bloated_sql(lines: str, method: int, class_: int, file: int) -> str:
    java, python = of_language(lines, ".java"), of_language(lines, ".py")
    heads = (("BLOATED-METHOD", braces_sql(java, defined(B.BRACE_DEF))), ("BLOATED-METHOD", indents_sql(python, defined(B.PY_DEF))), ("BLOATED-CLASS", braces_sql(java, defined(B.BRACE_CLASS))), ("BLOATED-CLASS", indents_sql(python, defined(B.PY_CLASS))))
    return f"""{cursor_sql(" union all ".join(f"select '{rule}' as rule, * from {x}" for rule, x in heads))}
    select {KEYS}, "start" + 1 as line, rule as rule_key, "end" - "start" + 1 as size from c where "end" - "start" + 1 > case rule when 'BLOATED-METHOD' then {method} else {class_} end
    union all select {KEYS}, 1, 'BLOATED-FILE', cast(count(*) as int) from {lines} group by {KEYS} having count(*) > {file}"""


def complex_sql(lines: str, minor: int, major: int) -> str:
    """Head line included; a line counts at the depth before it."""
    found = f"select 'f' as rule, * from {braces_sql(of_language(lines, '.java'), defined(B.FUNCTION))} union all select 'f', * from {indents_sql(of_language(lines, '.py'), defined(B.PY_DEF))}"
    return f"""{cursor_sql(found)},
    l as (select {KEYS}, c.start, ltrim(text) t, len(regexp_extract_all(text, {q(B.BRANCH)})) n, row_number() over (partition by {KEYS}, c.start order by line) k from c join {lines} using ({KEYS}) where line between c.start + 1 and c."end" + 1),
    w as (select *, case when regexp_matches(t, '^(if |for |while |catch|switch|else )') then 1 when starts_with(t, '}}') or starts_with(t, 'elif') or starts_with(t, 'else:') then -1 else 0 end turn from l),
    d as (select {KEYS}, start, k, n score, greatest(turn, 0) depth from w where k = 1
      union all select w.project_id, w.analysis_id, w.path, w.start, w.k, d.score + w.n * (1 + d.depth), greatest(d.depth + w.turn, 0) from d join w on {same_file("d", "w")} and d.start = w.start and w.k = d.k + 1),
    s as (select {KEYS}, start, max_by(score, k) score from d group by all)
    select {KEYS}, cast(start + 1 as int) as line, cast(score as int) as score, case when score >= {major} then 'MAJOR' else 'MINOR' end as severity from s where score >= {minor}"""


@query(bloated_sql(CODE_LINES, 8, 12, 26))
def b3_bloated(spark, sf_dir):
    return B.bloated(code_files(spark, sf_dir), 8, 12, 26)


@query(bloated_sql(NESTED_LINES, 3, 1, 28))
def b3_nested_blocks(spark, sf_dir):
    """Functions inside functions and classes inside classes: the outer ones only."""
    return B.bloated(code_files(spark, sf_dir, NESTED), 3, 1, 28)


@query(complex_sql(CODE_LINES, 4, 7))
def b4_complex_functions(spark, sf_dir):
    return B.complex_functions(code_files(spark, sf_dir), 4, 7)


@query(complex_sql(NESTED_LINES, 1, 12))
def b4_nested_functions(spark, sf_dir):
    return B.complex_functions(code_files(spark, sf_dir, NESTED), 1, 12)


@query(
    f"""with s as (select * from {depth_sql(PAGE_LINES, '<[a-z]', '</')}),
    b as (select {KEYS}, line, coalesce((select min(e.line) from s e where {same_file("e", "h")} and e.line > h.line and e.d < h.d), n) last from s h where regexp_matches(text, '<(ul|body|div)'))
    select {KEYS}, cast(line as int) as line from b where not exists (select 1 from s x where {same_file("x", "b")} and x.line > b.line and x.line < b.last and not regexp_matches(trim(x.text), '^($|<!--|<(li|p|/))'))
    union all select {KEYS}, cast(line as int) from s where regexp_matches(text, 'catch\\s*\\([^)]*\\)\\s*\\{{[\\s/]*\\}}')"""
)
def r8_empty_blocks(spark, sf_dir):
    return B.empty_catches(pages(spark, sf_dir), "<(ul|body|div)", r"^($|<!--|<(li|p|/))", "<[a-z]", "</")


@query(
    f"""with s as (select * from {depth_sql(CODE_LINES, '[{]', '[}]')}),
    b as (select {KEYS}, line, coalesce((select min(e.line) from s e where {same_file("e", "h")} and e.line > h.line and e.d < h.d), n) last from s h where regexp_matches(text, 'catch\\s*\\([^)]*\\)\\s*\\{{\\s*$'))
    select {KEYS}, line from b where not exists (select 1 from s x where {same_file("x", "b")} and x.line > b.line and x.line < b.last and not regexp_matches(trim(x.text), '^($|//|#|/[*]|[*])'))
    union all select {KEYS}, line from s where regexp_matches(text, 'catch\\s*\\([^)]*\\)\\s*\\{{[\\s/]*\\}}')"""
)
def r8_empty_catches(spark, sf_dir):
    return B.empty_catches(code_files(spark, sf_dir))


# --- duplicates ------------------------------------------------------------------------------------------------------

NORMAL = "lower(regexp_replace(regexp_replace(text, '[\"''][^\"'']{0,200}[\"'']', '\"S\"', 'g'), '[ \\t\\r\\n\\f\\v]+', '', 'g'))"
def windows_sql(lines: str) -> str:
    return f"""(select {KEYS}, line, md5(array_to_string(w, chr(10))) hash from (select {KEYS}, line, list({NORMAL}) over (partition by {KEYS} order by line rows between current row and 5 following) w from {lines})
  where len(w) = 6 and len(list_filter(w, lambda x: not regexp_matches(x, '^[\\[\\](){{}};,]*$'))) > 0)"""


def same_file_sql(windows: str) -> str:
    return f"""select {KEYS}, first, second from (select *, row_number() over (partition by {KEYS} order by first, second) k from (select {KEYS}, list_min(w) as first, list_min(list_filter(w, lambda x: x - list_min(w) >= 6)) as second
    from (select {KEYS}, hash, list(line) w from {windows} group by all)) where second is not null) where k <= 10"""


def cross_file_sql(windows: str) -> str:
    return f"""with f as (select project_id, analysis_id, hash, path, min(line) line from {windows} group by all), r as (select *, row_number() over (partition by project_id, analysis_id, hash order by path) k from f),
    p as (select a.project_id, a.analysis_id, a.path path_a, a.line line_a, b.path path_b, b.line line_b from r a join r b on a.project_id = b.project_id and a.analysis_id = b.analysis_id and a.hash = b.hash and a.k = 1 and b.k = 2),
    d as (select *, row_number() over (partition by project_id, analysis_id, path_a, path_b order by line_a, line_b) j from p)
    select project_id, analysis_id, path_a, line_a, path_b, line_b from (select *, row_number() over (partition by project_id, analysis_id order by path_a, line_a, path_b) m from d where j = 1) where m <= 50"""


def shared_sql(windows: str) -> str:
    """Every file of every window, beside the first one."""
    return f"""with f as (select project_id, analysis_id, hash, path, min(line) line from {windows} group by all), r as (select *, row_number() over (partition by project_id, analysis_id, hash order by path) k from f)
    select a.project_id, a.analysis_id, a.path path_a, a.line line_a, b.path path_b, b.line line_b from r a join r b on a.project_id = b.project_id and a.analysis_id = b.analysis_id and a.hash = b.hash and a.k = 1 and b.k > 1"""


WINDOWS = windows_sql(LINES)


@query(f"select {KEYS}, line, hash from {WINDOWS}")
def u1_windows(spark, sf_dir):
    return B.windows(doc_lines(spark, sf_dir)).select("project_id", "analysis_id", "path", "line", "hash")


@query(same_file_sql(WINDOWS))
def u2_same_file_duplicates(spark, sf_dir):
    return B.same_file_duplicates(B.windows(doc_lines(spark, sf_dir)))


@query(shared_sql(WINDOWS))
def u3_cross_file_duplicates(spark, sf_dir):
    return B.shared_windows(B.windows_of(files(spark, sf_dir)))


#: Documents as files of one project and analysis each language, so that copies meet.
BY_LANGUAGE = "(select lang project_id, 0 analysis_id, concat('doc/f', doc_id, '.md') path, text as content from documents)"


def by_language(spark, sf_dir) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))
    return d.select(F.col("lang").alias("project_id"), F.lit(0).alias("analysis_id"), F.concat(F.lit("doc/f"), "doc_id", F.lit(".md")).alias("path"), F.col("text").alias("content"))


@query(shared_sql(windows_sql(lines_sql(BY_LANGUAGE))))
def u3_copies(spark, sf_dir):
    """Copies and shared passages among all documents of a language."""
    return B.shared_windows(B.windows_of(by_language(spark, sf_dir)))


#: All kinds of files: code, code with blocks inside blocks, and documents.
EVERY_LINE = f"(select {KEYS}, line, text from {CODE_LINES} union all select project_id, 2, path, line, text from {NESTED_LINES} union all select {KEYS}, line, text from {lines_sql(BY_LANGUAGE)})"


def style_sql(lines: str) -> str:
    return f"""(with s as (select {KEYS}, count(*) n, count(*) filter (regexp_matches(text, '[ \\t]+$')) nt, min(line) filter (regexp_matches(text, '[ \\t]+$')) t, count(*) filter (regexp_matches(text, '^( +\\t|\\t+ )')) nm, min(line) filter (regexp_matches(text, '^( +\\t|\\t+ )')) m, bool_or(starts_with(text, chr(9))) tabs, bool_or(starts_with(text, ' ')) spaces from {lines} group by all)
    select {KEYS}, t as line, 'TRAILING-WHITESPACE' as rule_key from s where nt >= 3 union all select {KEYS}, m, 'MIXED-INDENT' from s where nm >= 1 union all select {KEYS}, 1, 'INCONSISTENT-INDENT' from s where tabs and spaces)"""


def every_sql(lines: str) -> str:
    todo = mark_sql("TODO|FIXME|HACK|XXX")
    java, python = of_language(lines, ".java"), of_language(lines, ".py")
    catches = f"""with s as (select * from {depth_sql(java, '[{]', '[}]')}),
      b as (select {KEYS}, line, coalesce((select min(e.line) from s e where {same_file("e", "h")} and e.line > h.line and e.d < h.d), n) last from s h where regexp_matches(text, 'catch\\s*\\([^)]*\\)\\s*\\{{\\s*$'))
      select {KEYS}, line from b where not exists (select 1 from s x where {same_file("x", "b")} and x.line > b.line and x.line < b.last and not regexp_matches(trim(x.text), '^($|//|#|/[*]|[*])'))
      union all select {KEYS}, line from s where regexp_matches(text, 'catch\\s*\\([^)]*\\)\\s*\\{{[\\s/]*\\}}')"""
    return f"""select {KEYS}, cast(line as int) line, rule_key, source, severity from (
      select {KEYS}, line, 'SECRET-HARDCODED' as rule_key, 'SECURITY' as source, 'CRITICAL' as severity from {lines} where {SECURE}
      union all select {KEYS}, line, 'DANGEROUS-CALL', 'SECURITY', 'MAJOR' from {lines} where {CALL} is not null and not {SECURE}
      union all select {KEYS}, line, 'SQL-INJECTION', 'SECURITY', 'CRITICAL' from {lines} where regexp_matches(text, {q(R.SQL_WORD)}) and regexp_matches(text, {q(R.SQL_JOIN)}) and not {SECURE}
      union all select {KEYS}, line, 'PLAINTEXT-PASSWORD-COMPARE', 'SECURITY', 'CRITICAL' from {lines} where regexp_matches(text, {q(R.PASSWORD_COMPARE)}) and not {SECURE}
      union all select {KEYS}, line, concat('LEFTOVER-', marker), 'TODO', case marker when 'TODO' then 'MINOR' else 'MAJOR' end from (select *, row_number() over (partition by {KEYS} order by line) k from (select *, {todo} marker from {lines}) where marker <> '') where k <= 10
      union all select {KEYS}, line, 'MAGIC-NUMBER', 'MAGIC', 'MINOR' from {magic_sql(lines)}
      union all select *, 'STYLE', case rule_key when 'TRAILING-WHITESPACE' then 'INFO' else 'MINOR' end from {style_sql(lines)}
      union all select {KEYS}, line, 'SWALLOWED-EXCEPTION', 'ERROR', 'MAJOR' from ({swallowed_sql(python, r"^[ \t]*except[^:]*:[ \t]*$", r"^[ \t]*pass[ \t]*$", r"^[ \t]*#")} union all ({catches}))
      union all select {KEYS}, line, rule_key, 'BLOATED', case rule_key when 'BLOATED-FILE' then 'MINOR' else 'MAJOR' end from ({bloated_sql(f"(select * from {lines} where path not like '%.md')", 6, 4, 27)})
      union all select {KEYS}, line, 'COMPLEX-FUNCTION', 'COMPLEXITY', severity from ({complex_sql(lines, 4, 9)})
      union all select {KEYS}, first, 'DUPLICATED-BLOCK', 'DUPLICATION', 'MAJOR' from ({same_file_sql(windows_sql(lines))})
      union all select project_id, analysis_id, path_a, line_a, 'DUPLICATED-BLOCK', 'DUPLICATION', 'MAJOR' from ({cross_file_sql(windows_sql(lines))}))"""


@query(every_sql(EVERY_LINE))
def r10_eight_scanners(spark, sf_dir):
    """Line rules, leftovers, numbers, style, swallowed exceptions, long and complex blocks, duplicates: one list."""
    nested = code_files(spark, sf_dir, NESTED).withColumn("analysis_id", F.lit(2))
    rows = code_files(spark, sf_dir).unionByName(nested).unionByName(by_language(spark, sf_dir))
    return every_finding(rows, sources=(".py", ".java", ".md"), limits={"method": 6, "class_": 4, "file": 27, "minor": 4, "major": 9}).select(*HIT, "source", "severity")


# --- scalar functions ------------------------------------------------------------------------------------------------

TOKENS = """(select doc_id, list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: (length(x) + 3) // 4)) w, length(text) n,
  list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: length(x))) nw, regexp_extract_all(text, '[^\\pL\\pN_\\s]+') m, regexp_extract_all(text, '\\s+') s from documents)"""


@query(
    f"select doc_id, cast(coalesce(w, 0) + coalesce(list_sum(list_transform(m, lambda x: (length(x) + 1) // 2)), 0) + len(s) + greatest(n - coalesce(nw, 0) - coalesce(list_sum(list_transform(m, lambda x: length(x))), 0) - coalesce(list_sum(list_transform(s, lambda x: length(x))), 0), 0) as bigint) as tokens from {TOKENS}"
)
def x_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("select p_partkey, nullif(regexp_extract(p_brand, '([0-9]+)', 1), '')[1:1] as major, left(p_type, 9) || case when length(p_type) > 9 then '…' else '' end as short from part")
def x_version_and_clip(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    version = F.concat(F.lit("v"), F.substring(F.regexp_extract("p_brand", "([0-9]+)", 1), 1, 1), F.lit(".2"))
    return p.select("p_partkey", T.version_major(version).alias("major"), T.clipped(F.col("p_type"), 9).alias("short"))


@query(f"select 'long' as scanner, {KEYS}, line, 'LONG-LINE' as rule_key from {LINES} where length(text) > 400")
def x_user_scanner(spark, sf_dir):
    scanners.register_scanner("long", scanners.long_lines(400))
    return scanners.scanned(files(spark, sf_dir), ["long"])
