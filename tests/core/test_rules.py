"""Inventory, line rules, blocks and duplicates on small files with known results."""

import pytest
from pyspark.sql import functions as F

from codehealth.functions import text as T
from codehealth.operators import code_blocks as B
from codehealth.operators import documents as O
from codehealth.operators import line_rules as R
from codehealth.sources import inventory as I


def files(spark, **content):
    rows = [(name.replace("__", "."), body) for name, body in content.items()]
    return spark.createDataFrame(rows, "path string, content string")


def found(spark, content, path="a.py", scan=R.scan_lines):
    return sorted((r["rule_key"], r["line"]) for r in scan(R.lines_of(spark.createDataFrame([(path, content)], "path string, content string"))).collect())


def scalar(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("path,want", [("a/B.java", "Java"), ("x.TSX", "TypeScript"), ("Dockerfile", "Dockerfile"), (".py", "OTHER"), ("noext", "OTHER"), ("a.b/c.rs", "Rust"), ("q.zig", "OTHER")])
def test_language(spark, path, want):
    assert scalar(spark, path, T.language) == want


@pytest.mark.parametrize("text,want", [("", 0), ("\n\n", 0), ("#!/bin/sh\nx=1\n", 1), ("a\n// b\n# c\n/* d\ne\n*/ f\n/* g */\nh", 3), ("/* a */ b\nc", 1)])
def test_lines_of_code(spark, text, want):
    assert scalar(spark, text, T.loc) == want


@pytest.mark.parametrize("text,want", [("hello", 2), ("a", 1), ("code", 1), ("!!!", 2), ("", 0), ("a b", 3), ("中文", 3)])
def test_token_estimate(spark, text, want):
    assert scalar(spark, text, T.token_estimate) == want


def test_default_ignores(spark):
    good = ["src/a.js", "src/lib/util.py", "README.md", ".github/x.yml", ".gitignore"]
    bad = ["node_modules/a.js", ".git/config", "x/dist/a.js", "target/a", "package-lock.json", "app.min.js", "b.js.map", ".hidden", "web/node_modules/x.js"]
    rows = spark.createDataFrame([(x,) for x in good + bad], "path string").select("path", I.ignored(F.col("path")).alias("i")).collect()
    assert {r["path"]: r["i"] for r in rows} == {**dict.fromkeys(good, False), **dict.fromkeys(bad, True)}


def test_last_custom_rule_wins(spark):
    f = spark.createDataFrame([("p", "generated/a.js"), ("p", "generated/keep.js"), ("p", "src/x.js")], "project_id string, path string")
    r = spark.createDataFrame([("p", 1, "generated/", False), ("p", 2, "generated/keep.js", True)], "project_id string, ord int, value string, negate boolean")
    assert {x["path"]: x["custom"] for x in I.custom_ignored(f, r).collect()} == {"generated/a.js": True, "generated/keep.js": False, "src/x.js": None}


def test_inventory_of_a_folder(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "b.js": b"a\nb\n", "bin.py": bytes([0, 1, 2]), "big.py": b"y\n" * 60, "node_modules/c.js": b"z"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = I.read_files(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", f"^.*{tmp_path.name}/", ""))
    inv = I.inventory(rows, 100).withColumn("project_id", F.lit("p"))
    assert {r["path"]: r["status"] for r in inv.collect()} == {"a.py": "kept", "b.js": "kept", "bin.py": "binary", "big.py": "big", "node_modules/c.js": "ignored"}
    s = I.summary(inv).first()
    assert (s["loc_total"], s["file_count"], s["ignored_count"], s["skipped_big"], s["truncated"], s["lang_stats"]) == (3, 2, 2, 1, False, {"Python": 33.3, "JavaScript": 66.7})


@pytest.mark.parametrize(
    "line,want",
    [
        ('password = "supersecret1"', ["SECRET-HARDCODED"]),
        ("os.system(cmd)", ["DANGEROUS-CALL"]),
        ('q = "SELECT * FROM t WHERE id=" + uid', ["SQL-INJECTION"]),
        ("pickle.loads(x)", ["DANGEROUS-CALL"]),
        ("h = hashlib.md5(x)", ["DANGEROUS-CALL"]),
        ("if password == given:", ["PLAINTEXT-PASSWORD-COMPARE"]),
        ("x = evaluate(3)", []),
        ('token = "abcdefgh"; eval(x)', ["SECRET-HARDCODED"]),
    ],
)
def test_security_rules(spark, line, want):
    assert [x[0] for x in found(spark, f"ok\n{line}\n")] == want


def test_leftovers(spark):
    text = "x = 1  # TODO: later\ny = 'TODO'\n// FIXME now\n" + "# TODO\n" * 12
    got = found(spark, text, scan=R.leftovers)
    assert got[0] == ("LEFTOVER-FIXME", 3) and len(got) == 10 and ("LEFTOVER-TODO", 2) not in got


def test_magic_numbers(spark):
    text = 'if x > 300:\n  y = call(300, 777)\nMAX = 500\nz = f(1024)\ns = "999"\n# 888\nconst a = 123\nw = g(abc12345)'
    assert found(spark, text, scan=R.magic_numbers) == [("MAGIC-NUMBER", 1), ("MAGIC-NUMBER", 2)]


def test_swallowed_exceptions(spark):
    text = "try:\n  f()\nexcept Exception:\n  # why\n  pass\ntry:\n  g()\nexcept E:\n  log()\n"
    assert found(spark, text, scan=R.swallowed) == [("SWALLOWED-EXCEPTION", 3)]
    java = spark.createDataFrame([("A.java", "try {\n a();\n} catch (E e) {\n // no\n}\ntry { b(); } catch (E e) { }\ntry {\n} catch (E e) {\n log(e);\n}\n")], "path string, content string")
    assert sorted(r["line"] for r in B.empty_catches(java).collect()) == [3, 6]


def test_style(spark):
    rows = [("a", i + 1, t) for i, t in enumerate(["﻿x ", "\ty", " z", "w\t", "v ", " \tu"])]
    got = sorted((r["rule_key"], r["line"]) for r in R.style(spark.createDataFrame(rows, "path string, line int, text string")).collect())
    assert got == [("INCONSISTENT-INDENT", 1), ("MIXED-INDENT", 6), ("TRAILING-WHITESPACE", 1), ("UTF8-BOM", 1)]


def test_annotation(spark):
    lines = R.lines_of(spark.createDataFrame([("a.py", "x = 1\ny = 2\nz = 3\n")], "path string, content string"))
    issues = spark.createDataFrame([("a.py", 2, "CRITICAL"), ("a.py", 2, "MAJOR"), ("a.py", 5, "MINOR"), ("b.py", 1, "MAJOR"), ("a.py", None, "MINOR")], "path string, line int, severity string")
    assert sorted(map(tuple, R.annotated(lines, issues).collect())) == [("a.py", 1, 0, None), ("a.py", 2, 2, "error"), ("a.py", 3, 0, None)]


def test_blocks(spark):
    java = "class A {\n  void f() {\n    if (x) {\n    }\n  }\n}\n"
    py = "def f():\n  a\n\n  b\ndef g():\n  c\n"
    both = files(spark, A__java=java, b__py=py)
    assert sorted(map(tuple, B.block_ends(both.filter("path = 'A.java'"), B.BRACE_CLASS).collect())) == [("A.java", 0, 5)]
    assert sorted(map(tuple, B.indent_ends(both.filter("path = 'b.py'")).collect())) == [("b.py", 0, 3), ("b.py", 4, 5)]
    assert {(r["path"], r["rule_key"]) for r in B.bloated(both, 3, 5, 100).collect()} == {("A.java", "BLOATED-METHOD"), ("A.java", "BLOATED-CLASS"), ("b.py", "BLOATED-METHOD")}


def test_complexity(spark):
    body = "def f(x):\n" + "".join(f"{'  ' * (i + 1)}if x > {i}:\n" for i in range(5)) + "            pass\n"
    got = B.complex_functions(files(spark, a__py=body), 12, 20).collect()
    assert [(r["line"], r["score"], r["severity"]) for r in got] == [(1, 15, "MINOR")]


def test_duplicates(spark):
    snippet = "\n".join(f"    r{i} = process_item(item, config)" for i in range(8))
    lines = R.lines_of(files(spark, a__py=f"{snippet}\n\n{snippet}", b__py=snippet.replace("    ", "\t"), c__py="x\ny\n").withColumn("project_id", F.lit("p")), "project_id")
    w = B.windows(lines)
    assert {(r["path"], r["first"], r["second"]) for r in B.same_file_duplicates(w).collect()} == {("a.py", i, i + 9) for i in (1, 2, 3)}
    assert [(r["path_a"], r["path_b"]) for r in B.cross_file_duplicates(w).collect()] == [("a.py", "b.py")]


def two_projects(spark, content, path="src/a.py"):
    """The same path in two projects, and in two analyses of one of them."""
    rows = [("p", 1, path, content), ("q", 1, path, content), ("q", 2, path, content)]
    return spark.createDataFrame(rows, "project_id string, analysis_id int, path string, content string")


@pytest.mark.parametrize(
    "content,scan,n",
    [
        ("# TODO x\n" * 8, R.leftovers, 8),
        ("".join(f"f({k}{k}{k}, a)\n" for k in range(1, 6)), R.magic_numbers, 5),
        ("try:\n  f()\nexcept E:\n  pass\n", R.swallowed, 1),
        ("a \nb \nc \n", R.style, 1),
        ("eval(x)\n", R.scan_lines, 1),
        ("".join(f"line {k} of many\n" for k in range(8)), B.windows, 3),
        ("\n".join(f"same {k}" for k in [*range(8), *range(8)]), lambda x: B.same_file_duplicates(B.windows(x)), 3),
    ],
)
def test_files_of_other_projects_are_other_files(spark, content, scan, n):
    got = scan(R.lines_of(two_projects(spark, content))).groupBy("project_id", "analysis_id").count().collect()
    assert {(r["project_id"], r["analysis_id"]): r["count"] for r in got} == {("p", 1): n, ("q", 1): n, ("q", 2): n}


def test_blocks_of_other_projects_are_other_blocks(spark):
    code = "def f(x):\n" + "".join(f"{'  ' * (i + 1)}if x > {i}:\n" for i in range(5)) + "            pass\n"
    files_ = two_projects(spark, code)
    assert B.complex_functions(files_).count() == 3 and B.indent_ends(files_).count() == 3 and B.bloated(files_, 3, 9, 9).count() == 3
    catch = two_projects(spark, "try {\n} catch (E e) {\n}\n", "A.java")
    assert B.empty_catches(catch).count() == 3
    lines = R.lines_of(files_)
    assert B.cross_file_duplicates(B.windows(lines)).count() == 0  # equal files of different projects share nothing
    assert R.annotated(lines, R.scan_lines(R.lines_of(two_projects(spark, "eval(x)\n")))).filter("issues = 1").count() == 3


def test_all_findings_in_one_pass_are_those_of_the_scanners(spark):
    text = "eval(x)\n# TODO a\npassword = 'abcdefgh1'\ny = f(777, 888)\nz = g(777)\nq \nr \ns \n\tt\n u\n" + "// FIXME\n" * 12
    files_ = two_projects(spark, text)
    lines, columns = R.lines_of(files_), ["project_id", "analysis_id", "path", "line", "rule_key", "source", "kind", "severity", "message"]
    parts = R.all_issues(None, R.scan_lines(lines), R.leftovers(lines), R.magic_numbers(lines), R.style(lines))
    assert sorted(map(tuple, R.findings(files_).select(columns).collect())) == sorted(map(tuple, parts.select(columns).collect()))


@pytest.mark.parametrize("line,hit", [("yaml.load(f)", True), ("yaml.load(f, Loader=SafeLoader)", True), ("yaml.load(f); SafeLoader", False), ("yaml.safe_load(f)", False), ("x.md5 (y)", True), ("subprocess(a, shell=True)", True)])
def test_fixed_patterns(spark, line, hit):
    assert bool(found(spark, line)) == hit


def test_rules_from_a_table(spark):
    schema = "ord int, rule_key string, source string, kind string, severity string, pattern string, also string, last boolean, needs array<string>"
    rules = spark.createDataFrame([(2, "B", "S", "K", "MINOR", "b", None, False, None), (1, "A", "S", "K", "MAJOR", "a", "c", True, ["a"])], schema)
    R.register_rules(rules, "mine")
    got = R.scan_registered(R.lines_of(files(spark, a__py="a c b\na b\nb"))).filter("rule_key in ('A', 'B')")
    assert sorted((r["line"], r["rule_key"]) for r in got.collect()) == [(1, "A"), (2, "B"), (3, "B")]


def brute_spans(text, starts, cumulative):
    lines, out, depth = text.split("\n"), [], []
    for x in lines:
        depth.append((depth[-1] if depth else 0) + x.count("{") - x.count("}"))
    indent = [10**6 if not x.strip() else len(x) - len(x.lstrip(" ")) for x in lines]
    for i, x in enumerate(lines):
        if starts(x):
            if cumulative:
                before = depth[i - 1] if i else 0
                out.append((i, next((k for k in range(i + 1, len(lines)) if depth[k] <= before), len(lines) - 1)))
            else:
                out.append((i, next((k for k in range(i + 1, len(lines)) if indent[k] <= indent[i]), len(lines)) - 1))
    return sorted(out)


def test_block_ends_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    for n in range(12):
        text = "\n".join("  " * rng.randint(0, 3) + rng.choice(["def f(", "{", "}", "x {", "} y {", "", "z", "{ {", "} }"]) for _ in range(rng.randint(1, 40)))
        one = spark.createDataFrame([("p", "a.x", text + "\nend")], "project_id string, path string, content string")
        for cumulative, got in ((True, B.block_ends(one, "[{]$")), (False, B.indent_ends(one, "def f"))):
            starts = (lambda x: x.endswith("{")) if cumulative else (lambda x: "def f" in x)
            assert sorted((r["start"], r["end"]) for r in got.collect()) == brute_spans(text + "\nend", starts, cumulative), text


def test_endpoints(spark):
    java = '@RequestMapping("/api/v1")\nclass C {\n  @GetMapping("/users")\n  public List<U> listUsers() {\n  }\n  @PostMapping("/users")\n  public U add(U u) {\n}'
    got = O.endpoints(R.lines_of(files(spark, C__java=java))).orderBy("line").collect()
    assert [(r["verb"], r["route"], r["method"]) for r in got] == [("GET", "/api/v1/users", "listUsers"), ("POST", "/api/v1/users", "add")]
