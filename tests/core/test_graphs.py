"""Cycles by both ways, keys of analyses, and symbols of whole files."""

import random

import pytest

from codehealth.operators import graph as G
from codehealth.operators import symbols as Y
from codehealth.operators.cycles import components_of, cycles, thinned

SCHEMA = "project_id string, source int, target int"


def reachable(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for a in after:
        seen, todo = set(), [a]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[a] = seen
    return out


def brute(edges):
    r = reachable(edges)
    own = {tuple(sorted({a} | {b for b in r[a] if a in r.get(b, ())})) for a in r if a in r[a]}
    return sorted([x for x in own if len(x) > 1] + [(a,) for a, b in set(edges) if a == b])


def graphs():
    rng = random.Random(3)
    yield [(i, i + 1) for i in range(30)]
    yield [(i, (i + 1) % 30) for i in range(30)]
    yield [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (5, 5), (9, 9), (6, 0), (5, 7)]
    yield [(0, 1), (1, 0), (0, 2), (2, 0)]
    for n, m in ((12, 14), (40, 60), (40, 120)):
        yield [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("in_one", [200_000, 40, 0])
def test_both_ways_find_the_components(spark, tmp_path, in_one):
    all_of_them = list(graphs())
    rows = [(f"g{k}", a, b) for k, edges in enumerate(all_of_them) for a, b in edges]
    got = {}
    for r in cycles(spark.createDataFrame(rows, SCHEMA), str(tmp_path), in_one=in_one).collect():
        assert r["source"] == r["members"][0] and r["target"] == r["members"][-1]
        got.setdefault(r["project_id"], []).append(tuple(r["members"]))
    assert {k: sorted(v) for k, v in got.items()} == {f"g{k}": want for k, edges in enumerate(all_of_them) if (want := brute(edges))}


def test_search_of_one_graph():
    rng = random.Random(5)
    for _ in range(200):
        edges = [(a, b) for a, b in ((rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(20))) if a != b]
        assert sorted(map(tuple, components_of([a for a, _ in edges], [b for _, b in edges]))) == brute(edges)


def test_a_long_chain_takes_few_jobs(spark, tmp_path):
    n = 10_000
    chain = spark.range(n - 1).selectExpr("'p' project_id", "cast(id as int) source", "cast(id + 1 as int) target")
    closed = chain.unionByName(spark.createDataFrame([("p", n - 1, n // 2)], SCHEMA))
    own = cycles(closed, str(tmp_path), in_one=0)
    tables = len(list(tmp_path.iterdir()))
    assert tables <= 40
    assert [len(r["members"]) for r in own.collect()] == [n // 2]


def test_mixed_sizes_and_keys(spark, tmp_path):
    rows = [("p", 1, 1, 2), ("p", 1, 2, 1), ("p", 2, 1, 2), ("p", 2, 2, 3), ("p", 2, 3, 4), ("p", 2, 4, 1), ("q", 1, 1, 2)]
    e = spark.createDataFrame(rows, "project_id string, analysis_id int, source int, target int")
    got = sorted((r["project_id"], r["analysis_id"], tuple(r["members"])) for r in cycles(e, str(tmp_path), in_one=2).collect())
    assert got == [("p", 1, (1, 2)), ("p", 2, (1, 2, 3, 4))]
    assert [tuple(r["members"]) for r in cycles(e.filter("analysis_id = 1").select("source", "target"), str(tmp_path)).collect()] == [(1, 2)]
    assert cycles(e.filter("false"), str(tmp_path)).count() == 0


def test_nodes_of_two_analyses_stay(spark):
    n = spark.createDataFrame([("p", a, "k", "Name", "ENTITY", "f", 1) for a in (1, 2, 2)], "project_id string, analysis_id int, node_key string, name string, node_type string, file_path string, line int")
    assert sorted(r["analysis_id"] for r in G.distinct_nodes(n).collect()) == [1, 2]
    calls = spark.createDataFrame([("p", 1, "x", "name"), ("p", 3, "x", "name")], "project_id string, analysis_id int, source string, called string")
    assert [(r["analysis_id"], r["target"]) for r in G.resolved_calls(calls, n).collect()] == [(1, "k")]


# --- symbols of whole files -------------------------------------------------------------------------------------------


#: path, text, symbols with their lines, names that they call.
PARSED = [
    ("A.java", "class A {\n  Repo repo;\n  void a() { repo.find(); }\n}\n", {"A": 1}, {"A": {"Repo", "find"}}),
    ("A.java", "/* class B {\n */ class A { String s = \"}\\\"}\"; char c = '}'; // }\n void f() { g(); }\n}\nclass C { void h() { k(); } }", {"A": 2, "C": 5}, {"A": {"g"}, "C": {"k"}}),
    ("A.java", "class A {\n  class B {\n    void f() { x(); }\n  }\n  void g() { y(); class L { } }\n}\nenum E { P; class Q { } }", {"A": 1, "B": 2}, {"A": {"x", "y"}, "B": {"x"}}),
    ("a.py", "def f():\n    x = '''\ndef g():\n    no()\n'''\n    h(\nx)\n    k()\n", {"f": 1}, {"f": {"h", "k"}}),
    ("a.py", "x = 1 # def f():\nclass C:\n    def m(self): self.a.b()\nif x:\n    no()\n", {"C": 2}, {"C": {"self", "b"}}),
    ("a.go", "func (r *Repo) A() { r.b() }\nfunc (r *Repo) B() { c() }\nfunc D() {\n\ts := `}`\n\te()\n}\n", {"Repo": 1, "D": 3}, {"Repo": {"r", "b", "c"}, "D": {"e"}}),
    ("a.js", "const a = () => {\n  b()\n}\nc()\nexport function d() { return `x ${e(1)} }` }\n/* class F {} */\nlet g = h(`\n`)\n", {"a": 1, "d": 5, "g": 7}, {"a": {"b"}, "d": {"e"}, "g": {"h"}}),
    ("a.tsx", "export class A {}\nvar s = 'it\\'s {'; class B { m() { n() } }", {"A": 1, "s": 2, "B": 2}, {"B": {"n"}}),
    ("a.txt", "class A { f(); }", {}, {}),
    ("a.py", "", {}, {}),
    ("a.java", None, {}, {}),
    ("a.java", "class A { void f() { g(", {"A": 1}, {"A": {"g"}}),
    ("a.java", "} } class A { void f() { g(); } }", {"A": 1}, {"A": {"g"}}),
]


def parsed(spark, files):
    """Symbols and calls by path."""
    nodes, calls = Y.symbols_and_calls_of(spark.createDataFrame(files, "path string, content string"))
    symbols, names = {path: {} for path, _ in files}, {path: {} for path, _ in files}
    for r in nodes.collect():
        symbols[r["file_path"]][r["name"]] = r["line"]
    for r in calls.collect():
        path, name = r["source"].split("#")
        names[path].setdefault(name, set()).add(r["called"])
    return symbols, names


def test_symbols_of_whole_files(spark):
    symbols, names = parsed(spark, [(f"{k}/{path}", text) for k, (path, text, *_) in enumerate(PARSED)])
    for k, (path, _, nodes_, calls_) in enumerate(PARSED):
        assert (symbols[f"{k}/{path}"], names[f"{k}/{path}"]) == (nodes_, calls_), k


def test_long_strings_and_comments_do_not_overflow(spark):
    text = "/*" + "x'\"\n" * 200_000 + "*/\nclass A { String s = \"" + "\\\"a" * 50_000 + "\"; void f() { g(); } }"
    symbols, names = parsed(spark, [("A.java", text)])
    assert symbols["A.java"] == {"A": 200_002} and names["A.java"] == {"A": {"g"}}


def test_a_dense_graph_is_thinned(spark, tmp_path):
    """Two graphs of many edges and few nodes, too large for one group, end in one group each after a round."""
    rng = random.Random(8)
    rows = sorted({(p, rng.randrange(60), rng.randrange(60)) for p in "ab" for _ in range(3_000)} | {("b", 60, 1), ("b", 2, 61)})
    own = cycles(spark.createDataFrame(rows, SCHEMA), str(tmp_path), in_one=500)
    assert len(list(tmp_path.iterdir())) <= 9
    got = sorted((r["project_id"], tuple(r["members"])) for r in own.collect() if len(r["members"]) > 1)
    assert got == [("a", tuple(range(60))), ("b", tuple(range(60)))]


def test_thinned_edges_make_the_same_components():
    rng = random.Random(6)
    for _ in range(200):
        edges = [(a, b) for a, b in ((rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(30))) if a != b]
        few = thinned([a for a, _ in edges], [b for _, b in edges])
        assert brute(few) == brute(edges) and len(few) <= max(len(set(edges)), 16)
