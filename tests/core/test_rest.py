"""History, graphs, manifests, scores, debt, retrieval, sinks and streams."""

import pytest
from pyspark.sql import functions as F

from codehealth.operators import debt as D
from codehealth.operators import graph as G
from codehealth.operators import history as H
from codehealth.operators import retrieval as K
from codehealth.operators import scoring as C
from codehealth.operators.cycles import cycles
from codehealth.sources import manifests as M
from codehealth.sources import snapshots as S
from codehealth.streaming import jobs as J


def commits(spark, *days):
    rows = spark.createDataFrame([(str(i), d) for i, d in enumerate(days)], "commit_hash string, at string")
    return rows.select("commit_hash", F.lit("a").alias("author_name"), F.try_to_timestamp("at").alias("committed_at"), F.lit(1).alias("added"), F.lit(0).alias("removed"))


@pytest.mark.parametrize(
    "days,want",
    [
        (("2026-07-20", "2026-07-21", "2026-08-10"), {"2026-07-20": 2, "2026-08-10": 1}),
        (("2025-12-29", "2025-12-30", "2026-01-05"), {"2025-12-29": 2, "2026-01-05": 1}),
        (("2026-07-26T18:00:00Z", "2026-07-27T02:00:00+08:00"), {"2026-07-20": 2}),
        (("never",), {"": 1}),
    ],
)
def test_weeks_start_on_monday(spark, days, want):
    assert {r["week"]: r["commits"] for r in H.weekly_trend(commits(spark, *days)).collect()} == want


def test_hotspots(spark):
    rows = [(i, "hot" if i < 17 else "warm", 40, 0) for i in range(20)]
    found = H.hotspots(spark.createDataFrame(rows, "commit_hash int, path string, added int, removed int"))
    assert {r["module"]: r["risk_level"] for r in found.collect()} == {"hot": "HIGH", "warm": "MEDIUM"}


@pytest.mark.parametrize(
    "edges,want",
    [
        (["ab", "bc", "cd"], []),
        (["ab", "bc", "ca"], ["a,b,c"]),
        (["ab", "ba", "xy", "yz", "zx"], ["a,b", "x,y,z"]),
        (["aa"], ["a"]),
        (["ab", "bc", "cb"], ["b,c"]),
        (["ab", "bc", "ca", "cd", "de", "ed", "ef", "ff"], ["a,b,c", "d,e", "f"]),
    ],
)
def test_cycles(spark, tmp_path, edges, want):
    e = spark.createDataFrame([("p", x[0], x[1]) for x in edges], "project_id string, source string, target string")
    got = cycles(e, str(tmp_path)).select(F.array_join("members", ",").alias("m"), "source", "target").collect()
    assert sorted(r["m"] for r in got) == want and all(r["m"].startswith(r["source"]) and r["m"].endswith(r["target"]) for r in got)


def test_symbols_calls_and_layers(spark):
    text = ["class OrderService:", "def place(order):", "    repo.save(order)", "    return helper(order)", "def helper(x):", "    return x"]
    rows = [("p", "app/service.py", "py", i + 1, t) for i, t in enumerate(text)]
    nodes, calls = G.symbols_and_calls(spark.createDataFrame(rows, "project_id string, path string, language string, line int, text string"))
    assert {r["name"] for r in nodes.collect()} == {"OrderService", "place", "helper"}
    edges = G.resolved_calls(calls, nodes)
    assert [(r["source"][-5:], r["target"][-6:]) for r in edges.collect()] == [("place", "helper")]
    kinds = spark.createDataFrame([("p", "a", "CONTROLLER"), ("p", "b", "REPOSITORY")], "project_id string, node_key string, node_type string")
    bad = G.violations(spark.createDataFrame([("p", "a", "b"), ("p", "b", "a")], "project_id string, source string, target string"), kinds)
    assert [(r["source"], r["severity"]) for r in bad.collect()] == [("a", "HIGH")]


@pytest.mark.parametrize("language,text,nodes_,calls_", [
    ("java", "public class OrderController {\n  private final OrderService service;\n  @Inject private Map<String, Repo> repos;\n  void a() {\n    service.load(1);\n    this.repo.save(x); // gone(1)\n    s = \"no(1)\";\n  }\n  static class Inner {\n    int b() { return new Helper().run(); }\n  }\n}", {"OrderController": 1, "Inner": 9}, {("OrderController", "OrderService"), ("OrderController", "load"), ("OrderController", "repo"), ("OrderController", "save"), ("OrderController", "a"), ("Inner", "b"), ("Inner", "Helper"), ("Inner", "run")}),
    ("go", "func (s *Service) Get(id int) {\n\ts.repo.Find(id)\n}\nfunc (Service) Put() {\n}\nfunc main() {\n\tNew(1)\n}", {"Service": 1, "main": 6}, {("Service", "Get"), ("Service", "s"), ("Service", "Find"), ("Service", "Put"), ("main", "New")}),
    ("py", "import os\ndef f(\n    a,\n):\n    g(a)  # no(1)\n\nrun(1)\nclass C:\n    def m(self):\n        self.x.y('z(1)')", {"f": 2, "C": 8}, {("f", "g"), ("C", "m"), ("C", "self"), ("C", "y")}),
    ("ts", "export default class A {\n  b() { return c.d(); }\n}\nexport const e = () => f()\n  const no = 1", {"A": 1, "e": 4}, {("A", "b"), ("A", "c"), ("A", "d"), ("e", "f")}),
])
def test_symbols_of_each_language(spark, language, text, nodes_, calls_):
    rows = [(p, "f", language, i + 1, t) for p in ("p", "q") for i, t in enumerate(text.split("\n"))]
    nodes, calls = G.symbols_and_calls(spark.createDataFrame(rows, "project_id string, path string, language string, line int, text string"))
    for p in ("p", "q"):
        assert {r["name"]: r["line"] for r in nodes.filter(F.col("project_id") == p).collect()} == nodes_
        assert {(r["source"][2:], r["called"]) for r in calls.filter(F.col("project_id") == p).collect()} == calls_


def test_chunks_of_source_files(spark):
    py = "import os\n\ndef f():\n    return 1\n\nclass C:\n    def m(self):\n        return 2\nx = f()\n"
    java = "package a;\npublic class B {\n  void m() {\n  }\n}\n"
    long_ = "def g():\n" + "".join(f"    word{i} = other{i}\n" for i in range(400))
    rows = [(p, path, t) for p in ("p", "q") for path, t in (("a.py", py), ("B.java", java), ("g.py", long_), ("e.py", ""), ("n.txt", py), ("blank.py", "\n \n"))]
    chunks = K.source_chunks(spark.createDataFrame(rows, "project_id string, path string, content string"))
    got = {p: [tuple(r) for r in chunks.filter((F.col("project_id") == "p") & (F.col("path") == p)).orderBy("chunk_index").select("chunk_index", "symbol", "start_line", "end_line", "content").collect()] for p in ("a.py", "B.java", "g.py", "blank.py")}
    assert got["a.py"] == [(0, "f", 3, 5, "def f():\n    return 1\n"), (1, "C", 6, 8, "class C:\n    def m(self):\n        return 2"), (2, None, 1, 9, "import os\n\nx = f()")]
    assert got["B.java"] == [(0, "B", 2, 5, "public class B {\n  void m() {\n  }\n}"), (1, None, 1, 5, "package a;")]
    assert len(got["g.py"]) > 3 and {x[1:4] for x in got["g.py"]} == {("g", 1, 401)} and all(x[4] in long_ for x in got["g.py"])
    assert "".join(got["g.py"][0][4]).startswith("def g()") and got["blank.py"] == [] and chunks.groupBy("project_id").count().select("count").distinct().count() == 1
    few = K.source_chunks(spark.createDataFrame(rows, "project_id string, path string, content string"), most=3)
    assert {r["path"] for r in few.collect()} == {"B.java", "a.py"}  # the third chunk stands in a.py, which stays whole


def test_symbols_of_all_lines(spark, tmp_path):
    from codehealth.plans.graph import g2_symbols

    rows = [(1, "Alpha one\n12 run(a.b.load (x))\nBeta two\nAlpha again; if (z)\n", "s"), (2, "no(\nGamma three go()", "s"), (3, None, "s"), (4, "", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in g2_symbols(spark, str(tmp_path)).collect()} == {("s/1", "Alpha", 1), ("s/1", "Beta", 3), ("s/2", "Gamma", 2)}


POM = """<project><parent><version>3.0</version></parent><version>1.0.0</version><dependencyManagement><dependencies><dependency><groupId>g</groupId>
<artifactId>managed</artifactId><version>9</version></dependency></dependencies></dependencyManagement><dependencies><dependency><groupId>org.springframework.boot</groupId>
<artifactId>spring-boot-starter-web</artifactId><version>2.5.14</version></dependency><dependency><groupId>l</groupId><artifactId>lombok</artifactId></dependency></dependencies></project>"""
PACKAGE = '{"dependencies": {"vue": "^2.6.14", "axios": "~1.7.0", "x": "git+https://h/x"}, "devDependencies": {"vite": "5.4.0", "vue": "9"}}'


def test_manifests_and_end_of_life(spark):
    nested = [("p", f"{x}{name}", body) for x in ("sub/", "sub/x-", "x-") for name, body in (("pom.xml", POM.replace("lombok", "no")), ("package.json", PACKAGE.replace("axios", "no")))]
    m = spark.createDataFrame([("p", "pom.xml", POM), ("p", "package.json", PACKAGE), *nested], "project_id string, path string, content string")
    deps = M.maven(m).unionByName(M.npm(m))
    got = {r["name"]: (r["version"], r["is_eol"]) for r in G.eol_matches(deps).collect()}
    assert got == {"org.springframework.boot:spring-boot-starter-web": ("2.5.14", True), "l:lombok": ("1.0.0", False), "vue": ("2.6.14", True), "axios": ("1.7.0", False), "x": (None, False), "vite": ("5.4.0", False)}


def test_commit_log(spark):
    log = "@a1\tann\t2026-01-05T10:00:00Z\n3\t1\tx.py\n-\t-\tpic.png\n2\t0\tx.py\n@b2\t\t2026-01-06T10:00:00Z\n"
    commits_, files = M.commit_log(spark.createDataFrame([("p", log)], "project_id string, content string"))
    assert sorted((r["commit_hash"], r["files_changed"], r["added"], r["removed"]) for r in commits_.collect()) == [("a1", 2, 5, 1), ("b2", 0, 0, 0)]
    assert sorted((r["path"], r["added"]) for r in files.collect()) == [("pic.png", 0), ("x.py", 5)]


def scan(spark, **given):
    base = dict(loc_total=5000, file_count=3, has_backend=True, has_frontend=True, has_top_dir=False, skipped_big=0, truncated=False, bugs=None, vulnerabilities=None, code_smells=None, duplication_rate=None, coverage_rate=None, complexity=None) | given
    types = dict(has_backend="boolean", has_frontend="boolean", has_top_dir="boolean", truncated="boolean", duplication_rate="double", coverage_rate="double", complexity="double")
    frame = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {types.get(k, 'long')}" for k in base))
    return C.scored(frame.withColumn("frameworks", F.array(F.lit("Vue"))))


def test_scores(spark):
    r = scan(spark, bugs=3, vulnerabilities=2, code_smells=60, duplication_rate=15.0, coverage_rate=30.0, complexity=6.0).first()
    assert r["quality"] == 85 - 9 - 10 - 0 - 1 - 8 - 5
    r = scan(spark, skipped_big=3, truncated=True)
    assert r.first()["quality"] == 55 and "big files" in [x["title"] for x in r.select(C.risks().alias("r")).first()["r"]]
    r = scan(spark).first()
    assert (r["quality"], r["structure"], r["dependency"], r["scale"], r["health"], r["level"]) == (75, 85, 75, 90, 80, "GOOD")


def test_report_validation(spark):
    dims = ", ".join(f'{{"key": "{k}", "score": 70}}' for k, _ in C.WEIGHTS)
    good = f'{{"healthScore": 99, "dimensions": [{dims}]}}'
    rows = [(1, good, 70), (2, "nope", 70), (3, good.replace("scale", "x"), 70), (4, good.replace("]}", '], "risks": [{"title": ""}]}'), 70)]
    got = C.validated(spark.createDataFrame(rows, "id int, report_json string, base_health int")).orderBy("id").collect()
    assert [(r["health_score"], r["source"]) for r in got] == [(80, "CANDIDATE"), (70, "RULES"), (70, "RULES"), (70, "RULES")]


def test_risk_diff(spark):
    side = lambda *t: spark.createDataFrame([("p", x) for x in t], "project_id string, title string")
    assert {r["title"]: r["change"] for r in C.risk_diff(side("B", "C"), side("A", "C")).collect()} == {"A": "added", "B": "removed", "C": "kept"}


def test_debt_changes(spark):
    rows = [(1, 1, "DOING", None, None), (1, 2, "DONE", " ", None), (1, 3, "DONE", "done", None), (1, 4, "OPEN", None, None), (2, 1, "WONTFIX", None, ""), (2, 2, "WONTFIX", None, "no")]
    got = D.status_changes(spark.createDataFrame(rows, "debt_id int, seq int, target string, note string, reason string")).orderBy("debt_id", "seq").collect()
    assert [(r["before"], r["why"]) for r in got] == [("OPEN", None), ("DOING", "missing note"), ("DOING", None), ("DONE", "illegal change"), ("OPEN", "missing reason"), ("OPEN", None)]


def test_citations(spark):
    answers = spark.createDataFrame([(1, "a [src/UserService.java:12] b [pom.xml:3] [fake/NotExist.java:1] [src/UserService.java:99] [UserService.java:15]"), (2, "none")], "answer_id int, text string")
    hits = spark.createDataFrame([(1, "src/UserService.java", 10, 30), (1, "pom.xml", 1, 50)], "answer_id int, file string, start_line int, end_line int")
    assert sorted(map(tuple, K.citations(answers, hits).collect())) == [(1, "pom.xml", 3), (1, "src/UserService.java", 12), (1, "src/UserService.java", 15)]


def test_keywords_and_chunks(spark):
    one = spark.createDataFrame([("How is the error error error handler of 数据 done",)], "t string")
    assert one.select(K.keywords(F.col("t"), 3)).first()[0] == ["error", "handler", "done"]
    long_ = spark.createDataFrame([(1, "word " * 2000), (2, "short text"), (3, None)], "id int, text string")
    rows = K.token_windows(long_, "id").orderBy("id", "chunk_index").collect()
    own = [r for r in rows if r["id"] == 1]
    assert [r["chunk_index"] for r in own] == list(range(len(own))) and len(own) > 1 and all(r["n_tokens"] <= 400 for r in own)
    assert [r["content"] for r in rows if r["id"] == 2] == ["short text"]


def test_snapshot_written_twice_is_there_once(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b")], "project_id string, analysis_id int, v string")
    seen = lambda: sorted(r["v"] for r in S.snapshot(spark, f"{tmp_path}/s").collect())
    for _ in range(2):
        S.replace_snapshot(rows, f"{tmp_path}/s", rows)
    assert seen() == ["a", "b"]
    S.replace_snapshot(rows.filter("analysis_id = 2").withColumn("v", F.lit("c")), f"{tmp_path}/s", rows.filter("analysis_id = 2"))
    assert seen() == ["a", "c"]
    S.replace_snapshot(rows.limit(0), f"{tmp_path}/s", rows.filter("analysis_id = 1"))  # nothing new: cleared
    assert seen() == ["c"]


def test_issues_of_projects_without_new_ones_go(spark):
    schema = "project_id string, id int, source string, severity string, kind string, suggestion string"
    old = spark.createDataFrame([(p, i, "OLD", "MINOR", "BUG", None) for p in "abc" for i in (1, 2)], schema)
    new = spark.createDataFrame([("a", 9, None, None, None, " "), ("c", 8, "S", "MAJOR", "X", "do")], schema)
    refreshed = spark.createDataFrame([("a",), ("b",)], "project_id string")
    got = sorted((r["project_id"], r["id"], r["source"]) for r in S.replaced_issues(old, new, refreshed).collect())
    assert got == [("a", 9, "SONAR"), ("c", 1, "OLD"), ("c", 2, "OLD")]


def test_debt_of_other_projects_stays(spark):
    schema = "project_id string, source string, level string, title string, suggestion string"
    old = spark.createDataFrame([(p, s, "LOW", "old", None) for p in "ab" for s in ("ARCH", "DEPEND", "MANUAL")], schema)
    found = spark.createDataFrame([("a", "ARCH", "HIGH", "new", None), ("b", "ARCH", "HIGH", "stray", None)], schema)
    got = sorted((r["project_id"], r["source"], r["title"]) for r in D.rebuilt(old, old.filter("project_id = 'a'"), found).collect())
    assert got == [("a", "ARCH", "new"), ("a", "MANUAL", "old"), ("b", "ARCH", "old"), ("b", "DEPEND", "old"), ("b", "MANUAL", "old")]


def test_purge_goes_two_hops(spark):
    frame = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    tables = {
        "project": frame("project_id int", (1,), (2,)), "analysis": frame("project_id int, analysis_id int, status string", (1, 10, "RUNNING"), (1, 11, "FAILED"), (2, 20, "RUNNING")),
        "analysis_report": frame("analysis_id int", (10,), (11,), (20,)), "chat_session": frame("project_id int, session_id int", (1, 5), (2, 6)), "chat_message": frame("session_id int", (5,), (6,), (6,)),
        "dependency": frame("project_id int", (1,), (2,)), "settings": frame("k string", ("x",)),
    }
    left, stopped = D.purge(tables, frame("project_id int", (1,), (1,), (7,)))
    assert {k: v.count() for k, v in left.items()} == {"project": 1, "analysis": 1, "analysis_report": 1, "chat_session": 1, "chat_message": 2, "dependency": 1, "settings": 1}
    assert [(r["analysis_id"], r["status"]) for r in stopped.collect()] == [(10, "CANCELLED")]


def test_nearest_in_blocks_is_the_same(spark):
    import random

    rng = random.Random(1)
    rows = [(f"p{i % 3}", i, [rng.random() - 0.5 for _ in range(4)] if i % 11 else None) for i in range(120)]
    vectors = spark.createDataFrame(rows, "project_id string, id int, embedding array<double>")
    queries = vectors.filter("id % 7 = 0").selectExpr("id as query_id", "project_id", "embedding as q")
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = []
    for p, i, q in rows:
        if i % 7 == 0 and q:
            best = sorted((-round(cosine(q, e), 9), j) for o, j, e in rows if o == p and e)[:5]
            want += [(i, j) for _, j in best]
    for size in (8, 1 << 20):
        assert sorted((r["query_id"], r["id"]) for r in K.nearest(queries, vectors, 5, size).collect()) == sorted(want)


def files_of(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return J.file_stream(spark, f"{folder}/in")


def test_messages_seen_within_the_time_are_left_out(spark, tmp_path):
    spark.conf.set(*J.STATE_STORE)
    row = lambda i, s, content, at: (i, s, content, f"2024-01-01 00:00:{at:02d}")
    stream = files_of(spark, tmp_path, [[row(1, 1, "a", 0), row(2, 1, "b", 1), row(3, 2, "a", 1)], [row(4, 1, "a", 1), row(5, 1, "c", 40)], [row(7, 9, "z", 41)], [row(6, 1, "a", 42)]], "id long, session_id long, content string, at string")
    got = J.run_to_table(J.unrepeated(stream, "2 seconds"), "append", str(tmp_path / "job")).collect()
    assert sorted(r["id"] for r in got) == [1, 2, 3, 5, 6, 7]  # 4 repeats 1; before 6 comes, a batch has let the first be forgotten


def test_runs_without_events_fail(spark, tmp_path):
    spark.conf.set(*J.STATE_STORE)
    row = lambda run, seq, status, minute: (run, seq, status, f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00")
    first = [row(1, 1, "RUNNING", 0), row(2, 1, "PENDING", 0), row(3, 1, "RUNNING", 0)]
    batches = [first, [row(2, 2, "RUNNING", 20), row(3, 2, "SUCCEEDED", 10)], [row(4, 1, "RUNNING", 45)], [row(4, 2, "SUCCEEDED", 46)]]
    stream = files_of(spark, tmp_path, batches, "analysis_id long, seq long, status string, at string")
    got = J.run_to_table(J.stuck_runs(stream, 30), "append", str(tmp_path / "job")).collect()
    assert [(r["analysis_id"], r["status"], r["error_code"]) for r in got] == [(1, "FAILED", 5003)]  # 2 is due at minute 50


@pytest.mark.parametrize("name,text,want", [
    ("pom.xml", "<a>spring-boot mysql h2</a>", (["Maven", "Spring Boot"], ["MySQL", "H2"], True, False)),
    ("package.json", '{"dependencies": {"vue": "1", "pg": "8"}, "devDependencies": {"vite": "5"}}', (["Vue", "Vite"], ["PostgreSQL"], False, True)),
    ("requirements.txt", "Flask\nredis", (["Flask"], ["Redis"], True, False)),
    ("sub/pom.xml", "spring-boot", ([], [], False, False)),
])
def test_stack(spark, name, text, want):
    from codehealth.sources import inventory as I

    r = I.stack(spark.createDataFrame([("p", name, text)], "project_id string, path string, content string")).first()
    assert (r["frameworks"], r["databases"], r["has_backend"], r["has_frontend"]) == want


def test_upload_audit(spark):
    rows = [("a", "src/x.py", 10), ("b", "../etc/passwd", 1), ("c", "C:/x", 1), ("d", ".ssh/key", 1), ("e", "x", 10**9)]
    got = {r["archive"]: r["ok"] for r in M.upload_audit(spark.createDataFrame(rows, "archive string, name string, size_bytes long")).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False, "e": False}


def test_entry_and_queries(spark):
    import __spark_entry__ as E

    rows = E.entry(spark).collect()
    assert rows and all(0 <= r["health"] <= 100 and r["file_count"] > 0 for r in rows)
    queries, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 120
