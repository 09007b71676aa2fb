"""What the review of round 3 found."""

import pytest
from pyspark.sql import functions as F

from codehealth.operators import code_blocks as B
from codehealth.operators import neighbours as N
from codehealth.operators import retrieval as K
from codehealth.operators.line_rules import lines_of
from codehealth.operators.symbols import symbols_and_calls_of
from codehealth.plans.registry import parts_for
from codehealth.sources import manifests as M
from codehealth.streaming import jobs as J


@pytest.mark.parametrize("find", [lambda q, v, k: K.nearest(q, v, k, 8), lambda q, v, k: N.nearest_by_buckets(q, v, k, tables=2, bits=1, probes=1)])
def test_nearest_with_equal_vectors_and_without_direction(spark, find):
    rows = [("p", i, [1.0, 2.0]) for i in range(40, 0, -1)] + [("p", 50, [0.0, 0.0]), ("p", 51, [-1.0, -2.0]), ("o", 60, [1.0, 2.0]), ("o", 61, [0.0, 0.0]), ("o", 62, [-2.0, 1.0])]
    vectors = spark.createDataFrame(rows, "project_id string, id long, embedding array<float>")
    queries = spark.createDataFrame([("p", 7, [2.0, 4.0]), ("o", 8, [1.0, 2.0])], "project_id string, query_id long, q array<float>")
    got = sorted((r["query_id"], r["id"], None if r["score"] is None else round(r["score"], 9)) for r in find(queries, vectors, 3).collect())
    assert got == [(7, 1, 1.0), (7, 2, 1.0), (7, 3, 1.0), (8, 60, 1.0), (8, 61, None), (8, 62, 0.0)]


def test_chunks_of_a_large_project_are_all_there(spark):
    files = spark.range(5_200).select(F.lit("p").alias("project_id"), F.concat(F.lit("src/f"), "id", F.lit(".py")).alias("path"), F.lit("x = 1\n").alias("content"))
    assert K.source_chunks(files).count() == 5_200
    assert K.source_chunks(files, most=10).count() == 10


def test_keyword_hits_of_the_head_and_the_rest(spark):
    import random

    rng, k = random.Random(5), 3
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.choice((3, 4, 6))))
    chunks = [(f"p{i % 2}", i // 4, f"f{i % 4}", " ".join(word() for _ in range(4))) for i in range(120)]
    queries = [(f"p{i % 2}", i, sorted({word() for _ in range(2)})) for i in range(40)] + [("p0", 50, []), ("none", 51, ["abc"])]
    want = []
    for p, i, keywords in queries:
        want += [(i, f, c) for c, f in sorted((c, f) for o, c, f, text in chunks if o == p and any(w in text for w in keywords))[:k]]
    frame = spark.createDataFrame(queries, "project_id string, query_id long, keywords array<string>")
    texts = spark.createDataFrame(chunks, "project_id string, chunk_index long, file string, content string")
    for head, few in ((5, 256), (5, 1), (1_000, 256)):
        assert sorted((r["query_id"], r["file"], r["chunk_index"]) for r in K.keyword_hits(frame, texts, k, head, few).collect()) == sorted(want)


def test_windows_leave_python_a_few_texts_at_a_time(spark):
    docs = spark.range(0, 300, 1, 1).withColumn("text", F.when(F.col("id") % 3 > 0, F.lit("a b c")))
    rows = K.token_windows(docs, "id")
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [(i, 0, 3, "a b c") for i in range(300) if i % 3]
    assert "MapInArrow" in rows._jdf.queryExecution().toString()


@pytest.mark.parametrize("buckets", [1, 3])
def test_streams_of_many_sessions_in_one_group(spark, tmp_path, buckets):
    """Ids beyond 2^53 beside a session that is null; states live over batches."""
    spark.conf.set(*J.STATE_STORE)
    big = 2**53 + 1
    row = lambda i, s, content, at: (i, s, content, at and f"2024-01-01 00:00:{at:02d}")
    batches = [[row(1, big, "a", 1), row(2, None, "a", 1), row(3, big + 1, "a", 1), row(4, big, "b", 2)], [row(5, big, "b", 3), row(6, None, "a", 3), row(7, big + 1, "a", 9)], [row(8, big, "b", 5), row(9, big, None, 6), row(10, big, None, 7)]]
    schema = "id long, session_id long, content string, at string"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = J.file_stream(spark, f"{tmp_path}/in")
    found = lambda job, name: sorted((r["id"], r["session_id"]) for r in J.run_to_table(job, "append", f"{tmp_path}/{name}").collect())
    assert found(J.first_within_stream(rows, 2, buckets), "first") == [(1, big), (2, None), (3, big + 1), (4, big), (7, big + 1), (8, big), (9, big)]
    assert found(J.repeated_submits(rows, 2, buckets), "repeats") == [(5, big), (6, None), (8, big)]


@pytest.mark.parametrize("buckets", [1, 3])
def test_stuck_runs_of_one_group_each_fail_once(spark, tmp_path, buckets):
    spark.conf.set(*J.STATE_STORE)
    at = lambda minute: f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"
    batches = [[(run, 1, "RUNNING", at(run)) for run in range(1, 9)], [(100, 1, "SUCCEEDED", at(35))], [(100, 2, "SUCCEEDED", at(36)), (8, 2, "SUCCEEDED", at(36))], [(7, 2, "SUCCEEDED", at(40))]]
    for rows in batches:
        spark.createDataFrame(rows, "analysis_id long, seq long, status string, at string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    job = J.stuck_runs(J.file_stream(spark, f"{tmp_path}/in"), 30, buckets=buckets)
    assert sorted(r["analysis_id"] for r in J.run_to_table(job, "append", f"{tmp_path}/job").collect()) == [1, 2, 3, 4, 5, 6, 7]  # 8 ends in time


def test_files_are_lexed_once_for_their_calls(spark):
    """Calls, made objects and fields of another class of the file come from one reading of it; keys may be null."""
    text = "class A { B b; void f() { b.go(); new M(1).run(); other.x(); } }\nclass C { D b; void g() { b.c.d(); plain(); } }"
    rows = [("p", None, "A.java", text), ("p", 1, "A.java", "class A { void f() { b.go(); } }"), ("p", 1, "x.py", "def f():\n    b.go()\n")]
    calls = symbols_and_calls_of(spark.createDataFrame(rows, "project_id string, analysis_id int, path string, content string"))[1]
    got = {(r["analysis_id"], r["source"], r["called"]) for r in calls.collect()}
    want = [(None, "A.java#A", x) for x in "D go run M other x".split()] + [(None, "A.java#C", x) for x in "c d plain".split()]
    assert got == {*want, *[(1, s, x) for s in ("A.java#A", "x.py#f") for x in ("b", "go")]}
    assert calls._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_boilerplate_of_many_files_is_read_and_shuffled_once(spark):
    text = "\n".join(f"line {i}" for i in range(6))
    rows = [("p", f"f{i:03d}", text + (f"\nown {i // 2}" if i > 197 else "")) for i in range(200)] + [("o", "f000", text), (None, "b", text), (None, "a", "x\n" + text)]
    found = B.cross_file_duplicates(B.windows(lines_of(spark.createDataFrame(rows, "project_id string, path string, content string"))))
    got = {(r["project_id"], r["path_a"], r["line_a"], r["path_b"], r["line_b"]) for r in found.collect()}
    assert got == {("p", "f000", 1, "f001", 1), ("p", "f198", 2, "f199", 2), (None, "a", 2, "b", 1)}
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_commits_are_added_up_where_they_are_read(spark):
    """A change is no row of a shuffle; a hash that stands twice counts the paths of both once, and each stays a row."""
    one, two = "@a1\tann\t2024-01-01 00:00:00\n1\t2\tx\n3\t-\ty\n4\t1\tx", "@a1\tbob\tnever\n5\t5\tx\n-\t-\tz\nnoise"
    rows = [("p", one), ("p", two), ("p", "@b\teve\t2024-01-02 00:00:00"), ("q", one), ("q", "noise"), ("q", None)]
    commits, files = M.commits_of(spark.createDataFrame(rows, "project_id string, piece string"))
    plan = commits._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = sorted((r["project_id"], r["commit_hash"], r["author_name"], r["committed_at"] is not None, r["files_changed"], r["added"], r["removed"]) for r in commits.collect())
    assert got == [("p", "a1", "ann", True, 3, 13, 8), ("p", "a1", "bob", False, 3, 13, 8), ("p", "b", "eve", True, 0, 0, 0), ("q", "a1", "ann", True, 2, 8, 3)]
    assert sorted(map(tuple, files.collect())) == [("p", "a1", "x", 10, 8), ("p", "a1", "y", 3, 0), ("p", "a1", "z", 0, 0), ("q", "a1", "x", 5, 3), ("q", "a1", "y", 3, 0)]


def test_parts_follow_the_rows(spark):
    assert parts_for(spark, 60, each=10) == 6 and parts_for(spark, 10) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = spark.createDataFrame([("p", f"@{k:x}\tann\tnever\n1\t1\tx") for k in range(50)], "project_id string, piece string")
    commits, _ = M.commits_of(pieces, parts=19)
    assert commits.rdd.getNumPartitions() == 19 and commits.filter("files_changed = 1").count() == 50
