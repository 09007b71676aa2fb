"""Readers, the snapshot sink of streams, and reports inside prose."""

import json

import pytest
from pyspark.sql import functions as F

from codehealth.functions import text as T
from codehealth.operators.issues import every_finding
from codehealth.sources import manifests as M
from codehealth.sources import snapshots as S
from codehealth.streaming import jobs as J

KEYS = ("project_id", "path")


def generations(path):
    return sorted(p.name for p in path.iterdir())


def test_old_generations_go(spark, tmp_path):
    path, keys = f"{tmp_path}/t", ("project_id",)
    seen = lambda: sorted((r["project_id"], r["v"]) for r in S.snapshot(spark, path, keys).collect())
    frame = lambda rows: spark.createDataFrame(rows, "project_id string, v int")
    S.replace_snapshot(frame([("a", 0), ("b", 0)]), path, frame([("a", 0), ("b", 0)]), keys, ("s", 0), runs=2)
    for k in (1, 2, 3, 4):
        assert S.replace_snapshot(frame([("a", k)]), path, frame([("a", 0)]), keys, ("s", k), runs=2)
        assert seen() == [("a", k), ("b", 0)]
        assert not S.replace_snapshot(frame([("a", 99)]), path, frame([("a", 0)]), keys, ("s", k), runs=2)  # known after a compaction, too
        assert len(generations(tmp_path / "t")) == 1
    assert generations(tmp_path / "t") != ["g000000"]
    S.replace_snapshot(frame([]), path, frame([("b", 0)]), keys, runs=2)
    assert seen() == [("a", 4)]


def test_a_generation_that_is_not_whole_does_not_count(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "project_id string, v int")
    S.replace_snapshot(rows, f"{tmp_path}/t", rows, ("project_id",))
    rows.withColumn("v", F.lit(7)).withColumn("run", F.lit("x")).write.parquet(f"{tmp_path}/t/g000001/rows")  # stopped before its marks
    assert [r["v"] for r in S.snapshot(spark, f"{tmp_path}/t", ("project_id",)).collect()] == [1]


def stream_of(spark, folder):
    return spark.readStream.schema("project_id string, path string, content string, seq long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def arrive(spark, folder, *rows):
    spark.createDataFrame(rows, "project_id string, path string, content string, seq long").coalesce(1).write.mode("append").parquet(f"{folder}/in")


def words_in(rows):
    return rows.select(*KEYS, F.explode(F.split("content", " ")).alias("word")).filter("word <> ''")


def test_a_file_that_comes_again_leaves_one_copy(spark, tmp_path):
    arrive(spark, tmp_path, ("p", "a", "x y", 1), ("p", "b", "z", 2))
    run = lambda state, find=words_in: sorted((r["path"], r["word"]) for r in J.run_to_snapshot(stream_of(spark, tmp_path), find, f"{tmp_path}/table", f"{tmp_path}/{state}", KEYS, "words", "seq").collect())
    assert run("s") == [("a", "x"), ("a", "y"), ("b", "z")]
    arrive(spark, tmp_path, ("p", "a", "old", 3), ("p", "a", "new", 4), ("p", "b", "", 5))
    assert run("s") == [("a", "new")]
    assert run("other") == [("a", "new")]  # its state is lost: the same batches run again and write nothing


def test_a_batch_that_failed_is_written_once(spark, tmp_path):
    arrive(spark, tmp_path, ("p", "a", "x", 1))
    calls = []

    def fails_after_writing(rows):
        calls.append(1)
        return words_in(rows)

    real = J.replace_snapshot

    def write_then_fail(*args, **kwargs):
        done = real(*args, **kwargs)
        if len(calls) == 1:
            raise RuntimeError("stopped")
        return done

    J.replace_snapshot = write_then_fail
    try:
        args = (fails_after_writing, f"{tmp_path}/table", f"{tmp_path}/s", KEYS, "words")
        with pytest.raises(Exception, match="stopped"):
            J.run_to_snapshot(stream_of(spark, tmp_path), *args)
        assert [r["word"] for r in J.run_to_snapshot(stream_of(spark, tmp_path), *args).collect()] == ["x"]
    finally:
        J.replace_snapshot = real
    assert len(calls) == 2 and spark.read.parquet(f"{tmp_path}/table/g000000/rows").count() == 1


def test_a_large_log_is_read_by_many_tasks(spark, tmp_path):
    text = "".join(f"@{k:x}\tann\t2024-01-01 00:00:00\n1\t-\ta@b\n{k}\t2\tc\n\n" for k in range(20_000))
    (tmp_path / "big.log").write_text(text)
    (tmp_path / "small.log").write_text("noise\n@ff\tbob\tnever\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        pieces = M.read_commit_logs(spark, str(tmp_path))
        assert pieces.rdd.getNumPartitions() > 8
        commits, files = M.commits_of(pieces)
        rows = {(r["project_id"], int(r["commit_hash"], 16)): r for r in commits.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 20_001 and all(rows["big", k]["added"] == k + 1 and rows["big", k]["removed"] == 2 and rows["big", k]["files_changed"] == 2 for k in range(0, 20_000, 777))
    assert rows["small", 255]["author_name"] == "bob" and rows["small", 255]["committed_at"] is None and rows["small", 255]["files_changed"] == 0


def test_pages_that_cannot_be_read(spark, tmp_path):
    issue = {"key": "k", "rule": "r", "component": "p:a.py", "line": 3, "message": "m"}
    for name, text in {"good": json.dumps({"issues": [issue, {**issue, "severity": "MAJOR", "type": "BUG", "line": "x"}]}), "cut": '{"issues": [{"rule": "r"', "prose": "error 500", "none": "{}", "part": json.dumps({"issues": [issue, {"message": "x"}, None]}), "empty": json.dumps({"issues": []})}.items():
        (tmp_path / f"{name}.json").write_text(text)
    found, bad = M.read_issue_pages(spark, str(tmp_path))
    assert sorted((r["page"], str(r["line"]), str(r["severity"])) for r in found.collect()) == [("good.json", "3", "None"), ("good.json", "None", "MAJOR"), ("part.json", "3", "None")]
    assert {r["page"]: r["reason"] for r in bad.collect()} == {"cut.json": "no JSON object", "prose.json": "no JSON object", "none.json": "no list of findings", "part.json": "2 findings without a rule"}
    assert {(r["path"], r["kind"]) for r in M.imported_issues(found).collect()} == {("a.py", "CODE_SMELL"), ("a.py", "BUG")}


@pytest.mark.parametrize("text,want", [
    ('{"a": 1}', '{"a": 1}'), ('x {"a": {"b": 2}} y', '{"a": {"b": 2}}'), ('{"a": "}{"} {', '{"a": "}{"}'), ('{"a": "\\"}"} z', '{"a": "\\"}"}'), ("{{}", None), ("none", None), ("", None), (None, None), ("}{}", "{}"), ('{"a": "é}"}b', '{"a": "é}"}'),
])
def test_first_block(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(T.first_block(F.col("x"))).first()[0] == want


def test_json_object(spark):
    rows = ['{"a": 1}', '```json\n{"a": 2}\n```', 'so {"a": 3} and {b}', "{a}", "[1]", None, '{"a": 4', '"x"']
    got = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select("i", T.json_object(F.col("x"), "a int").alias("o")).orderBy("i").collect()
    assert [r["o"] and r["o"]["a"] for r in got] == [1, 2, 3, None, None, None, None, None]


def test_all_scanners_in_one_list(spark):
    same = "".join(f"value_{k} = work(item, {k})\n" for k in range(7))
    rows = [
        ("p", 1, "a.py", same + "try:\n    x()\nexcept E:\n    # why\n    pass\n"), ("p", 1, "b.py", same), ("p", 1, "dist/c.py", same), ("p", 1, "d.yml", "a: 1  \nb: 2  \nc: 3  \npassword: 'abcdefgh1'\n"),
        ("p", 1, "E.java", "class E {\n  void f() {\n    try { g(); } catch (X e) { }\n  }\n}\n"), ("p", 1, "f.txt", "password = 'abcdefgh1'\n"), ("p", 1, "empty.py", ""),
    ]
    files = spark.createDataFrame(rows, "project_id string, analysis_id int, path string, content string")
    other = spark.createDataFrame([("p", 1, "z.py", 1, "K", "SONAR", "BUG", "MAJOR", "m")], "project_id string, analysis_id int, path string, line int, rule_key string, source string, kind string, severity string, message string")
    got = sorted((r["path"], r["line"], r["rule_key"], r["rank"]) for r in every_finding(files, other).collect())
    assert got == [("E.java", 3, "SWALLOWED-EXCEPTION", 2), ("a.py", 1, "DUPLICATED-BLOCK", 3), ("a.py", 10, "SWALLOWED-EXCEPTION", 2), ("d.yml", 1, "TRAILING-WHITESPACE", 1), ("z.py", 1, "K", 0)]


def test_batch_twins_of_streams(spark):
    rows = spark.createDataFrame([(1, 1, "a", "2024-01-01 00:00:00"), (1, 2, "a", "2024-01-01 00:00:02"), (1, 3, "a", "2024-01-01 00:00:03"), (1, 4, "b", "2024-01-01 00:00:03"), (2, 5, "a", "2024-01-01 00:00:00")], "session_id long, id long, content string, at string")
    assert sorted(r["id"] for r in J.first_within(rows, 2).collect()) == [1, 3, 4, 5]
    events = spark.createDataFrame([(1, 1, "RUNNING", "2024-01-01 00:00:00"), (1, 2, "SUCCEEDED", "2024-01-01 00:40:00"), (2, 3, "PENDING", "2024-01-01 00:00:00"), (3, 4, "RUNNING", "2024-01-01 00:30:00")], "analysis_id long, seq long, status string, at string")
    assert sorted(r["analysis_id"] for r in J.silences(events, 30).collect()) == [1, 2]
