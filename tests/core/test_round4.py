"""What the review of round 4 found."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from codehealth import plans
from codehealth.operators import code_blocks as B
from codehealth.operators import line_rules as R
from codehealth.operators.issues import duplicate_findings
from codehealth.operators.line_rules import lines_of


def test_windows_of_whole_texts_are_those_of_their_lines(spark):
    rng = random.Random(4)
    bits = ["a", "A b", "'x y'", '"', "'", "Σ", "ΑΣ", " ", "\t", "\x0b", "{", "}", ";", "\n", "\n", "\n", "\r", "\r\n", "\r \n", "'" + "q" * 201 + "'"]
    texts = ["", "\n", None, "a\n" * 6, "a\n" * 5 + " ", "a\n" * 5 + "\r", "{\n" * 8] + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(300)]
    files = spark.createDataFrame([("p", f"f{i}", x) for i, x in enumerate(texts)], "project_id string, path string, content string")
    found = B.windows_of(files)
    want = sorted(map(tuple, B.windows(lines_of(files)).select("project_id", "path", "line", "hash").collect()))
    assert len(want) > 500 and sorted(map(tuple, found.collect())) == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().replace("RoundRobin", "")


def test_all_files_of_a_window_and_all_pairs_are_there(spark):
    """More than 50 pairs in a project, a window of many files, and files that share it with none but later ones."""
    rng = random.Random(3)
    rows = [(p, f"f{i:03d}", "\n".join(f"line {rng.randrange(2) + 2 * (k // 6 + (i if i % 3 else 0) // 2)}" for k in range(13))) for p in ("p", None) for i in range(150)]
    spots = {}
    for p, path, text in rows:
        lines = text.split("\n")
        for i in range(len(lines) - 5):
            spots.setdefault((p, tuple(lines[i : i + 6])), {}).setdefault(path, i + 1)
    want = sorted((str(p), min(at), at[min(at)], path, line) for (p, _), at in spots.items() for path, line in at.items() if path != min(at))
    found = B.shared_windows(B.windows_of(spark.createDataFrame(rows, "project_id string, path string, content string")))
    got = sorted((str(r["project_id"]), r["path_a"], r["line_a"], r["path_b"], r["line_b"]) for r in found.collect())
    assert len({(x[1], x[3]) for x in want if x[0] == "p"}) > 50 and max(map(len, spots.values())) > 2 and got == want


@pytest.mark.parametrize("name,n", [("u3_copies", 60 * 3 + 2 * 49), ("u3_cross_file_duplicates", 60 + 2 * 47)])
def test_queries_for_copies_leave_none_out(spark, tmp_path, name, n):
    text = lambda i: "\n".join(f"word {i} of line {k}" for k in range(6))
    rows = [(4 * i + j, text(i), "en", "s") for i in range(60) for j in range(4)] + [(1_000 + i, text(-1) + "\nmore", "de", "s") for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(plans.SQL[name]).fetchall()
    got = plans.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert len(got) == n


def test_every_turn_of_a_user_is_a_query(spark, tmp_path):
    """Turns of 100 and more are queries of their own, beside another conversation's."""
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"please find word{'abc'[c % 3]} and thing{'xyz'[t % 3]}") for c in (1, 2, 3, 50) for t in (0, 1, 2, 3, 100)]
    docs = [(i, f"some word{'abc'[i % 3]} here" if i % 2 else f"Thing{'xyz'[i % 3]}", "en", f"s{i % 2}") for i in range(40)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("conversations", "documents"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = [tuple(r) for r in plans.QUERIES["k4_keyword_hits"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(plans.SQL["k4_keyword_hits"]).fetchall())
    assert len(got) == 4 * 3 * 8 and {r[0] // 100 for r in got} == {1, 2, 3, 4, 50, 51}


def test_cheap_tests_before_patterns_lose_nothing(spark):
    """Each pattern finds the same lines with and without the texts that are looked for first."""
    rng = random.Random(1)
    known = "eval( exec( os.system( subprocess(a,shell=True System.Runtime.getRuntime().exec execCommand( child_process.exec( pickle.loads( yaml.load(f) readObject( hashlib.md5( MessageDigest.getInstance('MD5' sha1( MessageDigest.getInstance(\"SHA-1\" Math.random( Random().next "
    known += "PassWord PWD api_KEY Token secret = : == != .Equals( strcmp( 'longenough' Select UPDATE from format( '+x f\" function def class async public static if else for while case && || ? catch(E e) throws X { } ( ) [ ; < > , name x1 \u212a \u017f"
    bits = [*known.split(), "rm -rf ", "insert  into ", "DELETE FROM ", *" " * 30, *"\t\t\t", "\x85", "\u2028"]
    lines = ["Password = 'longenough1'", "", " ", "\t", "def f (", "  class A {", "catch (E e) { // }", "} catch (E e) {  ", "void f(int x) {", "int f(", "a \x85", "a\t\u2029", " \tx", "\t x", "x\t "]
    lines += ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))) for _ in range(6_000)] + [f"{a} {b} {c}" for a in bits[:60] for b in ("x", "'longenough'", "(y)", "{") for c in (")", ") {", "{ }")]
    text = F.col("text")
    pairs = {p: (R.holds(text, p), text.rlike(p)) for p in (*R.NEAR, *R.NEAR_LOWER)} | {p: (B.is_head(text, p), text.rlike(p)) for p in B.HEAD_NEEDS}
    pairs["branches"] = (F.when(R.any_of(text, B.BRANCH_NEEDS), F.regexp_count(text, F.lit(B.BRANCH))).otherwise(0) > 0, F.regexp_count(text, F.lit(B.BRANCH)) > 0)
    pairs["blanks"] = (F.substring(text, -1, 1).isin(" ", "\t", "\r", "\n", "\x85", "\u2028", "\u2029") | ~text.rlike(R.TRAILING), F.lit(True))
    pairs |= {c: (B._count(text, f"[{c}]") == F.regexp_count(text, F.lit(f"[{c}]")), F.lit(True)) for c in "{}"}
    table = spark.createDataFrame([(x,) for x in lines], "text string")
    found = table.select(*[c for own, plain in pairs.values() for c in (F.count_if(~own.eqNullSafe(plain)), F.count_if(plain))]).collect()[0]
    assert [p for p, n in zip(pairs, found[::2]) if n] == []
    assert [p for p, n in zip(pairs, found[1::2]) if not n] == []


def test_duplicates_of_all_scanners_shuffle_no_lines(spark):
    """Windows are arrays of a file; a file that repeats too few lines is not asked for windows it holds twice."""
    rng = random.Random(2)
    rows = [("p", f"f{i}", "\n".join(f"l {rng.randrange(3 if i % 2 else 40)}" for _ in range(30))) for i in range(40)]
    files = spark.createDataFrame(rows, "project_id string, path string, content string")
    whole = B.windows(lines_of(files))
    found = duplicate_findings(files)
    assert "collect_list(lower" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = [(r["path"], r["first"]) for r in B.same_file_duplicates(whole).collect()] + [(r["path_a"], r["line_a"]) for r in B.cross_file_duplicates(whole).collect()]
    assert len(want) > 40 and sorted((r["path"], r["line"]) for r in found.collect()) == sorted(want)
