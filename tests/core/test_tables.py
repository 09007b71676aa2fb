"""Typed tables and nearest vectors by buckets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codehealth.operators import neighbours as N
from codehealth.operators import retrieval as K
from codehealth.sources import catalog


def test_deleted_rows_are_seen_by_no_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0, "READY"), (2, "b", 1, "READY"), (3, "c", 0, None)], "ID int, Name string, deleted int, status string").withColumn("other", F.lit(1))
    catalog.write(rows, str(tmp_path), "project")
    found = catalog.read(spark, str(tmp_path), "project")
    assert "deleted" not in found.columns and "other" not in found.columns and sorted(r["id"] for r in found.collect()) == [1, 3]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(deleted,0)" in plan
    catalog.write(rows.drop("deleted"), str(tmp_path / "more"), "project")
    assert catalog.read(spark, str(tmp_path / "more"), "project").count() == 3


@pytest.mark.parametrize("row,what", [((1, None, "READY"), "name is null"), ((1, "a", "OLD"), "status may not be OLD")])
def test_rows_that_break_a_rule_are_not_written(spark, tmp_path, row, what):
    with pytest.raises(Exception, match=what):
        catalog.write(spark.createDataFrame([row], "id int, name string, status string"), str(tmp_path), "project")


def test_broken_rules(spark, tmp_path):
    catalog.write(spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "id int, name string, deleted int"), str(tmp_path), "project")
    runs = spark.createDataFrame([(1, 1, "RUNNING"), (2, 2, "FAILED"), (2, 3, "FAILED")], "id int, project_id int, status string")
    catalog.write(runs, str(tmp_path), "analysis")
    found = {r["rule"]: r["n"] for r in catalog.broken_rules(spark, str(tmp_path), "analysis").collect()}
    assert found == {"unique:id": 1, "null:id": 0, "null:project_id": 0, "null:status": 0, "enum:status": 0, "enum:stage": 0, "orphan:project_id": 2}


@pytest.mark.parametrize("name", sorted(catalog.TABLES))
def test_every_table_can_be_written_and_read(spark, tmp_path, name):
    table = catalog.TABLES[name]
    columns = [x.split(" ")[0] for x in table.schema.split(", ")]
    assert {*table.unique, *table.not_null, *table.enums, *table.foreign} <= set(columns) and set(table.foreign.values()) <= set(catalog.TABLES)
    catalog.typed(spark.createDataFrame([(1,)], "id long"), name).filter("false").write.parquet(f"{tmp_path}/{name}")
    assert catalog.read(spark, str(tmp_path), name).count() == 0


def test_nearest_by_buckets(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 32))
    vectors = [("p", i, (centres[i % 20] + 0.3 * rng.normal(size=32)).tolist()) for i in range(600)] + [("q", 900, [1.0] * 32), ("p", 901, None)]
    v = spark.createDataFrame(vectors, "project_id string, id long, embedding array<float>").repartition(4)
    q = spark.createDataFrame([("p", i, vectors[i][2]) for i in range(0, 600, 30)] + [("p", 1000, None)], "project_id string, query_id long, q array<float>")
    found, exact = N.nearest_by_buckets(q, v, 5), K.nearest(q, v, 5)
    got = N.recall(found, exact).first()
    assert got["exact"] == 100 and got["recall"] >= 0.9
    scores = {(r["query_id"], r["id"]): r["score"] for r in exact.collect()}
    assert all(abs(scores[r["query_id"], r["id"]] - r["score"]) < 1e-9 for r in found.collect() if (r["query_id"], r["id"]) in scores)
    all_of_them = N.nearest_by_buckets(q, v, 5, tables=1, bits=2, probes=2)
    assert N.recall(all_of_them, exact).first()["recall"] == 1.0
    assert N.nearest_by_buckets(q.filter("false"), v).count() == 0
