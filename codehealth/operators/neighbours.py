"""Nearest vectors by buckets of random projections, for sets too large to compare every query with every vector.

The signs of a vector's products with `bits` random planes are its bucket, in each of `tables` tables; vectors at a small angle
share most signs. A query looks into its own bucket of each table and into those that differ in up to `probes` signs. What
it meets there is scored exactly. Recall is a matter of the angles, so it is measured (see `recall`); operators.retrieval.nearest is
the exact way."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codehealth.operators.retrieval import BLOCK_VALUES
from codehealth.operators.vectors import best_in_groups, n_values

TABLES, BITS, PROBES, SEED = 24, 8, 1, 17


def with_buckets(rows: DataFrame, vector: str, tables: int, bits: int, probes: int, seed: int) -> DataFrame:
    """rows with `buckets`: of each table the vector's own and those that differ in up to `probes` signs. Null or empty vectors, and
    those of another length than the first of a batch, have none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = [sum(1 << k for k in some) for n in range(probes + 1) for some in combinations(range(bits), n)]
        flips = (np.arange(tables)[:, None, None] << bits) | np.array(flips)[None, None, :]  # the table's number, and the signs to turn
        for batch in batches:
            at = batch.schema.get_field_index(vector)
            values = batch.column(at).to_pylist()
            found = [[] for _ in values]
            for d in {len(v) for v in values if v and None not in v}:
                own = [i for i, v in enumerate(values) if v and len(v) == d and None not in v]
                planes = np.random.default_rng([seed, d]).normal(size=(tables * bits, d))
                signs = np.array([values[i] for i in own], float) @ planes.T > 0
                code = (signs.reshape(len(own), tables, bits) << np.arange(bits)).sum(axis=2)
                keys = flips ^ code.T[:, :, None]
                for i, k in zip(own, keys.transpose(1, 0, 2).reshape(len(own), -1).tolist()):
                    found[i] = k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "buckets"])

    schema = rows.withColumn("buckets", F.array().cast("array<long>")).schema
    return rows.mapInArrow(work, schema)


def nearest_by_buckets(queries: DataFrame, vectors: DataFrame, k: int = 8, tables: int = TABLES, bits: int = BITS, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """query_id, id, score of the k vectors (project_id, id, embedding) of the greatest cosine among those that share a bucket with the query
    (query_id, project_id, q) in its project. Buckets are dealt into shards of about BLOCK_VALUES values; a task scores a shard
    bucket by bucket and keeps k of each query and bucket, so that no pair is a row."""
    index = with_buckets(vectors.filter("embedding is not null and project_id is not null").select("project_id", "id", "embedding"), "embedding", tables, bits, 0, seed)
    asked = with_buckets(queries.filter("q is not null and project_id is not null").select("project_id", "query_id", "q"), "q", tables, bits, probes, seed)
    shards = max(1, -(-n_values(vectors, "embedding") * tables // BLOCK_VALUES))
    opened = lambda df, *columns: df.select("project_id", *columns, F.explode("buckets").alias("bucket")).withColumn("shard", F.pmod(F.xxhash64("project_id", "bucket"), F.lit(shards)))
    scored = best_in_groups(opened(asked, "query_id", "q"), opened(index, "id", "embedding"), ["shard"], ["project_id", "bucket"], k).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: how many of the exact hits (query_id, id) were found, of how many, and the share."""
    own = found.select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    rows = exact.select("query_id", "id").join(own, ["query_id", "id"], "left")
    return rows.agg(F.count("hit").alias("found"), F.count("*").alias("exact")).withColumn("recall", F.col("found") / F.col("exact"))
