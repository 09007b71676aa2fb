"""Cosines of dense vectors in blocks: Spark deals queries and vectors into groups, a task scores a group by matrix products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Scores that a task has in memory at once, and by how much a matrix product may differ from a sum in the order of the entries.
TILE, SLACK = 1 << 22, 1e-9


def n_values(rows: DataFrame, vector: str) -> int:
    return rows.agg(F.coalesce(F.sum(F.size(vector)), F.lit(0))).first()[0]


def by_length(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors (as doubles) of each length; those that are null or empty or hold nulls are in none."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts, whole = np.cumsum(sizes) - sizes, sizes > 0
    if flat.null_count:
        whole[np.repeat(np.arange(len(sizes)), sizes)[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    values = flat.to_numpy(zero_copy_only=False)
    for d in np.unique(sizes[whole]):
        at = np.flatnonzero(whole & (sizes == d))
        yield at, values[starts[at][:, None] + np.arange(d)].astype(float)


def in_order(products: np.ndarray) -> np.ndarray:
    """Sums over the last axis, from the first entry on, as a fold over an array makes them."""
    return np.cumsum(products, axis=-1)[..., -1]


def _best(asked: np.ndarray, vectors: np.ndarray, rank: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each asked vector: the places of the k best, the lower rank first among equals, and their scores. A product of
    matrices leaves those that can be among them; only these are summed up in order."""
    q_norm, norm = np.sqrt(in_order(asked * asked)), np.sqrt(in_order(vectors * vectors))
    n, step = len(vectors), max(1, TILE // len(vectors))
    with np.errstate(all="ignore"):
        units = (vectors / norm[:, None]).T
        for start in range(0, len(asked), step):
            rough = (asked[start : start + step] / q_norm[start : start + step, None]) @ units
            least = np.partition(rough, n - k, axis=1)[:, n - k] - SLACK if n > k else np.full(len(rough), -np.inf)
            for i, row in enumerate(rough, start):
                near = np.flatnonzero(~(row < least[i - start]))
                scores = in_order(asked[i] * vectors[near]) / (norm[near] * q_norm[i])
                first = np.lexsort((rank[near], -np.where(np.isnan(scores), np.inf, scores)))[:k]
                yield near[first], scores[first]


def _places(table: pa.Table, on: list[str]) -> dict[tuple, np.ndarray]:
    places: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(table.column(c).to_pylist() for c in on))):
        places.setdefault(key, []).append(i)
    return {key: np.array(at) for key, at in places.items()}


def _group(on: list[str], k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def work(asked: pa.Table, rows: pa.Table) -> pa.Table:
        query_at, row_at, scores = [], [], []
        theirs = _places(rows, on)
        for key, mine in _places(asked, on).items():
            if key not in theirs:
                continue
            own = rows.take(theirs[key])
            ids = own.column("id").to_pylist()
            by_id = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i])))
            rank = np.empty(len(ids), np.int64)
            rank[by_id] = np.arange(len(ids))
            vectors = {v.shape[1]: (at[full], v[full]) for at, v in by_length(own.column("embedding")) for full in [v.any(axis=1)]}
            found = {}  # place of a query: places of rows and scores
            for at, asking in by_length(asked.column("q").take(mine)):
                where, those = vectors.get(asking.shape[1], ((), ()))
                full = asking.any(axis=1)
                if len(where):
                    found.update((i, (where[near], s)) for i, (near, s) in zip(at[full], _best(asking[full], those, rank[where], k)))
            for i in range(len(mine)):
                near, s = found.get(i, (np.empty(0, np.int64), np.empty(0)))
                rest = by_id[~np.isin(by_id, near)][: k - len(near)] if len(near) < k else by_id[:0]  # vectors that cannot be compared come last, without a score
                query_at.append(np.full(len(near) + len(rest), mine[i]))
                row_at.append(theirs[key][np.concatenate([near, rest])])
                scores.append(pa.array([*s.tolist(), *[None] * len(rest)], pa.float64()))
        if not scores:
            return pa.table([asked.column("query_id")[:0], rows.column("id")[:0], pa.array([], pa.float64())], names=["query_id", "id", "score"])
        return pa.table([asked.column("query_id").take(np.concatenate(query_at)), rows.column("id").take(np.concatenate(row_at)), pa.concat_arrays(scores)], names=["query_id", "id", "score"])

    return work


def best_in_groups(queries: DataFrame, vectors: DataFrame, group: list[str], on: list[str], k: int) -> DataFrame:
    """query_id, id, score: of each group the k best vectors (group, on, id, embedding) of each of its queries (group, on, query_id, q),
    among those that agree in `on`. Vectors without a direction, of another length or with nulls have no score."""
    schema = StructType([queries.schema["query_id"], vectors.schema["id"], StructField("score", DoubleType())])
    asked = queries.select(*group, *on, "query_id", "q").groupBy(*group)
    return asked.cogroup(vectors.select(*group, *on, "id", "embedding").groupBy(*group)).applyInArrow(_group(on, k), schema)
