"""Strongly connected components of many graphs at once.

Graphs of up to `in_one` edges are read by one group each, in one pass (Tarjan's search). Larger ones are never gathered; for them
the work is rounds over tables, and what a round does not change it does not read again:

- **Thin.** Each task takes up to `in_one` edges, finds the components that these alone make, and returns a star for each and one edge
  between two of them: the same nodes reach each other, over fewer edges. What is small enough then is read by one group; the rest:
- **Rake.** Edges whose source nothing enters, or whose target nothing leaves, are on no cycle and go.
- **Compress.** A node with one edge in and one out belongs to the component of its neighbours if both are in the same one, and
  else to none. Runs of such nodes become one edge each. Their ends are found by doubling: each node knows a node further on,
  and asks that one for its own, so a run of n nodes takes about log2(n) rounds. A run without an end is a cycle.
- **Colour.** In what is left all nodes branch. The greatest node that reaches a node is its colour, and the nodes of a colour
  that reach its greatest node backwards are one component. Only nodes whose colour changed push it on. Found components go, and
  the rest is raked and compressed again.

Raking and compressing in turn takes a tree or a chain apart in rounds that follow the logarithm of its size. Colours take a round for
each hop, in graphs of which every node has two edges in or two out. Tables in `folder` (shared by all executors) cut
the lineage; only counts come to the driver."""

from __future__ import annotations

import uuid

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from codehealth.operators.graph import graph_keys

#: Edges of a graph that one group reads at most.
IN_ONE = 200_000


def _kept(df: DataFrame, folder: str, **counted) -> tuple[DataFrame, dict]:
    """df as a table, and counts taken while it was written: its rows as n, and any others."""
    path, seen = f"{folder}/{uuid.uuid4().hex}", Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counted.items()]).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def components_of(sources: list, targets: list) -> list[list]:
    """Components of more than one node, each sorted; a search without recursion."""
    after: dict = {}
    for a, b in zip(sources, targets):
        after.setdefault(a, []).append(b)
    number: dict = {}
    low: dict = {}
    held, inside, out = [], set(), []
    for root in after:
        if root in number:
            continue
        walk = [(root, iter(after[root]))]
        number[root] = low[root] = len(number)
        held.append(root)
        inside.add(root)
        while walk:
            node, rest = walk[-1]
            for other in rest:
                if other not in number:
                    number[other] = low[other] = len(number)
                    held.append(other)
                    inside.add(other)
                    walk.append((other, iter(after.get(other, ()))))
                    break
                if other in inside:
                    low[node] = min(low[node], number[other])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == number[node]:
                    own = []
                    while not own or own[-1] != node:
                        own.append(held.pop())
                        inside.discard(own[-1])
                    if len(own) > 1:
                        out.append(sorted(own))
    return out


def _small(e: DataFrame, keys: list[str]) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in e.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"members array<{kinds['source']}>"])

    def search(own: pd.DataFrame) -> pd.DataFrame:
        found = components_of(own["source"].tolist(), own["target"].tolist())
        return pd.DataFrame({**{k: pd.Series([own[k].iloc[0]] * len(found), dtype=own[k].dtype) for k in keys}, "members": pd.Series(found, dtype=object)})

    return e.groupBy(*keys).applyInPandas(search, schema)


def thinned(sources: list, targets: list) -> list[tuple]:
    """Distinct edges over which the same nodes reach each other: to and from one node of each component, and between these nodes."""
    of = {}
    for own in components_of(sources, targets):
        of.update(dict.fromkeys(own, own[0]))
    out = {(a, b) for a, b in zip((of.get(x, x) for x in sources), (of.get(x, x) for x in targets)) if a != b}
    for node, first in of.items():
        if node != first:
            out |= {(first, node), (node, first)}
    return list(out)


def _thinning(schema: pa.Schema, in_one: int) -> Callable:
    """Batches of edges (keys, source, target), thinned by `in_one` edges at a time; edges without an end stay."""

    def rows_of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: dict = {}
        out = []
        for *key, a, b in zip(*(c.to_pylist() for c in pa.Table.from_batches(held).columns)):
            if a is None or b is None:
                out.append((*key, a, b))
            else:
                own = edges.setdefault(tuple(key), ([], []))
                own[0].append(a)
                own[1].append(b)
        for key, own in edges.items():
            out += [(*key, *x) for x in thinned(*own)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, in_one):
                part = batch.slice(at, in_one)
                if held and n + part.num_rows > in_one:
                    yield from rows_of(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield from rows_of(held)

    return work


def _thin(e: DataFrame, n: int, folder: str, keys: list[str], in_one: int) -> tuple[DataFrame, int]:
    """For as long as it takes much away: edges near each other by their sources, then by their targets, thinned together."""
    e = e.select(*keys, "source", "target")
    for side in ("source", "target") * 4:
        if not in_one or n <= in_one:
            break
        before, parts = n, max(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // in_one))
        near = e.repartitionByRange(parts, *keys, side)
        e, seen = _kept(near.mapInArrow(_thinning(to_arrow_schema(e.schema), in_one), e.schema).distinct(), folder)
        n = seen["n"]
        if n > 0.75 * before:
            break
    return e, n


def _sized(e: DataFrame, folder: str, keys: list[str], in_one: int) -> tuple[DataFrame, DataFrame, int]:
    """Edges of graphs that one group reads, those of larger ones as a table, and how many of these there are."""
    sizes, seen = _kept(e.groupBy(*keys).agg(F.count("*").alias("__n")), folder, large=F.sum(F.when(F.col("__n") > in_one, F.col("__n"))))
    if not seen["large"]:
        return e, e.filter("false"), 0
    marked = e.join(sizes, keys)
    large, seen = _kept(marked.filter(F.col("__n") > in_one).drop("__n"), folder)
    return marked.filter(F.col("__n") <= in_one).drop("__n"), large, seen["n"]


def _ends(e: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, node, other, n: of each node at the side `a` of edges, how many there are, and the other end of one."""
    return e.groupBy(*keys, F.col(a).alias("node")).agg(F.count("*").alias("n"), F.min(b).alias("other"))


def _raked(e: DataFrame, n: int, folder: str, keys: list[str]) -> tuple[DataFrame, int]:
    into, out = e.select(*keys, F.col("target").alias("source")).distinct(), e.select(*keys, F.col("source").alias("target")).distinct()
    e, seen = _kept(e.join(into, [*keys, "source"], "left_semi").join(out, [*keys, "target"], "left_semi"), folder)
    return e, seen["n"]


def _compressed(e: DataFrame, n: int, folder: str, keys: list[str]) -> tuple[DataFrame, int, DataFrame, DataFrame]:
    """Edges with each run as one edge, how many there are, the runs' nodes with the ends of their run (keys, node, head, tail), and the
    runs without ends (keys, node, colour)."""
    into, out = _ends(e, keys, "target", "source").filter("n = 1"), _ends(e, keys, "source", "target").filter("n = 1")
    inner = into.select(*keys, "node", F.col("other").alias("head")).join(out.select(*keys, "node", F.col("other").alias("tail")), [*keys, "node"])
    inner, seen = _kept(inner.withColumns({"least": F.least("node", "head"), "h": F.lit(True), "t": F.lit(True)}), folder)
    n_inner, rounds, left = seen["n"], 0, seen["n"]
    # h, t: whether that end may be inside the run itself; then it knows an end further on
    while left and 2**rounds <= 2 * n_inner:
        other = lambda c, flag: inner.select(*keys, F.col("node").alias(c), F.col(c).alias("far"), F.col("least").alias("far_least"), F.lit(True).alias(flag + "2"))  # noqa: E731, B023
        rows = inner.join(other("head", "h"), [*keys, "head"], "left").withColumns({"head": F.coalesce("far", "head"), "least": F.least("least", F.coalesce("far_least", "least")), "h": F.col("h2").isNotNull()}).drop("far", "far_least", "h2")
        rows = rows.join(other("tail", "t"), [*keys, "tail"], "left").withColumns({"tail": F.coalesce("far", "tail"), "t": F.col("t2").isNotNull()}).drop("far", "far_least", "t2")
        inner, seen = _kept(rows.select(*keys, "node", "head", "tail", "least", "h", "t"), folder, left=F.count_if(F.col("h") | F.col("t")))
        left, rounds = seen["left"], rounds + 1
    round_ = inner.filter("h or t").select(*keys, "node", F.col("least").alias("colour")) if left else inner.filter("false").select(*keys, "node", F.col("least").alias("colour"))
    runs = inner.filter("not (h or t)").select(*keys, "node", "head", "tail") if left else inner.select(*keys, "node", "head", "tail")
    gone = inner.select(*keys, "node")
    rest = e.join(gone.withColumnRenamed("node", "source"), [*keys, "source"], "left_anti").join(gone.withColumnRenamed("node", "target"), [*keys, "target"], "left_anti")
    new, seen = _kept(rest.unionByName(runs.select(*keys, F.col("head").alias("source"), F.col("tail").alias("target")).filter("source <> target")).distinct(), folder)
    return new, seen["n"], runs, round_


def _spread(e: DataFrame, start: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """keys, node, colour: the greatest colour that reaches each node along edges."""
    now = start.withColumn("new", F.lit(True))
    while True:
        pushed = e.join(now.filter("new").select(*keys, F.col("node").alias("source"), "colour"), [*keys, "source"]).groupBy(*keys, F.col("target").alias("node")).agg(F.max("colour").alias("pushed"))
        best = now.join(pushed, [*keys, "node"], "left").select(*keys, "node", F.greatest("colour", "pushed").alias("colour"), F.coalesce(F.col("pushed") > F.col("colour"), F.lit(False)).alias("new"))
        now, seen = _kept(best, folder, changed=F.count_if(F.col("new")))
        if not seen["changed"]:
            return now.drop("new")


def _large(e: DataFrame, n: int, folder: str, keys: list[str]) -> DataFrame:
    """keys, node, colour: nodes of components of more than one node."""
    runs, found = [], e.filter("false").select(*keys, F.col("source").alias("node"), F.col("source").alias("colour"))
    while n:
        while n:  # a rake for as long as it takes much away, then runs, for as long as they make much of what is left
            before = n
            e, n = _raked(e, n, folder, keys)
            if not n or n <= 0.75 * before:
                continue
            raked = n
            e, n, inner, round_ = _compressed(e, n, folder, keys)
            runs.append(inner)
            found = found.unionByName(round_)
            if n > 0.9 * raked:
                break
        if not n:
            break
        nodes = e.select(*keys, F.col("source").alias("node")).unionByName(e.select(*keys, F.col("target").alias("node"))).distinct()
        colour = _spread(e, nodes.withColumn("colour", F.col("node")), folder, keys)
        side = lambda c: colour.select(*keys, F.col("node").alias(c), F.col("colour").alias("of_" + c))  # noqa: E731, B023
        back = e.join(side("source"), [*keys, "source"]).join(side("target"), [*keys, "target"]).filter("of_source = of_target").select(*keys, F.col("target").alias("source"), F.col("source").alias("target"))
        back, _ = _kept(back, folder)
        start = colour.select(*keys, "node", F.when(F.col("node") == F.col("colour"), 1).otherwise(0).alias("colour"))
        own, _ = _kept(_spread(back, start, folder, keys).filter("colour = 1").select(*keys, "node").join(colour, [*keys, "node"]), folder)
        found = found.unionByName(own)
        gone = own.select(*keys, "node")
        e, seen = _kept(e.join(gone.withColumnRenamed("node", "source"), [*keys, "source"], "left_anti").join(gone.withColumnRenamed("node", "target"), [*keys, "target"], "left_anti"), folder)
        n = seen["n"]
    # runs join the component of their ends, the last ones first
    for inner in reversed(runs):
        side = lambda c: found.select(*keys, F.col("node").alias(c), F.col("colour").alias("of_" + c))  # noqa: E731, B023
        rows = inner.join(side("head"), [*keys, "head"], "left").join(side("tail"), [*keys, "tail"], "left")
        a, b = F.coalesce("of_head", "head"), F.coalesce("of_tail", "tail")
        own = rows.filter(a == b).select(*keys, "node", a.alias("colour"), "head")
        # an end that was alone is part of it now
        ends = own.select(*keys, F.col("head").alias("node"), "colour").distinct()
        found, _ = _kept(found.unionByName(own.drop("head")).unionByName(ends).distinct(), folder)
    return found


def cycles(edges: DataFrame, folder: str, key: str | None = None, in_one: int = IN_ONE) -> DataFrame:
    """keys, members (sorted), source (least), target (greatest), severity of each strongly connected component of more than one
    node, and of each self loop."""
    own = graph_keys(edges, key)
    keys = own or ["__graph"]
    edges = edges if own else edges.withColumn("__graph", F.lit(1))
    e, _ = _kept(edges.select(*keys, "source", "target").distinct(), folder)
    loops, e = e.filter("source = target").select(*own, F.array("source").alias("members")), e.filter("source <> target")
    small, large, n = _sized(e, folder, keys, in_one)
    found = _small(small, keys)
    if n and in_one:
        large, _ = _thin(large, n, folder, keys, in_one)
        small, large, n = _sized(large, folder, keys, in_one)
        found = found.unionByName(_small(small, keys))
    if n:
        groups = _large(large, n, folder, keys).groupBy(*keys, "colour").agg(F.array_sort(F.collect_set("node")).alias("members"))
        found = found.unionByName(groups.filter(F.size("members") > 1).select(*keys, "members"))
    last = F.get("members", F.size("members") - 1)
    return found.select(*own, "members").unionByName(loops).select(*own, "members", F.get("members", F.lit(0)).alias("source"), last.alias("target"), F.lit("MAJOR").alias("severity"))
