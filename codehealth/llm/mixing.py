"""Mixing sources to target weights, in fixed-length blocks of words.

The words of a source, document after document, are packed into blocks of `block_words`. Targets share the total
by weight, no source above `repeats` times its size. Each output shard draws its number of blocks per source from
a multinomial distribution over what is still to be drawn, so the shards together reach every target. A source's
drawn slots are numbered; slot number j is block p(j mod n) where p is a pseudorandom permutation of the source's n
blocks, another one for each pass over it: no block is drawn more often than there are passes. Slots and blocks are
joined by (source, block).

Null text or no words: size 0, nothing taken. Null source: a source of its own, last in order. Repeated rows are
documents of their own. All draws follow from `seed`: reruns agree. Other columns are left out, whatever their names.
The driver sees one row per source, MOST_SOURCES at most (more is an error: sources are kinds of texts, not hosts), and one
per output shard of SHARD_BLOCKS blocks. Texts take no part in the numbering: they are joined to their places.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codehealth.llm.shared import saved
from codehealth.llm.words import WORD

BLOCK_WORDS, SEED, REPEATS, WEIGHTS = 64, 20240101, 3, (5, 2, 1)
#: Output shards: this many, or more so that none has more blocks than the next figure.
SHARDS, SHARD_BLOCKS = 64, 1 << 20
#: Words of a source that one task numbers, or as many parts of it.
BUCKET_WORDS, BUCKETS = 1 << 22, 1024
#: Sources are planned on the driver, so there is a bound on them.
MOST_SOURCES = 10_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))


def targets(sizes: list[int], weights=WEIGHTS, repeats: int = REPEATS) -> list[float]:
    """Shares of sum(sizes) by repeated weights; above `repeats` times its size a source stops and the rest is shared again."""
    open_, left, out = set(range(len(sizes))), float(sum(sizes)), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i % len(weights)] for i in open_)
        over = {i for i in open_ if unit * weights[i % len(weights)] > repeats * sizes[i]}
        if not over:
            for i in open_:
                out[i] = unit * weights[i % len(weights)]
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
        open_ -= over
    return out


def shard_counts(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source in each shard (shards x sources): multinomial over what is left, which sums to the quotas."""
    rng, left, out = np.random.default_rng(seed), np.array(quotas, np.int64), []
    per = max(1, -(-int(left.sum()) // shards))
    while left.sum():
        own, want = np.zeros_like(left), min(per, int(left.sum()))
        while want:
            drawn = np.minimum(rng.multinomial(want, left / left.sum()), left)
            own, left, want = own + drawn, left - drawn, want - int(drawn.sum())
        out.append(own)
    return np.array(out, np.int64).reshape(len(out), len(quotas))


def coprime(rng: np.random.Generator, n: int) -> int:
    while True:
        a = int(rng.integers(1, max(2, n)))
        if math.gcd(a, n) == 1:
            return a


def permuted(i: Column, n: Column, a: Column, b: Column, c: Column, d: Column, low: Column, shift: Column) -> Column:
    """A permutation of 0..n-1: affine, then high bits folded into low ones below the power of two `low`, then affine."""
    x = (i * a + b) % n
    x = F.when(x < low, x.bitwiseXOR(F.call_function("shiftright", x, shift))).otherwise(x)
    return (x * c + d) % n


def in_order(docs: DataFrame, sources: DataFrame, buckets: int) -> DataFrame:
    """s (index of the source), row key and start (words of the source before it) of each row. A source's rows are ordered
    by a hash of id and text, so its running sum is made in `buckets` parts, however large the source and however many of its
    rows have no id."""
    part = ["s", "bucket"]
    rows = docs.join(F.broadcast(sources), docs["source"].eqNullSafe(sources["name"])).drop("name")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)))
    sums = rows.groupBy(part).agg(F.sum("size").alias("own"))
    before = F.sum("own").over(Window.partitionBy("s").orderBy("bucket")) - F.col("own")
    own = Window.partitionBy(part).orderBy("doc_id", "tie", "size")
    inside = rows.withColumn("row", F.row_number().over(own)).withColumn("inside", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return inside.join(sums.select(*part, before.alias("before")), part).withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


class Mix:
    """The plan of one mix over `docs`: sources with targets and quotas, and the slots of all shards."""

    def __init__(self, docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", block_words=BLOCK_WORDS, shards=SHARDS, seed=SEED, repeats=REPEATS, weights=WEIGHTS, buckets=BUCKETS):
        self.spark, self.block_words = docs.sparkSession, block_words
        text = docs[text_col].cast("string")
        # id, none, tie are never null: what is dealt by them once stays where it is in a join on them
        id_, none = F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), docs[id_col].isNull().alias("none")
        self.rows = docs.select(docs[id_col].alias("doc_id"), id_, none, docs[source_col].cast("string").alias("source"), text.alias("text"), F.xxhash64(text).alias("tie"))
        self.sized = saved(self.rows.select("doc_id", "id", "none", "source", "tie", F.size(words(F.col("text"))).cast("long").alias("size")), "sizes")
        found = self.sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
        if len(found) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        found = sorted((r["source"] is None, r["source"] or "", int(r["size"])) for r in found)
        names, sizes = [None if null else x for null, x, _ in found], [n for *_, n in found]
        aims = targets(sizes, weights, repeats)
        blocks = [-(-n // block_words) for n in sizes]
        quotas = [min(repeats * b, round(t / n * b)) if n else 0 for n, b, t in zip(sizes, blocks, aims)]
        plan = [(i, *x) for i, x in enumerate(zip(names, sizes, aims))]
        self.sources = self.spark.createDataFrame(plan, "s int, name string, source_size long, target double")
        rng = np.random.default_rng([seed, 1])
        turns = []
        for s, (n, quota) in enumerate(zip(blocks, quotas)):
            for turn in range(-(-quota // n) if n else 0):
                m = n.bit_length() - 1
                turns.append((s, turn, n, coprime(rng, n), int(rng.integers(n)), coprime(rng, n), int(rng.integers(n)), 1 << m, max(1, (m + 1) // 2)))
        self.turns = self.spark.createDataFrame(turns, "s int, turn long, n long, a long, b long, c long, d long, low long, shift int")
        self.counts = shard_counts(quotas, max(shards, -(-sum(quotas) // SHARD_BLOCKS)), seed)
        self.buckets = max(buckets, -(-max(sizes, default=0) // BUCKET_WORDS))

    def slots(self) -> DataFrame:
        """shard, slot, s, block: which block stands at each place of each output shard."""
        counts = self.counts
        total, per = int(counts.sum()), int(counts[0].sum()) if len(counts) else 1
        ends, before = counts.cumsum(axis=1), counts.cumsum(axis=0) - counts
        rows = [(i, ends[i].tolist(), (before[i] - (ends[i] - counts[i])).tolist()) for i in range(len(counts))]
        shards = self.spark.createDataFrame(rows, "shard long, ends array<long>, base array<long>")
        slots = self.spark.range(total).select(F.floor(F.col("id") / per).alias("shard"), (F.col("id") % per).alias("slot"))
        slots = slots.join(F.broadcast(shards), "shard")
        s = F.size(F.filter("ends", lambda e: e <= F.col("slot")))
        slots = slots.withColumn("s", s).withColumn("j", F.col("slot") + F.get("base", F.col("s")))
        n = self.turns.groupBy("s").agg(F.first("n").alias("n_blocks"))
        slots = slots.join(F.broadcast(n), "s").withColumn("turn", F.floor(F.col("j") / F.col("n_blocks")))
        slots = slots.join(F.broadcast(self.turns), ["s", "turn"])
        block = permuted(F.col("j") % F.col("n"), *map(F.col, ("n", "a", "b", "c", "d", "low", "shift")))
        return slots.select("shard", "slot", "s", block.alias("block"))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken of every document."""
        drawn = self.slots().groupBy("s", "block").agg(F.count("*").alias("times"))
        rows = in_order(self.sized, self.sources, self.buckets)
        w, start, end = self.block_words, F.col("start"), F.col("start") + F.col("size")
        first, last = F.floor(start / w), F.floor((end - 1) / w)
        parts = rows.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("long")))))
        share = F.least(end, (F.col("block") + 1) * w) - F.greatest(start, F.col("block") * w)
        parts = parts.withColumn("share", F.when(F.col("block") >= 0, share).otherwise(0))
        got = parts.join(drawn, ["s", "block"], "left").groupBy("s", "bucket", "row", "doc_id", "size", "source_size", "target")
        return got.agg(F.sum(F.col("share") * F.coalesce("times", F.lit(0))).cast("long").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")

    def blocks(self) -> DataFrame:
        """shard, slot, source, block, doc_ids, n_words, text: the mixed corpus, block by block."""
        row = ["id", "none", "tie"]
        places = in_order(self.sized.filter("size > 0"), self.sources, self.buckets).select("s", "doc_id", *row, "source", "size", "start")
        # rows equal in id and text have several places, each of which needs the text once
        rows = self.rows.select(*row, "text").dropDuplicates(row).join(places, row)
        w, start, end = self.block_words, F.col("start"), F.col("start") + F.col("size")

        def n(b: Column) -> Column:
            return (F.least(end, (b + 1) * w) - F.greatest(start, b * w)).cast("int")

        def cut(found: Column) -> Column:  # an element of a one-element array, so that the words are found once
            return F.transform(
                F.sequence(F.floor(start / w), F.floor((end - 1) / w)),
                lambda b: F.struct(b.alias("block"), n(b).alias("n"), F.array_join(F.slice(found, (F.greatest(b * w - start, F.lit(0)) + 1).cast("int"), n(b)), " ").alias("text")),
            )

        parts = rows.select("s", "source", "doc_id", "start", F.explode(F.flatten(F.transform(F.array(words(F.col("text"))), cut))).alias("part"))
        packed = parts.select("s", "source", "part.block", F.struct("start", "doc_id", "part.n", "part.text").alias("part")).groupBy("s", "block").agg(F.first("source").alias("source"), F.array_sort(F.collect_list("part")).alias("parts"))
        part = lambda name: F.transform("parts", lambda x: x[name])
        filled = packed.select("s", "block", "source", part("doc_id").alias("doc_ids"), F.aggregate(part("n"), F.lit(0), lambda a, x: a + x).alias("n_words"), F.array_join(part("text"), " ").alias("text"))
        return self.slots().join(filled, ["s", "block"]).select("shard", "slot", "source", "block", "doc_ids", "n_words", "text")
