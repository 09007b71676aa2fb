"""MinHash near-dedup: documents whose sets of word shingles overlap enough are linked; links make components.

One pass makes every document's signature by one-permutation hashing: each shingle falls into one of BANDS * ROWS bins,
a bin keeps its least hash, and an empty bin copies a non-empty one that a hash of the bin chooses (optimal
densification). ROWS bins make a band; documents with an equal band share a bucket. Two documents at the threshold of
0.85 miss each other in all 26 bands of 5 rows with probability (1 - 0.85^5)^26 = 2e-7.

Documents with equal sets are one class with its smallest id as representative; only that id goes on. A bucket's candidates
are a star: every member against one hub, so their number is that of the members. A star can miss a link between two
members that are not linked to its hub, so those get further stars, and what is left is finished exactly: see `links`.
All candidates are confirmed on the full sets. Components come from alternating stars over the confirmed links.

A text's words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case. Null text or no words: an empty set, linked to nothing.
Fewer words than a shingle: the whole sequence is the one shingle. Null id: component null, kept. Repeated ids are one
node. Empty table: no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.llm.blocks import BITMAP_BITS, bitmap, marked, text_size
from codehealth.llm.shared import pieces_for, saved
from codehealth.llm.words import in_one_row, mix, small_batches, text_bytes, window_hashes, word_hashes, words_of

SHINGLE, BANDS, ROWS, PERCENT = 5, 26, 5, 85
GROUP_BYTES = 16 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(batch: pa.RecordBatch, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, in order."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    data = _LOWER[data]
    starts, ends, row = words_of(data, offsets)
    h = word_hashes(data, starts, ends)
    good = in_one_row(row, size)
    rows, hashes = [row[: len(good)][good]], [window_hashes(h, size)[good]]
    n = np.bincount(row, minlength=batch.num_rows)
    first = np.cumsum(n) - n
    for k in range(1, size):  # texts of k words
        short = np.flatnonzero(n == k)
        if len(short):
            rows.append(short)
            hashes.append(mix(window_hashes(h, k)[first[short]] + np.uint64(k)))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])][: len(h)]
    return row[new], h[new]


def lenders(bins: int, tries: int = 4096) -> np.ndarray:
    """For each try, the bin that an empty bin looks at: the same for all documents."""
    key = np.arange(tries, dtype=np.uint64)[:, None] * np.uint64(1_000_003) + np.arange(bins, dtype=np.uint64)[None, :]
    return (mix(mix(key + np.uint64(17))) % np.uint64(bins)).astype(np.int64)


def signatures(row: np.ndarray, h: np.ndarray, n_rows: int, bins: int, table: np.ndarray) -> np.ndarray:
    """Least hash of each bin (n_rows x bins), empty bins filled from others; rows without shingles stay full of ones."""
    h = mix(h + np.uint64(0x2545F4914F6CDD1D))
    out = np.full(n_rows * bins, _FULL, np.uint64)
    np.minimum.at(out, row * bins + (h % np.uint64(bins)).astype(np.int64), h // np.uint64(bins))
    out = out.reshape(n_rows, bins)
    own = out != _FULL
    at, bin_ = np.nonzero(~own & own.any(axis=1)[:, None])
    for look in table:
        if not len(at):
            break
        from_ = look[bin_]
        full = own[at, from_]
        out[at[full], bin_[full]] = out[at[full], from_[full]]
        at, bin_ = at[~full], bin_[~full]
    if len(at):  # after thousands of tries: the first full bin
        out[at, bin_] = out[at, own[at].argmax(axis=1)]
    return out


SIGNED = "doc_id long, n long, set_a long, set_b long, bands array<long>, bits array<long>"


#: Bits of an odd sketch.
SKETCH = 1024


def odd_sketch(row: np.ndarray, h: np.ndarray, n_rows: int) -> np.ndarray:
    """Per row, SKETCH bits as 64-bit integers: a bit is set if an odd number of shingles falls on it. The bits in which two
    sketches differ are those of the shingles that only one row has, so their number never exceeds that of these shingles."""
    bit = (mix(h + np.uint64(0x5851F42D4C957F2D)) % np.uint64(SKETCH)).astype(np.int64)
    odd = np.bincount(row * SKETCH + bit, minlength=n_rows * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n_rows, SKETCH), axis=1, bitorder="little").view(np.int64)


def unlike(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def signed(bands: int, rows: int, size: int) -> Callable:
    table = lenders(bands * rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            row, h = shingles(batch, "text", size)
            m = batch.num_rows
            n = np.bincount(row, minlength=m)
            sums = []
            for salt in (1, 2):
                total = np.zeros(m, np.uint64)
                np.add.at(total, row, mix(h + np.uint64(salt)))
                sums.append(total.view(np.int64))
            sig = signatures(row, h, m, bands * rows, table)
            bits = odd_sketch(row, h, m)
            sig = sig.reshape(m, bands, rows)
            key = np.tile(np.arange(bands, dtype=np.uint64), (m, 1))
            for i in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, i])
            keys = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * bands), pa.array(key.view(np.int64).ravel()))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *map(pa.array, sums), keys, bits], names=["doc_id", "n", "set_a", "set_b", "bands", "bits"])

    return work


def confirmed(percent: int, size: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of the pairs (a, b) of a group, those whose full sets overlap by `percent` at least."""

    def work(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        for batch in small_batches(iter(texts.select(["doc_id", "text"]).to_batches())):
            row, h = shingles(batch, "text", size)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for i, doc in enumerate(batch.column(0).to_pylist()):
                sets.setdefault(doc, []).append(h[cut[i] : cut[i + 1]])
        a_list, b_list = pairs["a"].to_pylist(), pairs["b"].to_pylist()
        good = [any(overlaps(x, y, percent) for x in sets[a] for y in sets[b]) for a, b in zip(a_list, b_list)]
        return pairs.select(["a", "b"]).append_column("good", pa.array(good, pa.bool_()))

    return work


def overlaps(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirm(texts: DataFrame, pairs: DataFrame, parts: int, percent: int, size: int) -> DataFrame:
    """a, b, good of each pair, as a table. A pair goes to a group of its member a, so the pairs of one hub are spread over
    all groups, and each text goes once to every group that needs it."""
    placed = pairs.withColumn("grp", F.pmod(F.xxhash64("a"), F.lit(parts)).cast("int"))
    needed = placed.select(F.col("grp").alias("at"), F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sent = merging(texts, needed, "doc_id").select("at", "doc_id", "text")
    return saved(sent.groupBy("at").cogroup(placed.groupBy("grp")).applyInArrow(confirmed(percent, size), "a long, b long, good boolean"), "verdicts")


def merging(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A sort-merge join whatever the sizes: none of the many small joins builds a table on the driver."""
    return left.join(right.hint("merge"), on, how)


def bit_of(name: str):
    return F.pmod(F.xxhash64(name), F.lit(BITMAP_BITS)).cast("int")


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that it reaches) of every node of links (a, b), by alternating large and small
    stars (Kiveris and others, 2014). A node with many links meets its least neighbour in salted parts. Only a count and a
    checksum come to the driver."""
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).select("u", "v", F.least("u", "m").alias("m")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = with_least(large).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = saved(small.filter("u <> v").distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now


#: Rounds of stars at most, before what is left is compared pair by pair.
STARS = 2
#: Parts of a bucket or of a node's links that meet their hub in tasks of their own, 64 at most: they are bits of a number.
SALTS = 64


def salt_of(name: str):
    return F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int").alias("salt")


def salts_seen():
    return F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")


def each_salt():
    """A row for each salt in the bits `salts`."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda x: F.call_function("getbit", F.col("salts"), x) == 1)).alias("salt")


def with_group(rows: DataFrame, key: str, member: str, *found, only: str = "true") -> DataFrame:
    """rows with the aggregates `found` of all rows with the same key, of the groups that satisfy `only`. The aggregate is summed
    up before the shuffle and joined back in parts by a hash of `member`, so a group of any size is no single task's."""
    salted = rows.select("*", salt_of(member))
    group = salted.groupBy(key).agg(*found, salts_seen()).filter(only)
    names = [c for c in group.columns if c not in (key, "salts")]
    return merging(salted, group.select(key, *names, each_salt()), [key, "salt"]).drop("salt")


def with_least(links: DataFrame) -> DataFrame:
    """links (u, v) with m, the least v of each u."""
    return with_group(links, "u", "v", F.min("v").alias("m")).select("u", "v", "m")


def likely(percent: int):
    """What follows from 100 * shared >= percent * all, for sizes n, m and odd sketches: it rules out no link."""
    sizes_fit = F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m")
    return sizes_fit & (unlike("bits", "hub_bits") * F.lit(100 + percent) <= F.lit(100 - percent) * (F.col("n") + F.col("m")))


def stars(now: DataFrame, about: DataFrame, turn: int) -> DataFrame:
    """bucket, doc_id, n, b, m, hub_bits of the members (bucket, doc_id, n) of every bucket with two or more, as a table: b
    is the bucket's hub, another one each turn. A bucket of any size meets its hub in SALTS parts."""
    now = now.select("*", salt_of("doc_id"))
    order = F.struct((F.xxhash64("doc_id", F.lit(turn)) if turn else F.col("doc_id")).alias("order"), F.col("doc_id").alias("b"))
    hubs = now.groupBy("bucket").agg(F.count("*").alias("c"), F.min(order).alias("h"), salts_seen()).filter("c > 1")
    hubs = merging(hubs.select("bucket", "h.b", "salts"), about.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("bits").alias("hub_bits")), "b")
    return saved(merging(now, hubs.select("bucket", "b", "m", "hub_bits", each_salt()), ["bucket", "salt"]).drop("salt"), "members")


def links(texts: DataFrame, reps: DataFrame, more: DataFrame, parts: int, percent: int, size: int) -> DataFrame:
    """node, component of all links between documents that share a bucket, and of the links `more` (a, b).

    In each round every bucket's members meet one of them, the hub, and those that are linked to it are done with; the
    others of a bucket make the next round. After STARS rounds, or when a round finds no link, the buckets whose members
    still lie in several components are finished exactly: members outside a bucket's largest component are compared with all
    members of other components and of a like size. Sizes or sketches that rule a link out end a pair inside the join."""
    about = reps.select("doc_id", "n", "bits")
    members = stars(reps.select("doc_id", "n", F.explode("bands").alias("bucket")), about, 0)
    bits = bitmap(members.select(bit_of("doc_id").alias("bit")))
    texts = saved(marked(texts.withColumn("bit", bit_of("doc_id")), bits, True).select("doc_id", "text"), "shared_texts")
    now, good = members, []
    for turn in range(STARS):
        pairs = now.filter("doc_id <> b").select(F.col("doc_id").alias("a"), "b", "m", "hub_bits").dropDuplicates(["a", "b", "m", "hub_bits"])
        pairs = saved(merging(pairs, about.withColumnRenamed("doc_id", "a"), "a").filter(likely(percent)).select("a", "b").distinct(), "pairs")
        if pairs.isEmpty():
            break
        good.append(confirm(texts, pairs, parts, percent, size).filter("good").select("a", "b"))
        if turn + 1 == STARS or good[-1].isEmpty():
            break
        rest = merging(now.filter("doc_id <> b"), good[-1].withColumnRenamed("a", "doc_id"), ["doc_id", "b"], "left_anti")
        now = stars(rest.select("bucket", "doc_id", "n"), about, turn + 1)
    found = more
    for x in good:
        found = found.unionByName(x)
    comps = components(found)

    # equal sizes, or sizes that may belong together, are in one class or in neighbouring ones
    step = F.floor(F.log("n") / (1.0001 * math.log(100 / percent))).cast("int") if percent < 100 else F.col("n").cast("int")
    now = unresolved(members.select("bucket", "doc_id"), comps).select("*", salt_of("doc_id"))
    sizes = now.groupBy("bucket", "comp").agg(F.count("*").alias("c"), salts_seen())
    most = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.bit_or("salts").alias("salts"))
    now = merging(now, most.select("bucket", "main", each_salt()), ["bucket", "salt"]).drop("salt")
    now = saved(merging(now, about, "doc_id").withColumn("step", step), "unresolved")
    outer = now.filter("comp <> main").select("bucket", F.col("doc_id").alias("a"), F.col("n").alias("m"), F.col("bits").alias("hub_bits"), F.col("comp").alias("own"), F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"))
    inner = now.select(F.col("bucket").alias("of"), F.col("step").alias("near"), F.col("doc_id").alias("b"), "n", "bits", "comp", "main")
    apart = (F.col("own") != F.col("comp")) & ((F.col("comp") == F.col("main")) | (F.col("a") < F.col("b")))
    pairs = saved(merging(outer, inner, (F.col("bucket") == F.col("of")) & (F.col("step") == F.col("near")) & apart & likely(percent)).select("a", "b").distinct(), "pairs")
    if pairs.isEmpty():
        return comps
    late = confirm(texts, pairs, parts, percent, size).filter("good").select("a", "b")
    return comps if late.isEmpty() else components(late.unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def unresolved(members: DataFrame, comps: DataFrame) -> DataFrame:
    """The members, with their component, of buckets that lie in several."""
    now = merging(members, comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
    return with_group(now, "bucket", "doc_id", F.min("comp").alias("lo"), F.max("comp").alias("hi"), only="lo < hi").drop("lo", "hi")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    parts = 2 * pieces_for(spark, text_size(docs, text_col), group_bytes)
    signs = saved(texts.mapInArrow(signed(bands, rows, size), SIGNED), "signatures")
    key = ["n", "set_a", "set_b"]
    known = signs.filter("n > 0 and doc_id is not null")
    classes = saved(known.groupBy(key).agg(F.min("doc_id").alias("rep")), "classes")
    reps = saved(merging(known, classes.withColumnRenamed("rep", "doc_id"), [*key, "doc_id"]).dropDuplicates([*key, "doc_id"]).select("doc_id", "n", "bands", "bits"), "representatives")
    # an id that stands more than once may be in several classes: they are linked by it
    twice = known.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id")
    more = merging(merging(known.select("doc_id", *key), twice, "doc_id"), classes, key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comps = links(texts, reps, more, parts, percent, size)
    of = merging(classes, comps, classes["rep"] == comps["node"], "left").select(*key, F.coalesce("component", "rep").alias("of"))
    # only known rows look for their class: rows without words or id would meet under one key
    own = merging(known.select("doc_id", *key), of, key).select("doc_id", "n", F.col("of").alias("component_id"))
    rest = signs.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return own.unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents (all columns) without those whose component has a smaller id."""
    found = near_duplicates(docs, id_col, text_col, **options).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(found, docs[id_col] == found["__gone"], "left_anti")
