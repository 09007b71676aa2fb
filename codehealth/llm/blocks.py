"""Substring dedup with fixed-block anchors.

A window of `window` words that stands twice holds, in either place, a whole block of a fixed grid of
(window + 1) // 2 words. So non-overlapping blocks are the index, and every rolling window of a block's length
probes it: a block is an anchor if its words start at least twice. Around anchors, hits are extended: the full
windows that hold the block are compared by two hashes of 64 bits, and runs of repeated windows are the maximal repeats.
Every word of a repeated window is removed, in all places.

How the data move. A task hashes its texts in pieces and sends each distinct hash once per piece, so a passage that
a third of all documents share costs one entry per piece, not one per document. Hashes travel as packed arrays
of a shard (a range of hashes), verdicts as packed arrays of a group (documents by hash of their id). Shards and
groups grow in number with the input, not in size. Texts without any anchor are not shuffled: a bitmap of fixed
size tells most of them.

Null text: empty. Fewer words than a window: nothing is removed. Repeated rows are documents of their own, so each
repeats the other. Null ids are allowed. Empty table: no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.llm.shared import pieces_for, saved
from codehealth.llm.words import in_one_row, mix, small_batches, text_bytes, window_hashes, word_hashes, words_of

WINDOW = 35
#: Bytes of text that a group or a shard stands for, and that a task hashes before it sends.
GROUP_BYTES, PIECE_BYTES = 6 << 20, 6 << 20
#: Bits of the bitmap that keeps texts without anchors from moving: 8 MB, whatever the input.
BITMAP_BITS = 1 << 26
#: Sets the second hash of a window apart from the first.
_SECOND = np.uint64(0xA0761D6478BD642F)

PROBES = "shard int, probes binary, blocks binary, ids binary, ties binary, places binary, own binary"
HITS = "grp int, ids binary, ties binary, places binary"


def rows_of(docs: DataFrame, id_col: str, text_col: str, groups: int) -> DataFrame:
    """doc_id, text, and a key of the row: id (null: below all ids, by a hash of the text, so that a table without ids is not
    one group), tie (hash of the text), grp, bit."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    id_ = F.coalesce(docs[id_col].cast("long"), F.pmod(F.xxhash64(text, F.lit(2)), F.lit(1 << 61)) + F.lit(-(1 << 63)))
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        text.alias("text"),
        id_.alias("id"),
        F.xxhash64(text).alias("tie"),
        F.pmod(id_, F.lit(groups)).cast("int").alias("grp"),
        F.pmod(F.xxhash64(id_, F.lit(1)), F.lit(BITMAP_BITS)).cast("int").alias("bit"),
    )


def hashed_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word of a batch."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
    starts, ends, row = words_of(data, offsets)
    return word_hashes(data, starts, ends), row


def dealt(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that has elements, and which ones they are: the work follows the elements, not the number of shards."""
    order = np.argsort(shard, kind="stable")
    found, cut = np.unique(shard[order], return_index=True)
    cut = [*cut.tolist(), len(order)]
    yield from ((s, order[a:b]) for s, a, b in zip(found.tolist(), cut, cut[1:]))


def probe(block: int, shards: int, piece_bytes: int) -> Callable:
    """Per piece and shard: the upper halves of all rolling windows' hashes (one that is in the piece twice stands
    twice), and the blocks whose hash is in the piece once. Blocks that the piece itself repeats are anchors: `own` marks
    them."""

    def sent(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([x[0] for x in parts])
        if not len(h):
            return
        value, times = np.unique(h, return_counts=True)
        b_hash, b_id, b_tie, b_at = (np.concatenate([x[i] for x in parts]) for i in range(1, 5))
        again = times[np.searchsorted(value, b_hash)] > 1
        # anchors already known need no key: they are spread over the shards
        shard = np.where(again, np.arange(len(b_hash)) % shards, (b_hash % np.uint64(shards)).astype(np.int64))
        blocks_of, none = dict(dealt(shard)), np.zeros(0, np.int64)
        probes_of = dict(dealt((value % np.uint64(shards)).astype(np.int64)))
        rows = []
        for s in probes_of | blocks_of:
            p, b = probes_of.get(s, none), blocks_of.get(s, none)
            upper = np.repeat((value[p] >> np.uint64(32)).astype(np.uint32), np.minimum(times[p], 2))
            own = [upper, (b_hash[b] >> np.uint64(32)).astype(np.uint32), b_id[b], b_tie[b], b_at[b].astype(np.uint32), again[b]]
            rows.append((s, *(x.tobytes() for x in own)))
        kinds = [pa.int32()] + [pa.binary()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["shard", "probes", "blocks", "ids", "ties", "places", "own"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in small_batches(batches):
            h, row = hashed_words(batch)
            rolling, good = window_hashes(h, block), in_one_row(row, block)
            ids, ties = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("id", "tie"))
            first = np.searchsorted(row, row)  # the first word of the row of each word
            place = np.arange(len(h)) - first
            at = np.flatnonzero(good & (place[: len(good)] % block == 0))
            parts.append((rolling[good], rolling[at], ids[row[at]], ties[row[at]], place[at] // block))
            size += text_bytes(batch.column(batch.schema.get_field_index("text")))[0].nbytes
            if size >= piece_bytes:
                yield from sent(parts)
                parts, size = [], 0
        if parts:
            yield from sent(parts)

    return work


def joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The packed arrays of a column, one after another."""
    return np.frombuffer(b"".join(x.as_py() for x in column if x.is_valid), kind)


def by_group(grp: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.Table:
    """One row of packed arrays for each group."""
    order = np.argsort(grp, kind="stable")
    found, cut = np.unique(grp[order], return_index=True)
    cut = [*cut, len(order)]
    packed = [[c[order[a:b]].tobytes() for a, b in zip(cut, cut[1:])] for c in columns]
    return pa.table([pa.array(found, pa.int32()), *(pa.array(p, pa.binary()) for p in packed)], names=["grp", *names])


def anchors(groups: int) -> Callable[[pa.Table], pa.Table]:
    """The blocks of a shard whose hash starts twice or more, by group."""

    def work(table: pa.Table) -> pa.Table:
        value, times = np.unique(joined(table["probes"], np.uint32), return_counts=True)
        twice = value[times > 1]
        blocks = joined(table["blocks"], np.uint32)
        at = np.minimum(np.searchsorted(twice, blocks), max(len(twice) - 1, 0))
        hit = joined(table["own"], bool) | (len(twice) > 0 and twice[at] == blocks)
        ids, ties, places = joined(table["ids"], np.int64)[hit], joined(table["ties"], np.int64)[hit], joined(table["places"], np.uint32)[hit]
        return by_group((ids % groups).astype(np.int32), [ids, ties, places], ["ids", "ties", "places"])

    return work


def group_count(n: int) -> int:
    """The least prime from n on: ids modulo a prime are spread evenly, whatever their step."""
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def ordered(texts: pa.Table) -> pa.Table:
    """The documents of a group in the order in which positions in the group count."""
    return texts.sort_by([("id", "ascending"), ("tie", "ascending")]).combine_chunks()


def group_hashes(texts: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word, two hashes of each window that starts at a word, whether that window lies in one row."""
    hashes, rows, at = [], [], 0
    for batch in small_batches(iter(texts.to_batches())):
        h, row = hashed_words(batch)
        hashes.append(h)
        rows.append(row + at)
        at += batch.num_rows
    h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    row = np.concatenate([*rows, np.zeros(0, np.int64)])
    return row, window_hashes(h, window), window_hashes(mix(h ^ _SECOND), window), in_one_row(row, window)


def same_windows(h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window the index of its kind (equal in both hashes), and of each kind the first window and how many."""
    order = np.lexsort((check, h))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])][: len(h)]
    kind = np.empty(len(h), np.int64)
    kind[order] = np.cumsum(new) - 1
    return kind, order[new], np.bincount(kind, minlength=int(new.sum()))


def extend(window: int, block: int, shards: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a group's documents and anchors: by shard, both hashes of each distinct window that holds an anchor, with a place."""

    def work(texts: pa.Table, hits: pa.Table) -> pa.Table:
        texts = ordered(texts)
        row, h, check, good = group_hashes(texts, window)
        first = np.searchsorted(row, np.arange(texts.num_rows))
        ids, ties, places = joined(hits["ids"], np.int64), joined(hits["ties"], np.int64), joined(hits["places"], np.uint32)
        order = np.lexsort((ties, ids))
        ids, ties, places = ids[order], ties[order], places[order]
        own = np.rec.fromarrays([ids, ties], names="id,tie")
        edges = np.zeros(len(row) + 1, np.int64)
        for i, key in enumerate(zip(texts["id"].to_pylist(), texts["tie"].to_pylist())):
            key = np.array([key], own.dtype)
            a, b = np.searchsorted(own, key, "left")[0], np.searchsorted(own, key, "right")[0]
            start = first[i] + places[a:b].astype(np.int64) * block
            np.add.at(edges, np.maximum(start - (window - block), first[i]), 1)
            np.add.at(edges, start + 1, -1)
        near = np.cumsum(edges)[: len(h)] > 0
        at = np.flatnonzero(near & good)
        at = at[same_windows(h[at], check[at])[1]]
        grp = texts["grp"][0].as_py() if texts.num_rows else 0
        rows = [(s, grp, h[at[o]].tobytes(), check[at[o]].tobytes(), at[o].astype(np.uint32).tobytes()) for s, o in dealt((h[at] % np.uint64(shards)).astype(np.int64))]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names=["shard", "grp", "hashes", "checks", "places"])

    return work


def repeated(table: pa.Table) -> pa.Table:
    """Of a shard: the places whose window comes from more than one group."""
    sizes = [len(x.as_py()) // 8 for x in table["hashes"]]
    h, places = joined(table["hashes"], np.uint64), joined(table["places"], np.uint32)
    grp = np.repeat(table["grp"].to_numpy().astype(np.int32), sizes)
    kind, _, times = same_windows(h, joined(table["checks"], np.uint64))
    good = times[kind] > 1
    return by_group(grp[good], [places[good]], ["places"])


def removed_words(texts: pa.Table, places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Row of each word and whether it goes: its group or another one repeats a window that covers it."""
    row, h, check, good = group_hashes(texts, window)
    inside = np.flatnonzero(good)
    kind, _, times = same_windows(h[inside], check[inside])
    bad = times > 1
    bad[kind[np.searchsorted(inside, places.astype(np.int64))]] = True
    edges = np.zeros(len(row) + 1, np.int64)
    start = inside[bad[kind]] if len(inside) else inside
    np.add.at(edges, start, 1)
    np.add.at(edges, start + window, -1)
    return row, np.cumsum(edges)[:-1] > 0


def finished(window: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def work(texts: pa.Table, found: pa.Table) -> pa.Table:
        texts = ordered(texts)
        row, gone = removed_words(texts, joined(found["places"], np.uint32), window)
        cut = np.searchsorted(row, np.arange(texts.num_rows + 1))
        n, lost, kept = [], [], []
        for i, text in enumerate(texts["text"]):
            own = gone[cut[i] : cut[i + 1]]
            words = text.as_py().encode().split()
            kept.append(b" ".join(w for w, g in zip(words, own) if not g).decode() if own.any() else b" ".join(words).decode())
            n.append(len(words))
            lost.append(int(own.sum()))
        return pa.table([texts["doc_id"], pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return work


RESULT = "doc_id long, n_words long, n_removed long, kept string"


def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [(x.as_py() or "").encode().split() for x in batch.column(1)]
        columns = [batch.column(0), pa.array([len(x) for x in words], pa.int64()), pa.array([0] * len(words), pa.int64()), pa.array([b" ".join(x).decode() for x in words], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])


def bitmap(ids: DataFrame) -> np.ndarray:
    """BITMAP_BITS bits, set for the column `bit` of ids: at most 2,048 rows of 4 KB come to the driver."""
    parts = ids.select(F.expr("bit div 32768").alias("part"), F.expr("bit % 32768").alias("at")).groupBy("part").agg(F.expr("bitmap_construct_agg(at)").alias("bits"))
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in parts.collect():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def ids_in(table: DataFrame) -> DataFrame:
    """The `bit` of each id in the packed column ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(joined(pa.chunked_array([batch.column(0)]), np.int64)))], names=["id"])

    return table.select("ids").mapInArrow(work, "id long").select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(BITMAP_BITS)).cast("int").alias("bit"))


def marked(rows: DataFrame, bits: np.ndarray, wanted: bool) -> DataFrame:
    """The rows whose `bit` is set (or is not)."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(batch.schema.get_field_index("bit")).to_numpy()
            own = (shared.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            yield batch.filter(pa.array(own == wanted))

    return rows.mapInArrow(work, rows.schema)


def text_size(docs: DataFrame, text_col: str) -> int:
    return int(docs.agg(F.sum(F.octet_length(docs[text_col].cast("string")))).first()[0] or 0)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, piece_bytes: int = PIECE_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of every document."""
    spark, block = docs.sparkSession, (window + 1) // 2
    parts = pieces_for(spark, text_size(docs, text_col), group_bytes)
    shards = groups = group_count(2 * parts)
    rows = rows_of(docs, id_col, text_col, groups)
    probes = rows.select("text", "id", "tie").mapInArrow(probe(block, shards, piece_bytes), PROBES)
    hits = saved(probes.groupBy("shard").applyInArrow(anchors(groups), HITS), "anchors")

    bits = bitmap(ids_in(hits))
    near = marked(rows, bits, True)
    sent = near.groupBy("grp").cogroup(hits.groupBy("grp")).applyInArrow(extend(window, block, shards), "shard int, grp int, hashes binary, checks binary, places binary")
    found = sent.groupBy("shard").applyInArrow(repeated, "grp int, places binary")
    cut = near.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(finished(window), RESULT)
    return cut.unionByName(marked(rows, bits, False).select("doc_id", "text").mapInArrow(untouched, RESULT))
