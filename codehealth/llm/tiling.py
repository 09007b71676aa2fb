"""Benchmark decontamination by greedy string tiling.

Tokens are runs of ASCII letters, digits and non-ASCII bytes of the lower-case text. A document and a test item that share a
seed of `min_match` tokens are a candidate pair. Over a pair, the longest common run of tokens that are not yet in a tile
becomes a tile, again and again, down to `min_match`; runs are found by rolling hashes of the seeds (Karp and Rabin) and
grow along diagonals. Tiles may stand in any order, so reordered passages count in full. A document is contaminated by
an item if tiles cover `threshold` of the item's tokens.

Words that repeat make many seed pairs. An item whose shared seeds could not cover enough of it is left before pairs are
made; else pairs are made in slices of PAIRS at most, of which only the ends of each run are kept, so memory is bounded and
no match is dropped.

Only the benchmark is broadcast, a block of about `block_bytes` of text at a time; a larger benchmark takes more passes over
the documents, one after another. Documents are not shuffled, and each is read whole.

Null text or null item: no tokens, no match. Items of fewer tokens than `min_match` must match whole. Repeated rows: each
is judged. Empty tables: no rows, or nothing contaminated. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.llm.shared import saved
from codehealth.llm.words import in_one_row, small_batches, text_bytes, window_hashes, word_hashes

MIN_MATCH, THRESHOLD, BLOCK_BYTES = 5, 0.5, 4 << 20
#: Pairs of places that are looked at together.
PAIRS = 1 << 20

_TOKEN = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _TOKEN[_a:_b] = True

RESULT = "doc_id long, item_id long, n_tiles long, longest long, covered long, n_tokens long, coverage double"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each token."""
    data, offsets = text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _TOKEN[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    first[borders], last[borders - 1] = inside[borders], inside[borders - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return word_hashes(data, starts, ends), np.searchsorted(offsets, starts, "right") - 1


class Items:
    """Test items with an index of their seeds: for each seed length, sorted hashes with (item, position)."""

    def __init__(self, ids: list[int], texts: list[str | None], min_match: int):
        h, row = tokens(pa.array(texts, pa.string()))
        cut = np.searchsorted(row, np.arange(len(ids) + 1))
        self.ids, self.tokens = ids, [h[a:b] for a, b in zip(cut, cut[1:])]
        seeds = defaultdict(list)
        for i, own in enumerate(self.tokens):
            size = min(min_match, len(own))
            if size:
                seeds[size].append((window_hashes(own, size), i))
        self.seeds = {}
        for size, rows in seeds.items():
            value = np.concatenate([x for x, _ in rows])
            item = np.concatenate([np.full(len(x), i) for x, i in rows])
            place = np.concatenate([np.arange(len(x)) for x, _ in rows])
            order = np.argsort(value, kind="stable")
            self.seeds[size] = value[order], item[order], place[order]


def longest_free(busy: np.ndarray) -> int:
    edges = np.flatnonzero(np.r_[True, busy, True])
    return int(np.diff(edges).max()) - 1


def tiles(runs: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(position in the item, position in the document, length) of the tiles over maximal equal runs, given in the same
    form. Longest first; among equals the first in the item, then in the document. What earlier tiles left of a run is cut
    out of it and waits its turn. The search ends as soon as the item has no free place of `size` tokens, so words
    that repeat, and make many runs, cost a sort of these and little more."""
    if not len(runs):
        return []
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0], -runs[:, 2]))]
    ends = runs[:, :2] + runs[:, 2:]
    reached = np.zeros(int(ends[:, 0].max()) + 1, np.int64)
    np.add.at(reached, runs[:, 0], 1)
    np.add.at(reached, ends[:, 0], -1)
    in_item, in_doc = np.cumsum(reached)[:-1] == 0, np.zeros(int(ends[:, 1].max()), bool)  # what no run reaches is not free
    left, at, out = [], 0, []
    while at < len(runs) or left:
        own = (-int(runs[at, 2]), int(runs[at, 0]), int(runs[at, 1])) if at < len(runs) else None
        if own is None or left and left[0] < own:
            n, a, b = heapq.heappop(left)
        else:
            n, a, b = own
            at += 1
        busy = in_item[a : a - n] | in_doc[b : b - n]
        if not busy.any():
            out.append((a, b, -n))
            in_item[a : a - n] = in_doc[b : b - n] = True
            if longest_free(in_item) < size:
                break
            continue
        edges = np.flatnonzero(np.r_[True, busy, True])
        free = np.flatnonzero(np.diff(edges) > size)
        for k, end in zip(edges[free].tolist(), (edges[free + 1] - 1).tolist()):
            heapq.heappush(left, (k - end, a + k, b + k))
    return out


def candidates(h: np.ndarray, row: np.ndarray, items: Items, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(row, item, seed length) of all rows and items whose shared seeds may cover enough of the item."""
    for size, (value, item, place) in items.seeds.items():
        rolling, at = window_hashes(h, size), np.flatnonzero(in_one_row(row, size))
        at = at[value[np.minimum(np.searchsorted(value, rolling[at]), len(value) - 1)] == rolling[at]]
        # each seed once per row, however often it stands there
        seed, own = np.unique(np.stack([rolling[at], row[at].astype(np.uint64)]), axis=1) if len(at) else (np.zeros(0, np.uint64),) * 2
        low, high = np.searchsorted(value, seed, "left"), np.searchsorted(value, seed, "right")
        n = high - low
        where = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair, shared = np.unique(np.stack([np.repeat(own, n).astype(np.int64), item[where]]), axis=1, return_counts=True) if len(where) else (np.zeros((2, 0), np.int64), ())
        for r, i, places in zip(*pair.tolist(), shared):
            if places * size >= threshold * len(items.tokens[i]):  # even if no seeds overlapped
                yield r, i, size


def equal_runs(doc: np.ndarray, item: np.ndarray, size: int) -> np.ndarray:
    """(position in the item, position in the document, length) of all maximal runs of `size` or more equal tokens."""
    seeds, own = window_hashes(item, size), window_hashes(doc, size)
    order = np.argsort(seeds, kind="stable")
    low, high = np.searchsorted(seeds[order], own, "left"), np.searchsorted(seeds[order], own, "right")
    at = np.flatnonzero(high > low)
    n = (high - low)[at]
    cut = [*np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), PAIRS)), len(at)]
    ends: tuple[list, list] = ([], [])
    for a, b in zip(cut, cut[1:]):
        k = n[a:b]
        d = np.repeat(at[a:b], k)
        i = order[np.repeat(low[at[a:b]], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
        for found, edge, x, y in ((ends[0], (i == 0) | (d == 0), i - 1, d - 1), (ends[1], (i + size == len(item)) | (d + size == len(doc)), i + size, d + size)):
            edge = edge | (item[np.where(edge, 0, x)] != doc[np.where(edge, 0, y)])
            found.append(np.stack([(d - i)[edge], i[edge]]))
    # on a diagonal, first and last seeds of runs take turns
    first, last = (np.concatenate(x, axis=1) if x else np.zeros((2, 0), np.int64) for x in ends)
    first, last = (x[:, np.lexsort((x[1], x[0]))] for x in (first, last))
    return np.stack([first[1], first[1] + first[0], last[1] - first[1] + size], axis=1)


def covers(column: pa.Array, items: Items, threshold: float) -> Iterator[tuple]:
    """row, item id, tiles, longest tile, covered tokens, tokens of the item, for items covered well enough."""
    h, row = tokens(column)
    for r, i, size in candidates(h, row, items, threshold):
        a, b = np.searchsorted(row, (r, r + 1))
        n = len(items.tokens[i])
        found = tiles(equal_runs(h[a:b], items.tokens[i], size), size)
        covered = sum(x[2] for x in found)
        if covered >= threshold * n:
            yield r, items.ids[i], len(found), max(x[2] for x in found), covered, n


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, min_match: int, block_bytes: int) -> Iterator[tuple[Items, bool]]:
    """The benchmark in blocks of about the bound, each collected when it is asked for; and whether it is the last one."""
    items = benchmark.select(benchmark[id_col].cast("long").alias("id"), benchmark[text_col].cast("string").alias("text")).filter("text is not null")
    total = int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).orderBy("id", "text").collect()
        yield Items([r["id"] for r in own], [r["text"] for r in own], min_match), k + 1 == blocks


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each contaminated document and item."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = None
    for items, last in item_blocks(benchmark, item_col, item_text_col, min_match, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        found = rows.mapInArrow(reported(shared, threshold), RESULT)
        if not last:  # its pass is over before the next block comes
            found = saved(found, "contaminated")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], RESULT)


def reported(shared, threshold: float) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = list(covers(batch.column(1), shared.value, threshold))
            if found:
                row, item, n, longest, covered, size = map(np.array, zip(*found))
                columns = [batch.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (item, n, longest, covered, size)), pa.array(covered / size)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RESULT.split(", ")])

    return work


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents (all columns) that no item contaminates."""
    for items, last in item_blocks(benchmark, item_col, item_text_col, min_match, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        docs = docs.mapInArrow(clean_only(shared, threshold, text_col), docs.schema)
        if not last:
            docs = saved(docs, "clean")
            shared.destroy()
    return docs


def clean_only(shared, threshold: float, text_col: str) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_col):
            good = np.ones(batch.num_rows, bool)
            column = batch.column(batch.schema.get_field_index(text_col))
            good[[x[0] for x in covers(column, shared.value, threshold)]] = False
            yield batch.filter(pa.array(good))

    return work
