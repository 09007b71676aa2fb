"""Top documents for each query by an integer BM25, with the Best Position Algorithm over impact lists.

Three steps:

1. A forward index: each document's number of terms, and the query terms that it holds with their counts. Texts are read
   once and not shuffled.
2. Counts over all documents: how many have a term, how many terms they have, and how many documents hold each query term.
3. The search. A task takes its documents a piece at a time. In a piece each query term has an impact list: the documents
   that hold it, best first. For a query the lists are read in step; a document met in one is looked up in all others at once
   (direct access), which gives its score and marks its places. A list's best position is the end of its places seen without
   a gap, by whichever access. No unseen document scores more than the sum of what the lists hold just after their best
   positions, which falls faster than the sum at the last places read. A query stops as soon as that sum is strictly below
   its k-th score so far, that of earlier pieces of the task included; at a tie it goes on, as a smaller id may come.

Each task gives k rows a query at most. They meet in salted groups first and then by query, so no group grows with the input.
Queries are broadcast in blocks of about `block_bytes` of text; more of them take more passes, one after another.

Terms are longest runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case. Null or empty texts have
none: such documents are not counted, such queries find nothing. Ties: by ascending id, null ids last. Repeated rows, of
documents or queries: each by itself. Empty tables: no rows. Other columns are left out, whatever their names. Terms are
told apart by a hash of 64 bits together with their length and first eight bytes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codehealth.llm.shared import saved
from codehealth.llm.words import small_batches, text_bytes, word_hashes, words_of

K, BLOCK_BYTES, SALTS = 20, 4 << 20, 64
#: Postings of a piece, about; and places that are read from each list at first.
POSTINGS, FIRST_STEP = 1 << 20, 16

NO_TERM = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    NO_TERM[_a:_b] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, mark (first bytes and length) and row of each term."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    starts, ends, row = words_of(data, offsets, NO_TERM)
    sizes = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    first = np.lib.stride_tricks.sliding_window_view(padded, 8)[starts].copy().view("<u8").ravel() if len(starts) else np.zeros(0, np.uint64)
    return word_hashes(data, starts, ends), (first & _MASKS[np.minimum(sizes, 8)]) + sizes.astype(np.uint64), row


class Queries:
    """Terms of a block of queries, numbered, and how often each query holds which."""

    def __init__(self, ids: list, texts: list[str | None]):
        h, mark, row = terms_of(pa.array(texts, pa.string()))
        self.ids = ids
        self.hashes, first, number = np.unique(h, return_index=True, return_inverse=True)
        self.marks = mark[first]
        self.terms = [Counter(number[a:b].tolist()) for a, b in zip(*(np.searchsorted(row, np.arange(len(ids)), side) for side in ("left", "right")))]

    def numbers(self, h: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The number of each term, -1 for one that no query has."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where((self.hashes[at] == h) & (self.marks[at] == mark), at, -1)


def forward_index(docs: DataFrame, shared, id_type: str) -> DataFrame:
    """id, n (terms with repeats), terms, counts: of the query terms that the document holds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for batch in small_batches(batches):
            h, mark, row = terms_of(batch.column(1))
            n = np.bincount(row, minlength=batch.num_rows)
            number = queries.numbers(h, mark)
            own = number >= 0
            key, counts = np.unique(row[own] * len(queries.hashes) + number[own], return_counts=True)
            offsets = pa.array(np.searchsorted(key, np.arange(batch.num_rows + 1) * len(queries.hashes)), pa.int32())
            lists = (pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((key % len(queries.hashes), pa.int32()), (counts, pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["id", "n", "terms", "counts"])

    return docs.mapInArrow(work, f"id {id_type}, n long, terms array<int>, counts array<long>")


class Piece:
    """Impact lists of some documents, and their postings by document for direct access."""

    def __init__(self, ids: pa.Array, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int):
        m = 75 + (25 * n * n_docs) // n_terms
        self.ids, self.doc, self.term = ids, doc, term
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        self.rank = np.empty(len(ids), np.int64)
        self.rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        self.of_doc = np.searchsorted(doc, np.arange(len(ids) + 1))
        order = np.lexsort((-self.impact, term))  # postings as they stand in the lists
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.list_doc, self.list_impact, self.list_term = doc[order], self.impact[order], term[order]
        self.seen = np.zeros(len(order), bool)

    def search(self, terms: list[int], weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents that score `least` or more, and their scores. weights: of all terms, 0 if not in the query."""
        first, end = (np.searchsorted(self.list_term, terms, side) for side in ("left", "right"))
        some = (end > first) & (weights[terms] > 0)
        first, end, weight = first[some], end[some], weights[terms][some]
        for a, b in zip(first, end):
            self.seen[a:b] = False
        met = np.zeros(len(self.ids), bool)
        read, best, step = first.copy(), first.copy(), FIRST_STEP
        docs, scores = [], []
        while (read < end).any():
            new = np.unique(np.concatenate([self.list_doc[a : min(a + step, b)] for a, b in zip(read, end)]))
            read, step = np.minimum(read + step, end), step * 2
            new = new[~met[new]]
            if len(new):
                met[new] = True
                sizes = self.of_doc[new + 1] - self.of_doc[new]
                at = np.arange(sizes.sum()) + np.repeat(self.of_doc[new] - (np.cumsum(sizes) - sizes), sizes)
                own = weights[self.term[at]]
                self.seen[self.place[at[own > 0]]] = True
                docs.append(new)
                scores.append(np.add.reduceat(own * self.impact[at], np.cumsum(sizes) - sizes))
                kth = np.concatenate(scores)
                if len(kth) >= k:
                    kth = np.partition(kth, len(kth) - k)[-k:]
                    scores_so_far = max(least, int(kth[0]))
                else:
                    scores_so_far = least
            most = 0
            for j in range(len(first)):
                rest = self.seen[best[j] : end[j]]
                gap = int(rest.argmin()) if len(rest) else 0
                best[j] += len(rest) if len(rest) and rest[gap] else gap
                if best[j] < end[j]:
                    most += int(weight[j]) * int(self.list_impact[best[j]])
            if not most or most < scores_so_far:
                break
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        good = scores >= max(least, 1)
        docs, scores = docs[good], scores[good]
        top = np.lexsort((self.rank[docs], -scores))[:k]
        return docs[top], scores[top]


def pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            held.append(some)
            size += len(some.column(2).flatten())
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def searched(index: DataFrame, shared, counted, k: int, id_type: str, most: int = POSTINGS) -> DataFrame:
    """k rows a query at most from each task: query (its number), id, score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, (n_docs, n_terms, weight) = shared.value, counted.value
        weights, best = np.zeros(len(queries.hashes), np.int64), None
        least = [0] * len(queries.ids)
        for table in pieces(batches, most):
            lists, tf = table.column(2).combine_chunks(), table.column(3).combine_chunks().flatten().to_numpy()
            doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            piece = Piece(table.column(0).combine_chunks(), table.column(1).to_numpy(), doc, lists.flatten().to_numpy(), tf, n_docs, n_terms)
            found = []
            for q, terms in enumerate(queries.terms):
                own = list(terms)
                weights[own] = [terms[t] * weight[t] for t in own]
                docs, scores = piece.search(own, weights, k, least[q])
                weights[own] = 0
                found.append((np.full(len(docs), q), docs, scores))
            q, docs, scores = map(np.concatenate, zip(*found))
            new = pa.table({"query": pa.array(q, pa.int32()), "id": piece.ids.take(pa.array(docs)), "score": pa.array(scores, pa.int64())})
            best = new if best is None else pa.concat_tables([best, new])
            best = best.take(pc.sort_indices(best, sort_keys=[("query", "ascending"), ("score", "descending"), ("id", "ascending")]))
            q = best.column(0).to_numpy()
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = np.flatnonzero(place == k - 1)
            for i, score in zip(q[last].tolist(), best.column(2).take(pa.array(last)).to_pylist()):
                least[i] = score
            best = best.filter(pa.array(place < k)).combine_chunks()
        if best is not None:
            yield from best.to_batches()

    return index.mapInArrow(work, f"query int, id {id_type}, score long")


def first_k(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of queries its k best documents with a score above 0: item_id, rank, doc_id, score."""
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    asked = queries.select(queries[query_id].alias("id"), queries[query_text].cast("string").alias("text")).filter("text is not null")
    blocks = -(-int(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    schema = f"item_id {queries.schema[query_id].dataType.simpleString()}, rank int, doc_id {id_type}, score long"
    out = None
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()
        one = Queries([r["id"] for r in own], [r["text"] for r in own])
        if not len(one.hashes):
            continue
        shared = spark.sparkContext.broadcast(one)
        index = saved(forward_index(rows, shared, id_type), "forward_index")
        n_docs, n_terms = index.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_terms:
            continue
        df = dict(index.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # bounded by the block of queries
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(one.hashes))}
        counted = spark.sparkContext.broadcast((n_docs, n_terms, weight))
        found = searched(index, shared, counted, k, id_type)
        found = first_k(found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))), k, "query", "salt").drop("rank", "salt")
        names = spark.createDataFrame([(q, i) for q, i in enumerate(one.ids)], f"query int, item_id {queries.schema[query_id].dataType.simpleString()}")
        found = first_k(found, k, "query").join(names, "query").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
        found = saved(found, "found") if block + 1 < blocks else found
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out
