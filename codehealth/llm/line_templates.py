"""Line dedup with a log-template tree.

A line goes down a tree of fixed depth: first its number of tokens, then its first DEPTH tokens, where a token with a
digit is a variable field and counts as `<*>`. At the leaf it belongs to the template of its other tokens, masked alike,
and to templates in which one of PARTS stretches of those tokens is variable as a whole (if the line is long enough for
the constant rest to mean something). A template that stands in `min_docs` documents or more is recurring; its lines
are dropped everywhere but in the document with the smallest id, so that no content goes altogether.

With `exact_docs`, a line whose tokens recur word for word, nothing masked, is recurring from that many documents on. A
line without digits is its own whole template, so only lines with digits have an entry more. The lowest bit of a template
tells the two kinds apart.

Nodes are hashes of the path down to them, so the tree is a table of (template, documents, first document): a task counts
each template once per document, Spark sums up by template in partial sums, and no leaf is ever gathered. A hot
template meets in a join that Spark can split.

A line's tokens are `[^\\x20\\x09-\\x0D]+`. Lines of fewer than `min_tokens` tokens stay. Null text stays null, an empty text
empty. Rows with the same id and text are one document; rows with the same id and other texts are several. Null ids
are smaller than all ids. Empty table: no rows. The result has the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.llm.shared import unused
from codehealth.llm.words import mix, small_batches, text_bytes, word_hashes, words_of

DEPTH, PARTS, MIN_TOKENS, LONG_LINE, MIN_DOCS = 3, 4, 3, 11, 10
#: Documents from which on a line that recurs word for word goes.
EXACT_DOCS = 2

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WILD = np.uint64(0xD1B54A32D192ED03)
_STEP = np.uint64(0x9E3779B97F4A7C15)

TEMPLATES = "id long, tie long, line int, template long"


def run_hash(h: np.ndarray, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of tokens start..end-1 of each line: sums of tokens mixed with their place in the line, which `sums` adds up."""
    return mix(sums[end] - sums[start])


def line_templates(data: np.ndarray, offsets: np.ndarray, depth: int, parts: int, min_tokens: int, long_line: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, number of the line in the row, and template; one line has one or 1 + parts of them, and one more if `exact` and
    it has digits. With `exact`, templates of word for word lines are odd and all others even."""
    starts, ends, _ = words_of(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # lines of all rows: a row's first line starts where the row does
    breaks = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([breaks + 1, offsets[:-1]]))
    row_of = np.searchsorted(offsets, begins, "right") - 1
    first_line = np.searchsorted(begins, offsets[:-1])
    number = np.arange(len(begins)) - first_line[np.minimum(row_of, len(first_line) - 1)]
    line = np.searchsorted(begins, starts, "right") - 1
    n_tokens = np.bincount(line, minlength=len(begins))
    first = np.cumsum(n_tokens) - n_tokens

    digits = np.r_[0, np.cumsum(_DIGIT[data])]
    h = word_hashes(data, starts, ends)
    words = h.copy() if exact else h
    h[digits[ends] > digits[starts]] = _WILD
    place = (np.arange(len(h)) - first[line]).astype(np.uint64)
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(h + place * _STEP))]

    good = np.flatnonzero(n_tokens >= min_tokens)
    a, n = first[good], n_tokens[good]
    node = mix(run_hash(h, sums, a, a + np.minimum(n, depth)) + n.astype(np.uint64) * _STEP)  # token count, then leading tokens
    whole = mix(node * _STEP + run_hash(h, sums, a + np.minimum(n, depth), a + n))
    even, odd = ~np.uint64(1) if exact else ~np.uint64(0), np.uint64(1)
    rows, lines, found = [row_of[good]], [number[good]], [whole & even]
    if exact:
        masked = np.r_[0, np.cumsum(digits[ends] > digits[starts])]
        varies = masked[a + n] > masked[a]
        found[0] = np.where(varies, found[0], whole | odd)
        raw = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(words + place * _STEP))]
        x, y = a[varies], n[varies]
        rows.append(row_of[good][varies])
        lines.append(number[good][varies])
        found.append(mix(run_hash(words, raw, x, x + y) + y.astype(np.uint64) * _STEP) | odd)
    long_ = n >= long_line
    a, n, node = a[long_], n[long_], node[long_]
    rest = n - depth
    for k in range(parts):
        x, y = a + depth + rest * k // parts, a + depth + rest * (k + 1) // parts
        constant = sums[x] - sums[a + depth] + (sums[a + n] - sums[y])
        found.append(mix(node * _STEP + mix(constant + np.uint64(k + 1)) + _WILD) & even)
        rows.append(row_of[good][long_])
        lines.append(number[good][long_])
    return np.concatenate(rows), np.concatenate(lines), np.concatenate(found)


def split(depth: int, parts: int, min_tokens: int, long_line: int, exact: bool) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            data, offsets = text_bytes(batch.column(0))
            row, line, template = line_templates(data, offsets, depth, parts, min_tokens, long_line, exact)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(at), batch.column(2).take(at), pa.array(line.astype(np.int32)), pa.array(template.view(np.int64))], names=["id", "tie", "line", "template"]
            )

    return work


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple:
    """id (null as the least) and tie (hash of the text) of a row."""
    text = docs[text_col].cast("string")
    return F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63)).cast("long")), F.xxhash64(F.coalesce(text, F.lit("")))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, depth: int = DEPTH, parts: int = PARTS, min_tokens: int = MIN_TOKENS, long_line: int = LONG_LINE, exact_docs: int | None = None) -> DataFrame:
    """id, tie, lines (numbers from 0) of every document that loses lines."""
    id_, tie = keyed(docs, id_col, text_col)
    exact = exact_docs is not None
    least = F.when(F.col("template").bitwiseAND(1) == 1, exact_docs).otherwise(min_docs) if exact else min_docs
    rows = docs.select(docs[text_col].cast("string").alias("text"), id_.alias("id"), tie.alias("tie"))
    lines = rows.mapInArrow(split(depth, parts, min_tokens, long_line, exact), TEMPLATES)
    once = rows.mapInArrow(once_each(depth, parts, min_tokens, long_line, exact), "id long, tie long, template long")
    first = F.min(F.struct("id", "tie"))
    tree = once.groupBy("template").agg(F.count("*").alias("n"), first.alias("first")).filter(F.col("n") >= least)
    tree = tree.select("template", F.col("first.id").alias("first_id"), F.col("first.tie").alias("first_tie"))
    gone = lines.join(tree, "template").filter("id <> first_id or tie <> first_tie")
    return gone.groupBy("id", "tie").agg(F.collect_set("line").alias("lines"))


def once_each(depth: int, parts: int, min_tokens: int, long_line: int, exact: bool) -> Callable:
    """Each template once per document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            data, offsets = text_bytes(batch.column(0))
            row, _, template = line_templates(data, offsets, depth, parts, min_tokens, long_line, exact)
            order = np.lexsort((template, row))
            row, template = row[order], template[order]
            new = np.r_[True, (row[1:] != row[:-1]) | (template[1:] != template[:-1])][: len(row)]
            at = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(2).take(at), pa.array(template[new].view(np.int64))], names=["id", "tie", "template"])

    return work


def without_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True, **options) -> DataFrame:
    """docs with the lines of recurring templates taken out of their texts (all columns); with `counts`, n_lines before and
    n_dropped in place of columns so called."""
    id_, tie = keyed(docs, id_col, text_col)
    key, text_key, lines = unused(docs, "line_key"), unused(docs, "line_text_key"), unused(docs, "lines_gone")
    gone = dropped_lines(docs, id_col, text_col, **options).select(F.col("id").alias(key), F.col("tie").alias(text_key), F.col("lines").alias(lines))
    joined = docs.select("*", id_.alias(key), tie.alias(text_key)).join(gone, [key, text_key], "left")
    # the text is split once: it is the only element of an array that transform goes over
    numbers = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(lines))
    kept = F.transform(F.array(F.split(docs[text_col].cast("string"), "\n", -1)), lambda x: F.array_join(F.transform(numbers(x), lambda i: F.get(x, i)), "\n"))[0]
    text = F.when(F.col(lines).isNull(), docs[text_col]).otherwise(kept)
    out = [text.alias(c) if c == text_col else docs[c] for c in docs.columns if not (counts and c in ("n_lines", "n_dropped"))]
    if not counts:
        return joined.select(*out)
    n_lines = F.coalesce(F.size(F.split(docs[text_col].cast("string"), "\n", -1)), F.lit(0)).cast("long").alias("n_lines")
    return joined.select(*out, n_lines, F.when(F.col(lines).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_dropped"))
