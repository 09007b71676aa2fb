"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training is one pass over all labelled rows: each task counts its n-grams by (label, bucket) in numpy, Spark
sums the counts, and the matrix of log-probabilities (labels x buckets, a size that the corpus does not change)
is broadcast. Prediction reads whole texts in batches and adds up the matrix cells of their n-grams.

Null text or a text without letters: `und` with score 0. Empty training set: every text is `und`. Null labels
are not learned. Repeated rows: each counts and each gets its row. Ties go to the label that sorts first.
Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehealth.llm.shared import unused
from codehealth.llm.words import mix, small_batches

ORDERS = (2, 3)
#: Characters of a part that the next one begins with.
OVERLAP = max(ORDERS) - 1
BITS = 14
#: n-grams after which more text makes a prediction no surer: neighbouring n-grams are not independent.
SURE_AFTER = 64
UNKNOWN = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: list[str], bits: int, cuts: list[tuple[bool, bool]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, bucket) of all n-grams, for each order. Other characters than letters are one space. cuts: whether a text
    goes on one before (then it begins with the last OVERLAP characters of that), and whether another goes on it."""
    rows = ["\n" + x.lower() + "\n" for x in texts]
    code = np.frombuffer("".join(rows).encode("utf-32-le", "replace"), np.uint32)
    letter = ((code >= 97) & (code <= 122)) | (code >= 0xC0)
    code = np.where(letter, code, 32).astype(np.uint64)
    sizes = np.array([len(x) for x in rows], np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    counted = np.ones(len(code), bool)  # by where an n-gram ends
    for end, size, (left, right) in zip(np.cumsum(sizes).tolist(), sizes.tolist(), cuts or ()):
        if left:
            counted[end - size : end - size + 1 + OVERLAP] = False
        if right:
            counted[end - 1] = False
    for n in ORDERS:
        if len(code) < n:
            continue
        m = len(code) - n + 1
        key = np.full(m, n, np.uint64)
        for i in range(n):
            key = key * _STEP + code[i : m + i]
        # within one word, with the space before or after it; so none spans two texts
        good = (letter[: m] | letter[n - 1 :]) & counted[n - 1 :]
        for i in range(1, n - 1):
            good &= letter[i : m + i]
        yield row[:m][good], (mix(key[good]) >> np.uint64(64 - bits)).astype(np.int64)


def in_parts(texts: list[str], most: int = 1 << 19) -> Iterator[tuple[list[int], list[str], list[tuple[bool, bool]]]]:
    """Texts in parts of about `most` characters, with the index of each and where it is cut. A longer text is cut anywhere, with
    an overlap, so that each n-gram is counted once and working arrays stay small, whatever the text."""
    which, part, cuts, size = [], [], [], 0
    for i, x in enumerate(texts):
        at = 0
        if len(x) > most:
            x = x.lower()  # as a whole, since some letters look at their neighbours
        while at < len(x) or not at:
            end = min(at + most, len(x))
            which.append(i)
            part.append(x[max(at - OVERLAP, 0) : end])
            cuts.append((at > 0, end < len(x)))
            size, at = size + end - at, max(end, 1)
            if size >= most:
                yield which, part, cuts
                which, part, cuts, size = [], [], [], 0
    if part:
        yield which, part, cuts


def gram_counts(docs: DataFrame, label: str, text: str, bits: int = BITS) -> DataFrame:
    """(label, bucket, n) over all rows with a label; bucket -1 counts the rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            labels, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for name in labels:
                if name not in found:
                    found[name] = np.zeros((1 << bits) + 1, np.int64)
                found[name][0] += 1
            for which, part, cuts in in_parts(texts):
                names, of = np.unique(np.array([labels[i] for i in which], object).astype(str), return_inverse=True)
                counts = np.zeros(len(names) << bits, np.int64)
                for row, bucket in grams(part, bits, cuts):
                    counts += np.bincount((of[row] << bits) + bucket, minlength=len(counts))
                for name, own in zip(names.tolist(), counts.reshape(len(names), -1)):
                    found[name][1:] += own
        for name, own in found.items():
            full = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full)), pa.array(full - 1), pa.array(own[full])], names=["label", "bucket", "n"])

    rows = docs.select(docs[label].cast("string").alias("label"), docs[text].cast("string").alias("text")).filter("label is not null")
    return rows.mapInArrow(work, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame, bits: int = BITS, smoothing: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels in order, log prior of each, and log-probabilities (labels x buckets): bounded by the number of labels."""
    table = counts.toPandas()
    names = sorted(table["label"].unique())
    n = np.zeros((len(names), (1 << bits) + 1))
    n[table["label"].map({x: i for i, x in enumerate(names)}).to_numpy(int), table["bucket"].to_numpy(int) + 1] = table["n"]
    cells = n[:, 1:] + smoothing
    prior = np.log((n[:, 0] + smoothing) / (n[:, 0] + smoothing).sum()) if names else np.zeros(0)
    return names, prior, np.log(cells / cells.sum(axis=1, keepdims=True))


def scored(texts: list[str | None], names: list[str], prior: np.ndarray, logs: np.ndarray) -> tuple[list[str], list[float]]:
    """Best label of each text and its probability."""
    bits = int(logs.shape[1]).bit_length() - 1
    total, n = np.zeros((len(names), len(texts))), np.zeros(len(texts))
    for which, part, cuts in in_parts([x or "" for x in texts]):
        of = np.array(which)
        for row, bucket in grams(part, bits, cuts):
            n += np.bincount(of[row], minlength=len(texts))
            for k in range(len(names)):
                total[k] += np.bincount(of[row], weights=logs[k][bucket], minlength=len(texts))
    total = total * np.minimum(1, SURE_AFTER / np.maximum(n, 1)) + prior[:, None]
    labels, scores = [], []
    for i, text in enumerate(texts):
        if not names or not any(map(str.isalpha, text or "")):
            labels.append(UNKNOWN)
            scores.append(0.0)
            continue
        p = np.exp(total[:, i] - total[:, i].max())
        labels.append(names[int(p.argmax())])
        scores.append(float(p.max() / p.sum()))
    return labels, scores


def predict(docs: DataFrame, model: tuple, text: str = "text", keep: dict[str, Column] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of `keep` (name: column; else all of docs) with the predicted language and its score, called `names`."""
    columns = [c.alias(name) for name, c in keep.items()] if keep is not None else [docs[c] for c in docs.columns]
    whole = unused(docs, "whole_text")
    rows = docs.select(*columns, docs[text].cast("string").alias(whole))
    kept = rows.drop(whole).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{names[0]} string", f"{names[1]} double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, whole, 8 << 20):
            labels, scores = scored(batch.column(batch.num_columns - 1).to_pylist(), *shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], *names]
            )

    return rows.mapInArrow(work, schema)


def held_out(doc_id: Column) -> Column:
    """The fifth of the ids that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the rows that are not held out."""
    out = held_out(docs[id_col])
    model = fit(gram_counts(docs.filter(~out), lang_col, text_col))
    return predict(docs, model, text_col, {"doc_id": docs[id_col], "held_out": out})


def in_known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = 0.5) -> DataFrame:
    """The documents (all columns) that have letters and a language that the model is sure of."""
    model = fit(gram_counts(docs.filter(~held_out(docs[id_col])), lang_col, text_col))
    names = unused(docs, "lang_pred"), unused(docs, "score")
    found = predict(docs, model, text_col, names=names)
    return found.filter((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least_score)).drop(*names)
