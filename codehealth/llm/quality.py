"""Quality rules: word and line rules, then compression bands.

`quality_report(docs)` adds to every document the base measures and the zstandard ratios (compressed
bytes by bytes) of the whole text and of its fixed chunks. A text that compresses too well repeats itself;
one that hardly compresses is noise. What is too much depends on the length: short texts compress less,
so each band of lengths has limits of its own, and the least and greatest chunk ratio have wider limits
than the whole text. Random base64 comes to 0.74 and more at any length, prose to 0.7 at 500 bytes and to 0.5 from 2,000
on: the upper limits lie between the two. The last chunk ends where the text does, so no byte is left out.

Null text: as the empty text. Empty text: all counts 0, ratios null, base_failed. Repeated rows: each gets
its row. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from codehealth.llm.words import in_one_row, small_batches, text_bytes, window_hashes, word_hashes, words_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

#: Bytes up to which a band holds, then least and greatest ratio of the whole text.
BANDS = (
    (120, 0.0, 2.0),
    (500, 0.20, 0.95),
    (2_000, 0.12, 0.74),
    (10_000, 0.08, 0.64),
    (100_000, 0.05, 0.60),
    (float("inf"), 0.02, 0.60),
)
CHUNK = 4096
#: Least and greatest ratio of a full chunk.
CHUNK_BAND = (0.06, 0.65)

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, least_chunk_ratio double, greatest_chunk_ratio double, verdict string"
)


def word_counts(column: pa.Array, size: int = 3) -> tuple[list[int], list[int]]:
    """Words of each text, and words in windows of `size` words that stand in the text twice or more."""
    data, offsets = text_bytes(column)
    starts, ends, row = words_of(data, offsets)
    at = np.flatnonzero(in_one_row(row, size))
    h = window_hashes(word_hashes(data, starts, ends), size)[at]
    order = np.lexsort((h, row[at]))
    a, b = order[:-1], order[1:]
    twice = np.zeros(len(at), bool)
    equal = (h[a] == h[b]) & (row[at[a]] == row[at[b]])
    twice[a[equal]] = twice[b[equal]] = True
    inside = np.zeros(len(row), bool)
    for k in range(size):
        inside[at[twice] + k] = True
    return tuple(np.bincount(x, minlength=len(column)).tolist() for x in (row, row[inside]))


def ratios(data: bytes, chunk: int, packer: zstandard.ZstdCompressor) -> tuple[float | None, float | None, float | None]:
    """Ratio of the whole, least and greatest of the full chunks (null if there is none); the last one may overlap another."""
    if not data:
        return None, None, None
    starts = [*range(0, len(data) - chunk + 1, chunk)]
    if starts and len(data) % chunk:
        starts.append(len(data) - chunk)
    each = [len(packer.compress(data[i : i + chunk])) / chunk for i in starts]
    return len(packer.compress(data)) / len(data), min(each, default=None), max(each, default=None)


def band_verdict(n_bytes: int, whole: float | None, least: float | None, greatest: float | None, bands=BANDS, chunk_band=CHUNK_BAND) -> str:
    """'ok', or which limit the text breaks."""
    if whole is None:
        return "ok"
    low, high = next((a, b) for most, a, b in bands if n_bytes <= most)
    if whole < low:
        return "repetitive"
    if whole > high:
        return "incompressible"
    if least is not None and least < chunk_band[0]:
        return "repetitive chunk"
    if greatest is not None and greatest > chunk_band[1]:
        return "incompressible chunk"
    return "ok"


def measured(text: str | None, n_words: int, n_repeat: int, packer: zstandard.ZstdCompressor, min_words: int, max_repeat_percent: int, bands, chunk: int, chunk_band) -> tuple:
    text = text or ""
    data = text.encode("utf-8", "replace")
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    failed = n_words < min_words or 100 * n_repeat > max_repeat_percent * n_words
    found = ratios(data, chunk, packer)
    verdict = band_verdict(len(data), *found, bands, chunk_band)
    return (
        n_words,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        n_repeat,
        failed,
        not failed and verdict == "ok",
        *found,
        verdict,
    )


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50, bands=BANDS, chunk: int = CHUNK, chunk_band=CHUNK_BAND, level: int = 3) -> DataFrame:
    """One row per document: base measures, ratios, verdict and kept. No shuffle; memory is a batch of texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level)
        for batch in small_batches(batches):
            rows = zip(batch.column(1).to_pylist(), *word_counts(batch.column(1)))
            columns = list(zip(*(measured(*x, packer, min_words, max_repeat_percent, bands, chunk, chunk_band) for x in rows)))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(work, SCHEMA)

