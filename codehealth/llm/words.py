"""Words of Arrow text columns and hashes of runs of words, in numpy.

A word is a longest run of bytes other than space, \\t, \\n, \\v, \\f, \\r; on UTF-8 that is
`[^\\x20\\x09-\\x0D]+`. Hashes have 64 bits and depend on the bytes alone, never on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD = r"[^\x20\x09-\x0D]+"

_A, _B, _K = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each bit over all 64 (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


_DEPTH = 64
_TABLE = mix(np.arange(_DEPTH * 256, dtype=np.uint64) * _K + _B)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the offset of each row, with one more at the end."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def small_batches(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, one row at least: working arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(text_bytes(batch.column(text))[1])
        group = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def words_of(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the row that it is in. between: whether each byte value stands between words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~between[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: the sum of a random number for each (place in the word, byte), mixed with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    place = np.arange(at[-1] + lengths[-1]) - np.repeat(at, lengths)
    key = data[place + np.repeat(starts, lengths)] + (place << 8)
    if lengths.max() <= _DEPTH:
        value = _TABLE[key]
    else:
        value = mix(key.astype(np.uint64) * _K + _B)
    return mix(np.add.reduceat(value, at) + lengths.astype(np.uint64) * _K)


def window_hashes(h: np.ndarray, w: int) -> np.ndarray:
    """A hash of each w successive values; none if there are fewer. Windows may cross rows: see in_one_row."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, size, left = None, 0, 1, w
    while True:
        if left & 1:
            part = h[at : at + n]
            out = mix(part + _B) if out is None else mix(out * _K + part)
            at += size
        left >>= 1
        if not left:
            return out
        h = mix(h[:-size] * _A + h[size:] + _K)
        size *= 2


def in_one_row(row: np.ndarray, w: int) -> np.ndarray:
    """Whether each window of w successive words lies in one row."""
    return row[: len(row) - w + 1] == row[w - 1 :] if len(row) >= w else np.zeros(0, bool)
