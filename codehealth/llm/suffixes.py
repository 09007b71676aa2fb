"""Suffix-array dedup: every byte of a `length`-byte string that also starts earlier is removed.

Which suffixes are indexed. Each window of `length` bytes chooses one suffix in it, by the least hash of the suffix's
first STEM bytes, so the choice depends on the window's bytes alone: equal windows choose the same suffix. The windows
that choose one suffix form its entry: a `name` (hash of the stem), an `ext` (hash of all bytes of its windows), a
place and a number of windows. About one byte in 35 has an entry, and no equal windows are missed.

Index family. Entries are dealt out by name into shards. In a shard, each batch of entries is sorted by (name, ext),
the order of a suffix array whose characters are hashes (naming substrings by hashes as in doubling constructions;
sorting by the bytes themselves would move each text about four times over). The sorted batch is merge-scanned against
every level: equal (name, ext) means that all windows of the later entry start earlier, too; equal names with other
exts may share some windows. Then the batch becomes a level, and levels of like size merge, so n batches leave about
log n levels. With `index`, the levels of all shards are kept as a table: a later run takes them up again, scans the new
documents against them, and keeps what has become of them. Ids of later batches lie above those of earlier ones (else an
error, as is a null id). Earlier documents are read again where an entry has to be settled, see below, and not changed.

Entries that share a name but not an ext are settled window by window: the windows' hashes are sorted in shards in
the same way, and the least place is the original. Windows are told apart there by two hashes of 64 bits,
of the second of which half crosses the shuffle. A window holds half of the `length` - `stem` other bytes on one side of its
stem, the left if it starts that far before it, else the right. So an entry also carries a short hash of either side, and only
the windows of a side that another entry of its name agrees in are settled: stems that recur in unlike texts cost nothing.

How the data move: see `blocks`. Entries that repeat within a piece of text go as one entry, and their windows as merged
spans; texts without any match are not shuffled.

Null text: empty. Texts shorter than `length` stay. Order of documents: id (null first), then a hash of the text; rows
equal in both are one document in two copies and do not repeat each other. Empty table: no rows. Other columns are left
out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codehealth.llm.blocks import bitmap, by_group, dealt, group_count, ids_in, joined, marked, ordered, rows_of, text_size
from codehealth.llm.shared import exists, pieces_for, saved
from codehealth.llm.words import mix, small_batches, text_bytes

LENGTH, STEM = 100, 24
PIECE_BYTES, GROUP_BYTES = 8 << 20, 8 << 20

_A, _ONE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(1)
_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED270B))
_OTHER = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x2545F4914F6CDD1D))
_LOW = np.uint64(0xFFFFFFFF)

#: An entry's place: TIE_BITS of a hash of the text, the byte where its first window starts (a text has less than 2^31), its number of windows.
ENTRIES = "shard int, names binary, exts binary, ids binary, places binary, span_ids binary, span_ties binary, span_from binary, span_to binary"
#: Verdicts: windows start, number of windows, and whether they are to be settled one by one (else all are repeats).
VERDICTS = "grp int, ids binary, ties binary, starts binary, counts binary, open binary"
#: Windows to settle: two hashes of each.
OPEN = "shard int, grp int, hashes binary, seconds binary, ids binary, positions binary"
#: An entry as it is sent: also how far before the stem its first window starts, and the hashes of both sides (16 bits each, 0: none).
SENT = ENTRIES + ", befores binary, sides binary"
#: A level of a shard's family.
LEVELS = "shard int, level int, names binary, exts binary, level_ids binary, places binary, mixed binary, near binary"


TIE_BITS = 25
#: Entries that a shard's new pieces have together, at least, before they meet its levels.
BATCH = 1 << 14


class Hashes:
    """Hashes of substrings of fixed lengths of one byte array, each made from those of half the length. Other values of bytes give
    other hashes."""

    def __init__(self, data: np.ndarray, values: np.ndarray = _BYTE):
        self.of = {1: values[data]}

    def power(self, size: int) -> np.ndarray:
        if size not in self.of:
            half = self.power(size // 2)
            x = half[: -(size // 2)] * _A + half[size // 2 :] + _ONE
            self.of[size] = (x ^ (x >> np.uint64(32))) * _A
        return self.of[size]

    def at(self, start: np.ndarray, length: int, top: int = 32) -> np.ndarray:
        """Hashes of `length` bytes from each start, from parts of at most `top` bytes."""
        out, done = np.zeros(len(start), np.uint64), 0
        while done < length:
            size = min(top, 1 << (length - done).bit_length() - 1)
            out = mix(out * _A + self.power(size)[start + done])
            done += size
        return out


def least_in(key: np.ndarray, w: int) -> np.ndarray:
    """The least of each w successive keys."""
    n, size = len(key) - w + 1, 1
    while size * 2 <= w:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    return np.minimum(key[:n], key[w - size : w - size + n])


def entries(data: np.ndarray, offsets: np.ndarray, length: int, stem: int) -> tuple[np.ndarray, ...]:
    """row, first window's start in its row, number of windows, name, ext and near (see nearby) of each entry."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    hashes = Hashes(data)
    a, b = hashes.power(16), hashes.power(8)
    m = len(data) - stem + 1
    stems = mix(a[:m] * _A + b[16 : 16 + m]) if stem == 24 else hashes.at(np.arange(m), stem)
    chosen = least_in((stems & ~_LOW) | np.arange(m, dtype=np.uint64), length - stem + 1)
    chosen = (chosen & _LOW).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    good = row[:n] == row[length - 1 :]
    new = good.copy()
    new[1:] &= (chosen[1:] != chosen[:-1]) | ~good[:-1] | (row[1:n] != row[: n - 1])
    start = np.flatnonzero(new)
    count = np.add.reduceat(good.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    anchor = chosen[start]
    ext = hashes.at(start, length) * _A + hashes.at(start + count - 1, length)
    ext = mix(ext + ((anchor - start) * 1024 + count).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    half = (length - stem) // 2
    n_left, sides = left_windows(anchor - start, count, half), []
    for own, at in ((n_left > 0, anchor - half), (n_left < count, anchor + stem)):
        side = np.zeros(len(start), np.uint64)
        side[own] = hashes.at(at[own], half) % np.uint64(0xFFFF) + _ONE
        sides.append(side)
    return row[start], start - offsets[row[start]], count, stems[anchor], ext, nearby(anchor - start, (sides[0] << np.uint64(16)) | sides[1])


def left_windows(before: np.ndarray, count: np.ndarray, half: int) -> np.ndarray:
    """How many of an entry's windows, the first ones, start `half` bytes or more before its stem; the others hold as many after it."""
    return np.clip(before - half + 1, 0, count)


def nearby(befores: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """One number of how far an entry's first window starts before the stem, and the hashes of both sides."""
    return (befores.astype(np.uint64) << np.uint64(32)) | sides.astype(np.uint64)


def to_settle(names: np.ndarray, places: np.ndarray, near: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries that share names: which ones have windows that another one may hold, too, and the first of these (counted from the
    entry's first) and their number. An entry without sides may share all its windows."""
    count = unplaced(places)[2]
    n_left = left_windows((near >> np.uint64(32)).astype(np.int64), count, half)
    unknown = (near & _LOW) == 0
    lost = np.isin(names, names[unknown])
    sides = []
    for shift in (16, 0):
        side = (near >> np.uint64(shift)) & np.uint64(0xFFFF)
        key = (names.astype(np.uint64) << np.uint64(16)) | side
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        sides.append(lost | ((side > 0) & (times[which] > 1)))
    first, end = np.where(sides[0], 0, n_left), np.where(sides[1], count, n_left)
    own = np.flatnonzero(end > first)
    return own, first[own], (end - first)[own]


def runs(new: np.ndarray) -> np.ndarray:
    """Index of the run of each element; `new` says where a run begins."""
    return np.cumsum(new) - 1


def settle(names, exts, ids, places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (name, ext, id, place); in it, which entries are the first of their (name, ext), and which have a name
    that stands with several exts."""
    order = np.lexsort((places, ids, exts, names))
    n, e, i, p = names[order], exts[order], ids[order], places[order]
    new_name = np.r_[True, n[1:] != n[:-1]][: len(n)]
    first = new_name | np.r_[True, e[1:] != e[:-1]][: len(n)]
    # copies of one row have equal places: each of them is the first
    run = runs(first)
    start = np.flatnonzero(first)
    first |= (i == i[start][run]) & (p == p[start][run])
    groups = runs(new_name)
    several = np.bincount(groups, weights=new_name | np.r_[True, e[1:] != e[:-1]][: len(n)]) > 1
    return order, first, several[groups]


class Family:
    """Levels of sorted entries of one shard. add() takes a batch and yields the entries that turn out to be repeats."""

    def __init__(self, levels: list[list[np.ndarray]] | None = None):
        self.levels = levels or []  # each: names, exts, ids, places, mixed, near

    def add(self, names, exts, ids, places, near=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        near = np.zeros(len(names), np.uint64) if near is None else near
        order, first, mixed = settle(names, exts, ids, places)
        lost = order[~first]
        yield ids[lost], places[lost]
        kept = order[first]
        batch = [names[kept], exts[kept], ids[kept], places[kept], mixed[first], near[kept]]
        for k, level in enumerate(self.levels):
            low, high = np.searchsorted(level[0], batch[0], "left"), np.searchsorted(level[0], batch[0], "right")
            own = np.flatnonzero(high > low)
            if not len(own):
                continue
            edges = np.zeros(len(level[0]) + 1, np.int64)
            np.add.at(edges, low[own], 1)
            np.add.at(edges, high[own], -1)
            theirs = np.flatnonzero(np.cumsum(edges)[:-1])
            both = [np.concatenate([x[theirs], y[own]]) for x, y in zip(level, batch)]
            order, first, mixed = settle(*both[:4])
            lost = order[~first]
            yield both[2][lost], both[3][lost]
            keep, is_mixed = np.empty(len(order), bool), np.empty(len(order), bool)
            keep[order], is_mixed[order] = first, mixed
            for part, at, a in ((level, theirs, slice(0, len(theirs))), (batch, own, slice(len(theirs), None))):
                part[4][at] |= is_mixed[a]
                stay = np.ones(len(part[0]), bool)
                stay[at] = keep[a]
                part[:] = [x[stay] for x in part]
        self.levels.append(batch)
        self.levels.sort(key=lambda x: -len(x[0]))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            merged = [np.concatenate(x) for x in zip(self.levels.pop(), self.levels.pop())]
            order = np.lexsort((merged[1], merged[0]))
            self.levels.append([x[order] for x in merged])
            self.levels.sort(key=lambda x: -len(x[0]))


def short(ties: np.ndarray) -> np.ndarray:
    """The upper bits of ties, in the same order."""
    return (ties.astype(np.int64) >> (64 - TIE_BITS)) + (1 << TIE_BITS - 1)


def placed(ties: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return (short(ties).astype(np.uint64) << np.uint64(64 - TIE_BITS)) | (starts.astype(np.uint64) << np.uint64(8)) | counts.astype(np.uint64)


def unplaced(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of the tie, start, number of windows."""
    return (places >> np.uint64(64 - TIE_BITS)).astype(np.int64), ((places >> np.uint64(8)) & np.uint64((1 << 56 - TIE_BITS) - 1)).astype(np.int64), (places & np.uint64(0xFF)).astype(np.int64)


def shard_of(names: np.ndarray, shards: int) -> np.ndarray:
    """By the bits of a name that a level keeps, so that levels can be dealt out anew."""
    return (names.astype(np.uint64) % np.uint64(shards)).astype(np.int64)


def index_of(length: int, stem: int, shards: int, piece_bytes: int) -> Callable:
    """Per piece and shard: the first entry of each (name, ext); the windows of the others, merged, are spans."""

    def sent(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, ties, starts, counts, names, exts, near = (np.concatenate(x) for x in zip(*parts))
        if not len(ids):
            return
        places = placed(ties, starts, counts)
        order, first, _ = settle(names, exts, ids, places)
        lost = np.sort(order[~first])
        # neighbours in the text: spans that touch or overlap
        a, b = starts[lost], starts[lost] + counts[lost] - 1 + length
        new = np.r_[True, (ids[lost][1:] != ids[lost][:-1]) | (ties[lost][1:] != ties[lost][:-1]) | (a[1:] < a[:-1]) | (a[1:] > b[:-1])][: len(lost)]
        begin = np.flatnonzero(new)
        span = [ids[lost][begin], ties[lost][begin], a[begin], np.maximum.reduceat(b, begin) if len(begin) else b]
        kept, none = order[first], np.zeros(0, np.int64)
        entries_of = dict(dealt(shard_of(names[kept] >> np.uint64(32), shards)))
        spans_of = dict(dealt(np.arange(len(span[0])) % shards))
        rows = []
        for s in entries_of | spans_of:
            k, own = kept[entries_of.get(s, none)], spans_of.get(s, none)
            rows.append((s, (names[k] >> np.uint64(32)).astype(np.uint32).tobytes(), exts[k].tobytes(), ids[k].tobytes(), places[k].tobytes(), *(x[own].astype(np.int64).tobytes() for x in span), (near[k] >> np.uint64(32)).astype(np.uint8).tobytes(), near[k].astype(np.uint32).tobytes()))
        kinds = [pa.int32()] + [pa.binary()] * 10
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in SENT.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in small_batches(batches):
            data, offsets = text_bytes(batch.column(0))
            row, start, count, name, ext, near = entries(data, offsets, length, stem)
            ids, ties = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            parts.append((ids[row], ties[row], start, count, name, ext, near))
            size += len(data)
            if size >= piece_bytes:
                yield from sent(parts)
                parts, size = [], 0
        if parts:
            yield from sent(parts)

    return work


def packed(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), kind) for x in column]


PARTS = (np.uint32, np.uint64, np.int64, np.uint64, bool, np.uint64)


def level_of(row: dict) -> list[np.ndarray]:
    """A level's columns; one of an index that was made without sides has none."""
    near = row["near"] if row["near"] is not None else bytes(2 * len(row["names"]))
    return [np.frombuffer(x, kind).copy() for x, kind in zip((*(row[n] for n in ("names", "exts", "level_ids", "places", "mixed")), near), PARTS)]


def matches(groups: int, length: int, stem: int = STEM) -> Callable[[pa.Table], pa.Table]:
    """Of a shard: repeats and entries to settle, by group. Each piece's entries are a batch of the shard's family."""

    def work(table: pa.Table) -> pa.Table:
        return verdicts_of(table, Family())

    def verdicts_of(table: pa.Table, family: Family) -> pa.Table:
        lost, old = [], bool(family.levels)
        columns = [packed(table[x], kind) for x, kind in zip(("names", "exts", "ids", "places"), PARTS)]
        if "sides" in table.column_names:
            columns.append([nearby(a, b) for a, b in zip(packed(table["befores"], np.uint8), packed(table["sides"], np.uint32))])
        batches = list(zip(*columns))
        # small pieces meet each other before they meet the levels: a batch is as large as what is there, so n entries are
        # looked at about log n times, however many pieces they come in
        waiting, size = [], 0
        for k, batch in enumerate(batches):
            waiting.append(batch)
            size += len(batch[0])
            if size >= max(BATCH, sum(len(x[0]) for x in family.levels)) or k + 1 == len(batches):
                lost += list(family.add(*(np.concatenate(x) for x in zip(*waiting))))
                waiting, size = [], 0
        asked = np.unique(np.concatenate([np.zeros(0, np.uint32), *(x[0] for x in batches)])) if old else None
        # entries of earlier runs are settled where a new one has their name
        again = lambda x: x[4] if asked is None else x[4] & np.isin(x[0], asked)
        mixed = [[x[k][again(x)] for x in family.levels] for k in (0, 2, 3, 5)]
        names, open_ids, open_places, near = (np.concatenate([*x, np.zeros(0, t)]) for x, t in zip(mixed, (np.uint32, np.int64, np.uint64, np.uint64)))
        own, first, number = to_settle(names, open_places, near, (length - stem) // 2)
        ids, places = (np.concatenate([*(x[k] for x in lost), y[own]]) for k, y in ((0, open_ids), (1, open_places)))
        is_open = np.arange(len(ids)) >= len(ids) - len(own)
        ties, starts, counts = unplaced(places)
        starts[is_open] += first
        counts[is_open] = number
        span = [joined(table[x], np.int64) for x in ("span_ids", "span_ties", "span_from", "span_to")]
        ids = np.concatenate([ids, span[0]])
        ties, starts = np.concatenate([ties, short(span[1])]), np.concatenate([starts, span[2]])
        counts = np.concatenate([counts, span[3] - span[2] - length + 1])
        is_open = np.concatenate([is_open, np.zeros(len(span[0]), bool)])
        return by_group((ids % groups).astype(np.int32), [ids, ties.astype(np.uint32), starts, counts.astype(np.int32), is_open], ["ids", "ties", "starts", "counts", "open"])

    work.with_family = verdicts_of
    return work


def matches_and_levels(groups: int, length: int, stem: int = STEM) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same with the shard's kept levels, and what has become of these."""
    verdicts_of = matches(groups, length, stem).with_family

    def work(table: pa.Table, kept: pa.Table) -> pa.Table:
        kept = kept.sort_by("level")
        names = ("names", "exts", "level_ids", "places", "mixed", "near")
        family = Family([level_of(row) for row in kept.to_pylist()])
        shard = (table if table.num_rows else kept)["shard"][0].as_py()
        found = verdicts_of(table, family)
        levels = pa.table(
            [pa.array([shard] * len(family.levels), pa.int32()), pa.array(range(len(family.levels)), pa.int32())] + [pa.array([x[i].astype(kind).tobytes() for x in family.levels], pa.binary()) for i, kind in enumerate(PARTS)],
            names=["shard", "level", *names],
        )
        return pa.concat_tables([found, levels], promote_options="default").select([x.split()[0] for x in f"{VERDICTS}, {LEVELS}".split(", ")])

    return work


def read_verdicts(texts: pa.Table, found: pa.Table) -> tuple[np.ndarray, ...]:
    """row, start, count, open of each verdict, for every row that it is about."""
    ids, ties = joined(found["ids"], np.int64), joined(found["ties"], np.uint32)
    starts, counts, is_open = joined(found["starts"], np.int64), joined(found["counts"], np.int32), joined(found["open"], bool)
    order = np.lexsort((starts, ties, ids))
    own = ids[order]
    row_ids, row_ties = texts["id"].to_numpy(), short(texts["tie"].to_numpy())
    low, high = np.searchsorted(own, row_ids, "left"), np.searchsorted(own, row_ids, "right")
    rows = np.repeat(np.arange(len(row_ids)), high - low)
    at = order[np.arange(len(rows)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)]
    good = ties[at] == row_ties[rows]
    rows, at = rows[good], at[good]
    return rows, starts[at], counts[at].astype(np.int64), is_open[at]


def open_windows(texts: pa.Table, found: pa.Table, length: int) -> tuple[np.ndarray, ...]:
    """Of the entries to settle: row, start, position in the group and two hashes of each window, in order of position."""
    rows, starts, counts, is_open = read_verdicts(texts, found)
    rows, starts, counts = rows[is_open], starts[is_open], counts[is_open]
    order = np.lexsort((starts, rows))
    rows, starts, counts = rows[order], starts[order], counts[order]
    each = np.repeat(np.arange(len(rows)), counts)
    start = starts[each] + np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
    row, hashes, at = rows[each], [], 0
    none = np.zeros(0, np.uint64)
    for batch in small_batches(iter(texts.to_batches())):
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
        a, b = np.searchsorted(row, (at, at + batch.num_rows))
        where = offsets[row[a:b] - at] + start[a:b]
        hashes.append([Hashes(data, v).at(where, length) if b > a else none for v in (_BYTE, _OTHER)])
        at += batch.num_rows
    offsets = np.r_[0, np.cumsum([len(x.as_py().encode()) for x in texts["text"]])].astype(np.int64)
    return row, start, offsets[row] + start, *(np.concatenate([*x, none]) for x in (zip(*hashes) if hashes else ((), ())))


def distinct(h: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first index of each pair of hashes, and which of these each pair is."""
    order = np.lexsort((h2, h))  # keeps the order of equal ones
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])][: len(h)]
    which = np.empty(len(h), np.int64)
    which[order] = runs(new)
    return order[new], which


def narrow(ids: np.ndarray, step: int) -> bytes:
    """ids that differ by multiples of step: the least, then how many steps each is above it, in as few bytes as hold them."""
    least = int(ids.min())
    above = (ids.astype(np.uint64) - np.uint64(least % (1 << 64))) // np.uint64(step)  # the difference may exceed a signed number
    return np.array([least], np.int64).tobytes() + above.astype(np.min_scalar_type(int(above.max()))).tobytes()


def widened(packed: bytes, n: int, step: int) -> np.ndarray:
    above = np.frombuffer(packed, f"u{(len(packed) - 8) // n}", offset=8).astype(np.uint64)
    return (above * np.uint64(step) + np.frombuffer(packed, np.uint64, 1)).astype(np.int64)


def windows(length: int, shards: int, groups: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a group: by shard, each distinct hash of the windows to settle, with the id and position of its first place."""

    def work(texts: pa.Table, found: pa.Table) -> pa.Table:
        texts = ordered(texts)
        row, _, position, h, h2 = open_windows(texts, found, length)
        which, _ = distinct(h, h2)  # the first index is the least position
        value, second = h[which], h2[which]
        ids, grp = texts["id"].to_numpy(), texts["grp"][0].as_py() if texts.num_rows else 0
        rows = [
            (s, grp, value[o].tobytes(), (second[o] >> np.uint64(32)).astype(np.uint32).tobytes(), narrow(ids[row[which[o]]], groups), position[which[o]].astype(np.uint32).tobytes())
            for s, o in dealt((value % np.uint64(shards)).astype(np.int64))
        ]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names=[x.split()[0] for x in OPEN.split(", ")])

    return work


def later(groups: int) -> Callable[[pa.Table], pa.Table]:
    """Of a shard: the positions of windows that another group holds with a smaller id."""

    def work(table: pa.Table) -> pa.Table:
        h, h2, positions = joined(table["hashes"], np.uint64), joined(table["seconds"], np.uint32), joined(table["positions"], np.uint32)
        sizes = [len(x.as_py()) // 8 for x in table["hashes"]]
        ids = np.concatenate([np.zeros(0, np.int64), *(widened(x.as_py(), n, groups) for x, n in zip(table["ids"], sizes))])
        grp = np.repeat(table["grp"].to_numpy().astype(np.int32), sizes)
        order = np.lexsort((ids, h2, h))
        again = order[1:][(h[order][1:] == h[order][:-1]) & (h2[order][1:] == h2[order][:-1])]
        return by_group(grp[again], [positions[again]], ["positions"])

    return work


def finished(length: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """doc_id, n_bytes, removed spans and what stays, of a group's documents."""

    def work(texts: pa.Table, found: pa.Table) -> pa.Table:
        texts = ordered(texts)
        rows, starts, counts, is_open = read_verdicts(texts, found)
        row, start, position, h, h2 = open_windows(texts, found, length)
        gone = np.isin(position, joined(found["positions"], np.uint32))
        first, which = distinct(h, h2)
        # a row that repeats stands twice in the group: the copy is not a repeat of it
        ids, ties = texts["id"].to_numpy(), texts["tie"].to_numpy()
        original = first[which]
        same = (ids[row] == ids[row[original]]) & (ties[row] == ties[row[original]]) & (start == start[original])
        gone = np.where(same, gone[original], True)
        rows = np.concatenate([rows[~is_open], row[gone]])
        a = np.concatenate([starts[~is_open], start[gone]])
        b = np.concatenate([starts[~is_open] + counts[~is_open] - 1 + length, start[gone] + length])
        order = np.lexsort((a, rows))
        rows, a, b = rows[order], a[order], b[order]
        cut = np.searchsorted(rows, np.arange(texts.num_rows + 1))
        n, spans, kept = [], [], []
        for i, text in enumerate(texts["text"]):
            data = text.as_py().encode()
            own, at, left = [], 0, []
            for x, y in zip(a[cut[i] : cut[i + 1]].tolist(), b[cut[i] : cut[i + 1]].tolist()):
                if own and x <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], y)
                else:
                    own.append([x, y])
            for x, y in own:
                left.append(data[at:x])
                at = y
            left.append(data[at:])
            n.append(len(data))
            spans.append([{"from": x, "to": y} for x, y in own])
            kept.append(b"".join(left))
        return pa.table([texts["doc_id"], pa.array(n, pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return work


SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
RESULT = "doc_id long, n_bytes long, removed array<struct<from:long,to:long>>, kept binary"


def redealt(shards: int) -> Callable:
    """Levels dealt out to so many shards, each part in the order that it had."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = level_of(row)
                rows = [(s, row["level"], *(x[np.sort(own)].tobytes() for x in parts)) for s, own in dealt(shard_of(parts[0], shards))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32(), pa.int32(), *[pa.binary()] * 6])], names=[x.split()[0] for x in LEVELS.split(", ")])

    return work


class Kept:
    """The family of earlier runs as a table at path: its levels, how many shards it has, and the greatest id in it. Where a run wants
    more than twice as many shards, the levels are dealt out anew."""

    def __init__(self, spark: SparkSession, path: str, shards: int):
        self.spark, self.path = spark, path
        last = spark.read.parquet(f"{path}/runs").orderBy(F.desc("run")).first() if exists(spark, f"{path}/runs") else None
        self.run, self.old, self.max_id = (last["run"], last["shards"], last["max_id"]) if last else (0, shards, None)
        self.shards = shards if shards > 2 * self.old else self.old

    def levels(self) -> DataFrame:
        if not self.run:
            return self.spark.createDataFrame([], LEVELS)
        found = self.spark.read.schema(LEVELS).parquet(f"{self.path}/levels-{self.run}")
        return found if self.shards == self.old else found.mapInArrow(redealt(self.shards), LEVELS)

    def follow(self, levels: DataFrame, max_id: int | None) -> None:
        """The levels after this run, then the mark by which the next run finds them: a run that fails leaves the old ones."""
        run = self.run + 1
        levels.write.mode("overwrite").parquet(f"{self.path}/levels-{run}")
        self.spark.createDataFrame([(run, self.shards, max_id)], "run int, shards int, max_id long").write.mode("append").parquet(f"{self.path}/runs")


def without_earlier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, stem: int = STEM, piece_bytes: int = PIECE_BYTES, group_bytes: int = GROUP_BYTES, index: str | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """doc_id, n_bytes, removed (maximal spans, in bytes) and kept (the other bytes) of every document.

    index: a path where the family is kept for later batches; it is made if there is none. earlier: the documents of earlier
    batches, with the same columns of id and text."""
    if not stem < length <= stem + 255:
        raise ValueError("an entry has at most 255 windows")
    spark = docs.sparkSession
    size = text_size(docs, text_col) + (text_size(earlier, text_col) if earlier is not None else 0)
    shards = groups = group_count(2 * pieces_for(spark, size, group_bytes))
    rows = rows_of(docs, id_col, text_col, groups)
    all_rows, old_id = rows, None
    if index is None:
        sent = rows.select("text", "id", "tie").mapInArrow(index_of(length, stem, shards, piece_bytes), SENT)
        found = saved(sent.groupBy("shard").applyInArrow(matches(groups, length, stem), VERDICTS), "matches")
    else:
        kept = Kept(spark, index, shards)
        shards, old_id = kept.shards, kept.max_id
        low, high, n, known = docs.agg(F.min(docs[id_col].cast("long")), F.max(docs[id_col].cast("long")), F.count("*"), F.count(docs[id_col])).first()
        if n != known or old_id is not None and low is not None and low <= old_id:
            raise ValueError("the ids of a batch lie above those of earlier ones, and none is null")
        if kept.run and earlier is None:
            raise ValueError("a later batch needs the earlier documents")
        if earlier is not None:
            all_rows = rows.unionByName(rows_of(earlier, id_col, text_col, groups))
        sent = rows.select("text", "id", "tie").mapInArrow(index_of(length, stem, shards, piece_bytes), SENT)
        both = sent.groupBy("shard").cogroup(kept.levels().groupBy("shard")).applyInArrow(matches_and_levels(groups, length, stem), f"{VERDICTS}, {LEVELS}")
        both = saved(both, "matches")
        kept.follow(both.filter("level is not null").select(*(x.split()[0] for x in LEVELS.split(", "))), max((x for x in (old_id, high) if x is not None), default=None))
        found = both.filter("level is null").select(*(x.split()[0] for x in VERDICTS.split(", ")))

    bits = bitmap(ids_in(found))
    near = marked(all_rows, bits, True)
    each = near.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(windows(length, shards, groups), OPEN)
    settled = each.groupBy("shard").applyInArrow(later(groups), "grp int, positions binary")
    verdicts = found.withColumn("positions", F.lit(None).cast("binary")).unionByName(
        settled.select("grp", *(F.lit(None).cast("binary").alias(x) for x in ("ids", "ties", "starts", "counts", "open")), "positions")
    )
    cut = near.groupBy("grp").cogroup(verdicts.groupBy("grp")).applyInArrow(finished(length), RESULT)
    if old_id is not None:
        cut = cut.filter(F.col("doc_id") > old_id)
    rest = marked(rows, bits, False).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<from:long,to:long>>").alias("removed"), F.col("text").cast("binary").alias("kept")
    )
    return cut.unionByName(rest)
