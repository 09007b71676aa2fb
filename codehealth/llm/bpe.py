"""Byte-level BPE as a streaming transducer with bounded lookahead, and back to text by an incremental decoder.

**Sufficient lookahead.** Merges take place rule by rule, in the order of the list. Compare the merges of a text with those of
the same text and anything after it, and call d the leftmost place where the two differ; d begins at the text's end. The
rule (a, b) can move d only if one of the two merges an `a` that ends at d, so by the length of `a`; the next rule (a', b')
that moves it then needs an `a'` that ends at the new d and a `b'` that begins with that same `a`, so `a` is on the left
edge of the merges that made `b'`, and (a', b') is a later rule. The longest such chain of rules, by the lengths of their
left parts, is a property of the merge list alone: `lookahead_of` adds it up in one pass (320 bytes for byte_bpe_50k.json).
A token that ends that far before the end of what has been read is final, whatever follows.

**Transducer.** `Transducer` holds at most BLOCK + lookahead bytes: it merges them, emits the tokens that are final and
goes on from the last of them. That is right since nothing merges across a border that the whole text keeps. Texts are cut
into pieces (letters, digits, other signs, white space, English contractions) as the byte-level pre-tokenizer cuts them,
CHUNK characters at a time; a piece longer than that runs through the transducer part by part. Ids of short pieces are
remembered, up to CACHE of them. So beside the text and its ids memory is constant.

**Decoding.** `Decoder` turns ids into bytes and bytes into characters as they come and keeps an unfinished character of up to
three bytes between calls; bytes that are no UTF-8 become U+FFFD as the maximal invalid parts they are.

Texts: null and empty give no ids. Special tokens of the file (`<|endoftext|>`) are found in the text first. Ids that the
vocabulary does not have, and null ids, decode to nothing. Repeated rows, ties: each row by itself. Empty tables: no rows.
Other columns stay, but for one with the name of the result (in any case), which the result replaces. No shuffle. The
vocabulary is broadcast; its size is checked.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from codehealth.llm.words import small_batches

PATH = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of a vocabulary file at most; it is broadcast.
MOST_BYTES = 64 << 20
CHUNK, BLOCK, CACHE, SHORT = 1 << 16, 1 << 10, 1 << 18, 64
ID_BITS = 24
_ID, _NONE = (1 << ID_BITS) - 1, 1 << 62
OTHER, LETTER, DIGIT, WHITE = range(4)
#: Suffixes that an apostrophe takes along.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


class Vocabulary(NamedTuple):
    byte_ids: list[int]
    merges: dict[tuple[int, int], int]  # pair: rank and, in its lowest ID_BITS bits, id
    token_bytes: dict[int, bytes]
    special: dict[str, int]
    lookahead: int
    classes: bytes  # class of each code point
    digest: str  # of the file


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level files: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def lookahead_of(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token's end that make it final. merges: in order, each of single bytes or of earlier results."""
    left: dict[bytes, bytes] = {}
    chain: dict[bytes, int] = {}  # longest chain that ends with a rule of this left part
    longest = 0
    for a, b in merges:
        before, at = chain.get(b, 0), b
        while at in left:
            at = left[at]
            before = max(before, chain.get(at, 0))
        chain[a] = max(chain.get(a, 0), len(a) + before)
        longest = max(longest, chain[a])
        for part in (a, b):
            if len(part) > 1 and part not in left:
                raise ValueError(f"the merge of {a!r} and {b!r} comes before the one that makes {part!r}")
        if a + b in left:
            raise ValueError(f"two merges make {a + b!r}")
        left[a + b] = a
    return longest


def classes_of_characters() -> bytes:
    """Letter, digit, white space or other of each code point, in the Unicode version of the tokenizers library."""
    import unicodedata

    from tokenizers.pre_tokenizers import ByteLevel

    kinds = {"L": LETTER, "N": DIGIT}
    out = bytearray(kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000))
    everything = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    for found in regex.finditer(r"\p{White_Space}+", everything):
        out[found.start() : found.end()] = bytes([WHITE]) * (found.end() - found.start())
    cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
    newer = [c for found in regex.finditer(r"[\p{L}\p{N}]+", everything) for c in range(*found.span()) if out[c] == OTHER]
    for k in range(0, len(newer), 2000):  # characters that are younger than Python's tables: as the library sees them
        some = newer[k : k + 2000]
        for sign, kind in (("a", LETTER), ("1", DIGIT)):
            starts = {a for _, (a, _) in cut("".join(f"{sign}{chr(c)}\n" for c in some))}
            for place, c in enumerate(some):
                if 3 * place + 1 not in starts:
                    out[c] = kind
    return bytes(out)


def vocabulary(text: str) -> Vocabulary:
    """From the text of a tokenizers file. Only byte-level BPE is read: other parts of a file change results, so they are refused."""
    found = json.loads(text)
    model, cut = found["model"], found.get("pre_tokenizer") or {}
    plain = not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model["type"] != "BPE" or not plain or found.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError("not a byte-level BPE file without normalizer, prefix space or dropout")
    special = {x["content"]: x["id"] for x in found.get("added_tokens") or ()}
    if any(x.get(flag) for x in found.get("added_tokens") or () for flag in ("lstrip", "rstrip", "single_word", "normalized")):
        raise ValueError("special tokens that strip or want whole words")
    letters, ids = byte_letters(), model["vocab"]
    of = {name: bytes(letters[c] for c in name) for name in ids if all(c in letters for c in name)}
    pairs = [tuple(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
    merges = {(ids[a], ids[b]): rank << ID_BITS | ids[a + b] for rank, (a, b) in enumerate(pairs)}
    token_bytes = {ids[name]: data for name, data in of.items()} | {k: name.encode() for name, k in special.items()}
    single = {data[0]: ids[name] for name, data in of.items() if len(data) == 1}
    return Vocabulary([single[b] for b in range(256)], merges, token_bytes, special, lookahead_of([(of[a], of[b]) for a, b in pairs]), classes_of_characters(), hashlib.sha256(text.encode()).hexdigest())


def merged(data: bytes, words: Vocabulary) -> list[int]:
    """Ids of data: again and again the pair of the lowest rank, the leftmost of equal ones, becomes one token."""
    if len(data) > SHORT:
        return merged_by_heap(data, words)
    one, rule = words.byte_ids, words.merges.get
    ids = [one[b] for b in data]
    ranks = [rule(pair, _NONE) for pair in zip(ids, ids[1:])]
    while ranks and (least := min(ranks)) != _NONE:
        k = ranks.index(least)
        ids[k] = made = least & _ID
        del ids[k + 1], ranks[k]
        if k < len(ranks):
            ranks[k] = rule((made, ids[k + 1]), _NONE)
        if k:
            ranks[k - 1] = rule((ids[k - 1], made), _NONE)
    return ids


def merged_by_heap(data: bytes, words: Vocabulary) -> list[int]:
    """The same in n log n steps."""
    ids = [words.byte_ids[b] for b in data]
    rules, n = words.merges, len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = [(rule, k, ids[k], ids[k + 1]) for k in range(n - 1) if (rule := rules.get((ids[k], ids[k + 1]))) is not None]
    heapq.heapify(waiting)
    while waiting:
        rule, k, a, b = heapq.heappop(waiting)
        right = after[k]
        if ids[k] != a or right >= n or ids[right] != b:
            continue  # one of the two is part of another token by now
        ids[k], ids[right] = made, _ = rule & _ID, -1
        after[k] = right = after[right]
        if right < n:
            before[right] = k
            if (rule := rules.get((made, ids[right]))) is not None:
                heapq.heappush(waiting, (rule, k, made, ids[right]))
        if (left := before[k]) >= 0 and (rule := rules.get((ids[left], made))) is not None:
            heapq.heappush(waiting, (rule, left, ids[left], made))
    return [x for x in ids if x >= 0]


class Transducer:
    """Bytes of one piece in, ids out as soon as no later byte can change them."""

    def __init__(self, words: Vocabulary):
        self.words, self.held = words, b""

    def feed(self, data: bytes) -> list[int]:
        out, most, at = [], BLOCK + self.words.lookahead, 0
        while at < len(data):
            take = most - len(self.held)
            self.held += data[at : at + take]
            at += take
            if len(self.held) == most:
                final, end = most - self.words.lookahead, 0
                for k in merged(self.held, self.words):
                    if end + len(self.words.token_bytes[k]) > final:
                        break
                    out.append(k)
                    end += len(self.words.token_bytes[k])
                if not end:
                    raise ValueError(f"a token is longer than {BLOCK} bytes")
                self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        out, self.held = merged(self.held, self.words), b""
        return out


class _Remembered(dict):
    """Packed ids of short pieces, of the last CACHE / 2 to CACHE that came: when half is full, it becomes the older half."""

    def __init__(self, words: Vocabulary):
        super().__init__()
        self.words, self.older = words, {}

    def __missing__(self, piece: str) -> bytes:
        data = self.older.get(piece)
        if data is None:
            own = piece.encode()
            if len(own) > SHORT:
                run = Transducer(self.words)
                return packed(run.feed(own) + run.finish())
            data = packed(merged(own, self.words))
        if len(self) >= CACHE // 2:
            self.older = dict(self)
            self.clear()
        self[piece] = data
        return data


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    def __init__(self, words: Vocabulary):
        self.words, self.classes, self.known = words, np.frombuffer(words.classes, np.uint8), _Remembered(words)
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(words.special, key=len, reverse=True)) + ")") if words.special else None

    def kinds(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return codes, self.classes[codes]

    def starts(self, text: str) -> np.ndarray:
        """Where the pieces of text begin, as if it ended there."""
        codes, kind = self.kinds(text)
        n, cut = len(codes), np.ones(len(codes), bool)
        cut[1:] = kind[1:] != kind[:-1]
        last = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] != WHITE))  # the last of several goes with what follows, or stands alone
        cut[last] = True
        cut[last[codes[last] == 32] + 1] = False
        at = np.flatnonzero((codes[:-1] == 39) & cut[:-1] & (kind[1:] == LETTER))
        for k in at.tolist():
            size = next((len(x) for x in CONTRACTIONS if text.startswith(x, k + 1)), 0)
            if size:
                cut[k + 1] = False
                if k + 1 + size < n:
                    cut[k + 1 + size] = True
        return np.flatnonzero(cut)

    def long_piece(self, text: str, start: int, end: int) -> Iterator[str]:
        """Parts of the piece at `start`, which goes to `end` at least; the last character of a part waits, since white space may leave it to what follows."""
        kind = int(self.classes[ord(text[end - 1])])
        yield text[start : end - 1]
        at, n = end - 1, len(text)
        while True:
            part = text[at : at + CHUNK]
            own = self.kinds(part)[1] != kind
            size = int(own.argmax()) if own.any() else len(part)
            stop = at + size
            if size == len(part) and stop < n:
                yield part[:-1]
                at = stop - 1
                continue
            if kind == WHITE and stop < n:
                stop -= 1
            yield text[at:stop]
            return

    def segment(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text without special tokens. The last two pieces of a chunk are cut again, as what follows may
        change them, unless they fill it: then the first is whole, or one piece goes on and runs through the transducer."""
        at, n = 0, len(text)
        while at < n:
            part = text[at : at + CHUNK]
            starts = self.starts(part).tolist()
            if at + len(part) < n:
                if len(starts) < 3 and starts[-1] <= 4:
                    yield b"".join([self.known[part[a:b]] for a, b in zip(starts, starts[1:])])
                    run, at = Transducer(self.words), at + starts[-1]
                    end = at
                    for some in self.long_piece(text, at, at + len(part) - starts[-1]):
                        yield packed(run.feed(some.encode()))
                        end += len(some)
                    yield packed(run.finish())
                    at = end
                    continue
                if len(starts) >= 3:
                    starts = starts[:-1]
                at += starts[-1]
            else:
                starts.append(len(part))
                at = n
            yield b"".join(map(self.known.__getitem__, [part[a:b] for a, b in zip(starts, starts[1:])]))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.special.split(text) if self.special else [text]
        return b"".join(x for k, part in enumerate(parts) for x in ([packed([self.words.special[part]])] if k % 2 else self.segment(part)))


class Decoder:
    """Ids in, text out; what is no whole character yet waits for the next ids."""

    def __init__(self, words: Vocabulary):
        self.of, self.run = words.token_bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int | None]) -> str:
        return self.run.decode(b"".join(self.of.get(k, b"") for k in ids))

    def finish(self) -> str:
        out = self.run.decode(b"", True)
        self.run.reset()
        return out

    def decode(self, ids: np.ndarray) -> str:
        return "".join([self.feed(ids[k : k + CHUNK].tolist()) for k in range(0, len(ids), CHUNK)]) + self.finish()


#: Of this Python worker, by the digest of the vocabulary's file.
_READY: dict[str, tuple[Encoder, Decoder]] = {}


def _ready(words: Vocabulary) -> tuple[Encoder, Decoder]:
    if words.digest not in _READY:
        _READY.clear()
        _READY[words.digest] = Encoder(words), Decoder(words)
    return _READY[words.digest]


def load(path: str = PATH) -> Vocabulary:
    """Read on the driver only."""
    with open(path, encoding="utf-8") as file:
        text = file.read(MOST_BYTES + 1)
    if len(text) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} characters, too many to broadcast")
    return vocabulary(text)


def _with(df: DataFrame, name: str, kind, make: Callable, drop: str | None) -> DataFrame:
    """df with the column `name` (instead of any of that name in any case), and without `drop`."""
    fields = [f for f in df.schema.fields if f.name.lower() != name.lower() and f.name != drop]
    keep, schema = [f.name for f in fields], StructType([*fields, StructField(name, kind)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small, column in make(batch):
                yield pa.RecordBatch.from_arrays([*(small.column(small.schema.get_field_index(x)) for x in keep), column], names=[*keep, name])

    return df.mapInArrow(work, schema)


def encoded(df: DataFrame, path: str = PATH, text_col: str = "text", name: str = "ids", packed_ids: bool = False, drop_text: bool = False) -> DataFrame:
    """df with the ids of each text: an array of int or, packed, little-endian unsigned 32-bit integers as one binary value."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def make(batch: pa.RecordBatch):
        encoder = _ready(shared.value)[0]
        for small in small_batches([batch], text_col):
            data = [encoder.encode(x) if x else b"" for x in small.column(small.schema.get_field_index(text_col)).to_pylist()]
            if packed_ids:
                yield small, pa.array(data, pa.binary())
            else:
                offsets = np.cumsum([0, *(len(x) // 4 for x in data)])
                yield small, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(data), "<u4").astype(np.int32)))

    return _with(df, name, BinaryType() if packed_ids else ArrayType(IntegerType()), make, text_col if drop_text else None)


def decoded(df: DataFrame, path: str = PATH, ids_col: str = "ids", name: str = "text", drop_ids: bool = False) -> DataFrame:
    """df with the text of each array of ids, or of ids packed as `encoded` packs them; null ids give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def make(batch: pa.RecordBatch):
        decoder, ids = _ready(shared.value)[1], batch.column(batch.schema.get_field_index(ids_col))
        for k in range(0, batch.num_rows, 256):
            some = ids.slice(k, 256)
            if pa.types.is_binary(some.type) or pa.types.is_large_binary(some.type):
                rows = (np.frombuffer(x or b"", "<u4") for x in some.to_pylist())
            else:
                rows = (np.array([i for i in x or () if i is not None], np.int64) for x in some.to_pylist())
            yield batch.slice(k, 256), pa.array([decoder.decode(x) for x in rows], pa.string())

    return _with(df, name, StringType(), make, ids_col if drop_ids else None)
