"""Near-duplicates, repeated windows and repeated bytes against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from codehealth.llm import blocks, near_dups, suffixes
from tests.llm import cases

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_set(text, k=5):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(data):
    sets = [(i, shingle_set(t)) for i, t, *_ in data]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


@pytest.mark.parametrize("make", [cases.docs, cases.clashing])
def test_near_duplicates_equal_brute_force(spark, make):
    got = near_dups.near_duplicates(make(spark)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute_components(cases.rows())


def test_near_duplicates_of_nothing(spark):
    assert near_dups.near_duplicates(cases.empty(spark)).count() == 0


def test_null_id_has_no_component(spark):
    rows = [(None, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1)]
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_dups.near_duplicates(cases.docs(spark, rows)).collect()}
    assert got == {None: (None, True), 1: (1, True)}


def test_a_chain_of_links_is_one_component(spark):
    """Neighbours overlap enough, ends do not: no single hub links them all."""
    words = [f"t{i}" for i in range(300)]
    rows = [(10 - k, " ".join(words[k * 4 : k * 4 + 120]), "en", "s", 0) for k in range(8)]
    got = near_dups.near_duplicates(cases.docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute_components(rows)


def test_odd_sketch_bounds_the_difference():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:300], rng.integers(0, 2**63, 90).astype(np.uint64)]))
    x, y = (near_dups.odd_sketch(np.zeros(len(s), np.int64), s, 1).view(np.uint64) for s in (a, b))
    differ = sum(bin(int(v)).count("1") for v in (x ^ y)[0])
    assert 0 < differ <= len(np.setxor1d(a, b))


def test_densified_signatures_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(1)
    bins, table = 2000, near_dups.lenders(2000)
    a = rng.integers(0, 2**63, 60).astype(np.uint64)
    b = np.concatenate([a[:50], rng.integers(0, 2**63, 10).astype(np.uint64)])
    row = np.repeat([0, 1], 60)
    sig = near_dups.signatures(row, np.concatenate([a, b]), 2, bins, table)
    assert abs((sig[0] == sig[1]).mean() - 50 / 70) < 0.08


def brute_windows(data, w=35):
    words = [(t or "").encode().split() for _, t, *_ in data]
    seen = Counter(tuple(x[i : i + w]) for x in words for i in range(len(x) - w + 1))
    out = []
    for (doc, *_), x in zip(data, words):
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if seen[tuple(x[i : i + w])] > 1:
                gone[i : i + w] = [True] * w
        out.append((doc, len(x), sum(gone), b" ".join(y for y, g in zip(x, gone) if not g).decode()))
    return sorted(out)


@pytest.mark.parametrize("make", [cases.docs, cases.clashing])
@pytest.mark.parametrize("window", [35, 4, 1])
def test_repeated_windows_equal_brute_force(spark, make, window):
    got = blocks.without_repeats(make(spark), window=window, piece_bytes=4000, group_bytes=4000).collect()
    assert sorted(map(tuple, got)) == brute_windows(cases.rows(), window)


def test_repeated_windows_of_nothing(spark):
    assert blocks.without_repeats(cases.empty(spark)).count() == 0


def test_rows_without_ids_are_spread(spark):
    """No group gathers them, and they repeat each other like others."""
    rows = [(None, *r[1:]) for r in cases.rows()]
    assert blocks.rows_of(cases.docs(spark, rows), "doc_id", "text", 97).select("grp").distinct().count() > 20
    got = blocks.without_repeats(cases.docs(spark, rows), piece_bytes=4000, group_bytes=4000).select("n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(r[1:] for r in brute_windows(cases.rows()))
    got = suffixes.without_earlier(cases.docs(spark, rows), piece_bytes=3000, group_bytes=3000).collect()
    own = blocks.rows_of(cases.docs(spark, rows), "doc_id", "text", 97).select("text", "id").collect()  # their order is that of a hash
    order = {r["text"]: r["id"] for r in own}
    want = brute_bytes([(order[t or ""], t) for _, t, *_ in rows])
    flat = [(r["n_bytes"], sum(x["to"] - x["from"] for x in r["removed"]), len(r["removed"]), bytes(r["kept"])) for r in got]
    assert sorted(flat) == sorted(r[1:] for r in want)


def test_windows_that_agree_in_one_hash_only_are_different():
    h, check = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    kind, first, times = blocks.same_windows(h, check)
    assert kind[0] == kind[2] != kind[1] and sorted(times.tolist()) == [1, 1, 2] and len(first) == 3


def brute_bytes(data, w=100):
    seen, out = {}, []
    order = sorted({(d, t or "") for d, t, *_ in data})
    for doc, text in order:
        b = text.encode()
        gone = [False] * len(b)
        for i in range(len(b) - w + 1):
            if b[i : i + w] in seen:
                gone[i : i + w] = [True] * w
            seen.setdefault(b[i : i + w], (doc, i))
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    times = Counter((d, t or "") for d, t, *_ in data)
    return sorted(row for (key, row) in zip(order, out) for _ in range(times[key]))


@pytest.mark.parametrize("make", [cases.docs, cases.clashing])
@pytest.mark.parametrize("length,stem", [(100, 24), (40, 24), (30, 8)])
def test_earlier_bytes_equal_brute_force(spark, make, length, stem):
    got = suffixes.without_earlier(make(spark), length=length, stem=stem, piece_bytes=3000, group_bytes=3000).collect()
    flat = [(r["doc_id"], r["n_bytes"], sum(x["to"] - x["from"] for x in r["removed"]), len(r["removed"]), bytes(r["kept"])) for r in got]
    assert sorted(flat) == brute_bytes(cases.rows(), length)


def test_later_batches_take_up_the_index(spark, tmp_path):
    """Four batches against one brute force over all; one of them is empty."""
    data, path = cases.rows(), f"{tmp_path}/index"
    want = {b: [r for r in brute_bytes(data) if low <= r[0] < high] for b, (low, high) in enumerate(((0, 30), (30, 30), (30, 66), (66, 999)))}
    seen = cases.empty(spark)
    for b, (low, high) in enumerate(((0, 30), (30, 30), (30, 66), (66, 999))):
        batch = cases.docs(spark).filter(f"doc_id >= {low} and doc_id < {high}")
        got = suffixes.without_earlier(batch, piece_bytes=3000, group_bytes=3000, index=path, earlier=seen).collect()
        flat = [(r["doc_id"], r["n_bytes"], sum(x["to"] - x["from"] for x in r["removed"]), len(r["removed"]), bytes(r["kept"])) for r in got]
        assert sorted(flat) == want[b]
        seen = seen.unionByName(batch)
    levels = spark.read.parquet(f"{path}/levels-4").groupBy("shard").count().agg({"count": "max"}).first()[0]
    assert 1 <= levels <= 6
    with pytest.raises(ValueError):
        suffixes.without_earlier(batch, index=path, earlier=seen)
    with pytest.raises(ValueError):
        suffixes.without_earlier(cases.docs(spark, [(10_000, "x", "en", "s", 1)]), index=path)


def test_shards_follow_an_index_that_grows(spark, tmp_path):
    """A batch of five rows, then many, then a few again: the levels are dealt out anew, and results are those of one run."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    parts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    data = [(i, " ".join(rng.choice(parts) for _ in range(3)), None, None, None) for i in range(400)]
    want = {r[0]: r for r in brute_bytes(data)}
    path, seen, shards = f"{tmp_path}/index", cases.empty(spark), []
    for low, high in ((0, 5), (5, 380), (380, 400)):
        batch = cases.docs(spark, data[low:high])
        got = suffixes.without_earlier(batch, piece_bytes=3000, group_bytes=3000, index=path, earlier=seen).collect()
        flat = [(r["doc_id"], r["n_bytes"], sum(x["to"] - x["from"] for x in r["removed"]), len(r["removed"]), bytes(r["kept"])) for r in got]
        assert sorted(flat) == [want[i] for i in range(low, high)]
        seen = seen.unionByName(batch)
        shards.append(spark.read.parquet(f"{path}/runs").orderBy("run").collect()[-1]["shards"])
    assert shards[0] < 20 < 50 < shards[1] == shards[2]
    assert spark.read.parquet(f"{path}/levels-3").select("shard").distinct().count() > 50


def one_table(rng, pieces, size):
    import pyarrow as pa

    rows = []
    for k in range(pieces):
        names = rng.integers(0, 1 << 20, size).astype(np.uint32)
        places = suffixes.placed(np.full(size, k), np.arange(size), np.full(size, 3))
        rows.append((0, names.tobytes(), names.astype(np.uint64).tobytes(), np.full(size, k).tobytes(), places.tobytes(), *[b""] * 4))
    return pa.table([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows))], names=[x.split()[0] for x in suffixes.ENTRIES.split(", ")])


def test_work_of_a_family_follows_the_entries_not_the_pieces():
    import time

    took = {}
    for pieces in (64, 4096):
        table = one_table(np.random.default_rng(1), pieces, 120_000 // pieces)
        began = time.process_time()
        suffixes.matches(101, 100)(table)
        took[pieces] = time.process_time() - began
    assert took[4096] < 5 * took[64] + 0.5


def test_windows_to_settle_need_both_hashes():
    first, which = suffixes.distinct(np.array([5, 5, 5, 9], np.uint64), np.array([2, 1, 2, 1], np.uint64))
    assert sorted(first.tolist()) == [0, 1, 3] and which[0] == which[2] != which[1]


def test_places_come_back():
    ties, starts, counts = np.array([-(1 << 63), 0, (1 << 63) - 1]), np.array([0, (1 << 31) - 1, 12]), np.array([1, 255, 9])
    got = suffixes.unplaced(suffixes.placed(ties, starts, counts))
    assert got[0].tolist() == [0, 1 << 24, (1 << 25) - 1] and got[1].tolist() == starts.tolist() and got[2].tolist() == counts.tolist()


def test_rows_of_one_id_and_other_texts(spark):
    rng = random.Random(9)
    parts = ["".join(rng.choice("abcdef") for _ in range(150)) for _ in range(12)]
    data = [(i % 7, rng.choice(parts) + rng.choice(parts), None, None, None) for i in range(60)]
    own = blocks.rows_of(cases.docs(spark, data), "doc_id", "text", 97).select("doc_id", "text", "tie").collect()
    order = {(r["doc_id"], r["text"]): (r["doc_id"], r["tie"]) for r in own}
    want = brute_bytes([(order[d, t], t) for d, t, *_ in data])
    got = suffixes.without_earlier(cases.docs(spark, data), piece_bytes=3000, group_bytes=3000).collect()
    assert sorted((r["doc_id"], r["n_bytes"], len(r["removed"]), bytes(r["kept"])) for r in got) == sorted((k[0], n, spans, kept) for k, n, _, spans, kept in want)


def open_windows_of(texts, length, stem):
    """How many windows are to be settled in a shard that holds the texts, a document each."""
    import pyarrow as pa

    batch = pa.record_batch([pa.array(texts), pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64())], ["text", "id", "tie"])
    (sent,) = suffixes.index_of(length, stem, 1, 1 << 20)(iter([batch]))
    found = suffixes.matches(1, length, stem)(pa.Table.from_batches([sent]))
    return sum(int((np.frombuffer(c, np.int32) * np.frombuffer(o, bool)).sum()) for c, o in zip(found["counts"].to_pylist(), found["open"].to_pylist()))


@pytest.mark.parametrize("length,stem", [(100, 24), (40, 24), (30, 8)])
def test_only_windows_of_sides_that_agree_are_settled(length, stem):
    """A phrase that recurs in unlike texts has common stems, but no window of it can recur; of an edited copy windows are settled."""
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    phrase, body = noise(stem + (length - stem) // 4), noise(400)
    assert open_windows_of([noise(300) + phrase + noise(300) for _ in range(40)], length, stem) < 40
    edited = body[:200] + "!" + body[201:]
    assert 0 < open_windows_of([body, edited], length, stem) < 2 * 2 * length


def test_ids_come_back_narrow():
    for ids, step, most in (([7, 107, 1007], 100, 8 + 3), ([-(1 << 63), (1 << 63) - 1], 1, 8 + 16), ([5], 3, 9), ([3, 3 + 300 * 11], 11, 8 + 4)):
        packed = suffixes.narrow(np.array(ids, np.int64), step)
        assert suffixes.widened(packed, len(ids), step).tolist() == ids and len(packed) <= most


def test_earlier_bytes_of_nothing(spark):
    assert suffixes.without_earlier(cases.empty(spark)).count() == 0


def test_levels_of_a_family_grow_geometrically():
    rng, family, lost = np.random.default_rng(2), suffixes.Family(), 0
    total = []
    for k in range(16):
        names = rng.integers(0, 5000, 200).astype(np.uint32)
        exts = names.astype(np.uint64) * 7 + rng.integers(0, 2, 200).astype(np.uint64)
        ids, places = np.full(200, k), np.arange(200).astype(np.uint64)
        total.append((names, exts, ids, places))
        lost += sum(len(x[0]) for x in family.add(names, exts, ids, places))
    sizes = [len(x[0]) for x in family.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:])) and len(sizes) <= 6
    names, exts = (np.concatenate([t[i] for t in total]) for i in (0, 1))
    pairs = set(zip(names.tolist(), exts.tolist()))
    assert sum(sizes) == len(pairs) and lost == len(names) - len(pairs)
    several = Counter(n for n, _ in pairs)
    assert all(bool(m) == (several[n] > 1) for level in family.levels for n, m in zip(level[0].tolist(), level[4]))


def test_queries_carry_digests(spark, tmp_path):
    from codehealth.llm import queries

    cases.docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in queries.op9_block_anchors(spark, str(tmp_path)).collect()}
    assert got == {(d, g, hashlib.sha256(k.encode()).hexdigest()) for d, _, g, k in brute_windows(cases.rows())}
    got = {(r["doc_id"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op10_suffix_index(spark, str(tmp_path)).collect()}
    assert got == {(d, g, s, hashlib.sha256(k).hexdigest()) for d, _, g, s, k in brute_bytes(cases.rows())}
