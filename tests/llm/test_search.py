"""Ranked search, byte-pair encoding and whitening against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from codehealth.llm import bpe, lexical_search, queries, whitening
from tests.llm import cases

# --- search ---------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = [(1, "w1 w2 W3 été w1"), (2, None), (3, ""), (4, "nothing-here zzz"), (5, "edit w7 a A ab1 GRÖSSE größe"), (5, "w9"), (None, "w5 w6"), (7, " ".join(f"w{i}" for i in range(90)))]


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=20):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c in own:
            m, score = 75 + 25 * sum(c.values()) * n_docs // n_terms, 0
            for t in terms(text):
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score:
                rows.append((-score, i is None, i, score))
        out += [(item, r + 1, i, score) for r, (_, _, i, score) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("make,step,most", [(cases.docs, 16, 1 << 20), (cases.clashing, 1, 50)])
def test_search_equals_brute_force(spark, monkeypatch, make, step, most):
    monkeypatch.setattr(lexical_search, "FIRST_STEP", step)
    frame = make(spark).unionByName(cases.docs(spark, [(None, "w1 w5 w6 w6", None, None, None)] * 2), allowMissingColumns=True)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as query", "2 as score", "3 as rank", "4 as id")
    got = sorted((tuple(r) for r in lexical_search.search(frame, items, k=5).collect()), key=str)
    docs = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    assert got == brute_search(docs, ITEMS, 5) and len(got) > 20
    assert sorted((tuple(r) for r in lexical_search.search(frame, items, k=5, block_bytes=60).collect()), key=str) == got


def piece(rng, n_docs=300, n_terms=12):
    postings = sorted({(rng.randrange(n_docs), min(rng.randrange(n_terms), rng.randrange(n_terms))) for _ in range(n_docs * 3)})
    doc, term = (np.array(x) for x in zip(*postings))
    tf = np.array([rng.choice([1, 1, 1, 2, 5]) for _ in postings], np.int64)
    n = np.array([rng.randrange(20, 200) for _ in range(n_docs)], np.int64)
    return lexical_search.Piece(pa.array(range(n_docs)), n, doc, term, tf, n_docs, int(n.sum())), doc, term


@pytest.mark.parametrize("seed", range(8))
def test_best_positions_equal_a_full_scan(monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(lexical_search, "FIRST_STEP", rng.choice([1, 4]))
    own, doc, term = piece(rng)
    for _ in range(10):
        asked = rng.sample(range(12), rng.randrange(1, 6))
        weights = np.zeros(12, np.int64)
        weights[asked] = [rng.choice([0, 1, 900, 5000]) for _ in asked]
        scores = np.bincount(doc, weights=(weights[term] * own.impact).astype(float), minlength=300).astype(np.int64)
        least = rng.choice([0, 0, int(np.sort(scores)[-3])])
        want = sorted(((-s, d) for d, s in enumerate(scores.tolist()) if s >= max(least, 1)))[:5]
        docs, found = own.search(asked, weights, 5, least)
        assert list(zip((-found).tolist(), docs.tolist())) == want


def test_a_search_stops_early():
    n = 4000
    own = lexical_search.Piece(pa.array(range(n)), np.full(n, 50, np.int64), np.arange(n), np.zeros(n, np.int64), np.arange(n, 0, -1), n, 50 * n)
    docs, _ = own.search([0], np.array([7]), 5, 0)
    assert docs.tolist() == [0, 1, 2, 3, 4] and own.seen.sum() < 200


def test_search_in_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for docs, asked in ((cases.empty(spark), items), (cases.docs(spark), items.filter("false")), (cases.docs(spark, [(1, " -", None, None, None), (2, None, None, None, None)]), items)):
        found = lexical_search.search(docs, asked)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_a_long_text_and_many_copies(spark):
    docs = [(i, "w1 w2 " + "x" * 40, None, None, None) for i in range(3000)] + [(5000, "w1 " * 300_000, None, None, None), (5001, "y" * 2_000_000, None, None, None)]
    docs += [(6000 + i, "other words", None, None, None) for i in range(5000)]
    found = lexical_search.search(cases.docs(spark, docs).repartition(5), spark.createDataFrame([(1, "w2 w1")], "item_id long, text string"), k=7).collect()
    assert [r["doc_id"] for r in sorted(found, key=lambda r: r["rank"])] == list(range(7)) and len({r["score"] for r in found}) == 1


# --- encoding -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.PATH)


@pytest.fixture(scope="module")
def words():
    return bpe.load()


ALPHABET = ["a", "b", "'s", "'re", " ", "  ", "\n", "\t", "'", "1", "23", "é", "中文", "!", "...", "<|endoftext|>", "<|end", " ", "​", "́", "😀", "the", " guarantee", "ing", "\r\n", "'ll", "'LL", "x" * 50, " " * 7]


@pytest.mark.parametrize("chunk", [16, 1 << 16])
def test_ids_and_texts_are_the_librarys(monkeypatch, library, words, chunk):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    rng, encoder, decoder = random.Random(chunk), bpe.Encoder(words), bpe.Decoder(words)
    for _ in range(800):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(30)))
        ids = np.frombuffer(encoder.encode(text), "<u4")
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert decoder.decode(ids) == text


@pytest.mark.parametrize("text", ["a" * 150_000, "guarantee" * 10_000, " " * 140_000 + "x", "\n" * 70_001 + "'s", "中" * 70_000, "!" * 70_000 + "'s", "q3" * 20_000])
def test_long_pieces(library, words, text):
    assert np.frombuffer(bpe.Encoder(words).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bytes_that_are_no_text(library, words):
    rng, decoder = random.Random(1), bpe.Decoder(words)
    for _ in range(300):
        ids = [rng.randrange(50_400) for _ in range(rng.randrange(40))]
        assert decoder.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)
        parts = [decoder.feed(ids[k : k + 1]) for k in range(len(ids))] + [decoder.finish()]
        assert "".join(parts) == library.decode(ids, skip_special_tokens=False)


def test_characters_are_classed_as_the_library_does(library, words):
    rng = random.Random(4)
    some = sorted({*range(0x3000), *(rng.randrange(0x110000) for _ in range(6000))} - set(range(0xD800, 0xE000)))
    for sign, kind in (("a", bpe.LETTER), ("1", bpe.DIGIT), ("!", bpe.OTHER)):
        starts = {a for _, (a, _) in library.pre_tokenizer.pre_tokenize_str("".join(f"{sign}{chr(c)}\n" for c in some))}
        assert [c for k, c in enumerate(some) if (3 * k + 1 not in starts) != (words.classes[c] == kind)] == []


def trained(rng, n):
    parts, rules = [bytes([x]) for x in b"abc"], []
    while len(rules) < n:
        a, b = rng.choice(parts), rng.choice(parts)
        if a + b not in parts and len(a + b) < 12:
            rules.append((a, b))
            parts.append(a + b)
    return rules


def test_final_tokens_stay_whatever_follows():
    rng = random.Random(8)
    for _ in range(40):
        rules = trained(rng, 12)
        names = {p: k for k, p in enumerate([bytes([x]) for x in range(256)] + [a + b for a, b in rules])}
        merges = {(names[a], names[b]): rank << bpe.ID_BITS | names[a + b] for rank, (a, b) in enumerate(rules)}
        own = bpe.Vocabulary(list(range(256)), merges, {k: p for p, k in names.items()}, {}, bpe.lookahead_of(rules), b"", "")
        for _ in range(30):
            text = bytes(rng.choice(b"abc") for _ in range(60))
            whole, cut = bpe.merged(text, own), bpe.merged(text[:40], own)
            assert whole == bpe.merged_by_heap(text, own)
            end, final = 0, []
            for k in cut:
                end += len(own.token_bytes[k])
                if end > 40 - own.lookahead:
                    break
                final.append(k)
            assert whole[: len(final)] == final


def test_lookahead_of_small_lists():
    assert bpe.lookahead_of([]) == 0
    assert bpe.lookahead_of([(b"a", b"b")]) == 1
    assert bpe.lookahead_of([(b"b", b"c"), (b"a", b"bc")]) == 2  # c takes b, which a then takes
    for bad in ([(b"ab", b"c")], [(b"a", b"b"), (b"a", b"b")]):
        with pytest.raises(ValueError):
            bpe.lookahead_of(bad)


@pytest.mark.parametrize("make", [cases.docs, cases.clashing])
def test_columns_stay_and_texts_come_back(spark, library, make):
    frame = make(spark).selectExpr("*", "'x' as IDS")
    ids = bpe.encoded(frame)
    assert ids.columns == [c for c in frame.columns if c != "IDS"] + ["ids"]
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in ids.collect())
    assert got == sorted((d, tuple(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in cases.rows())
    back = bpe.decoded(ids, name="again")
    assert all(r["again"] == (r["text"] or "") for r in back.collect())
    packed = bpe.decoded(bpe.encoded(frame, packed_ids=True, drop_text=True), drop_ids=True)
    assert "ids" not in packed.columns and sorted(r["text"] for r in packed.collect()) == sorted(t or "" for _, t, *_ in cases.rows())
    assert bpe.encoded(cases.empty(spark)).count() == 0


def test_null_and_unknown_ids(spark):
    rows = spark.createDataFrame([(None,), ([],), ([None, 64, 10**8, 65],)], "ids array<long>")
    assert sorted(r["text"] for r in bpe.decoded(rows).collect()) == ["", "", "ab"]


def test_query_of_encoding(spark, library, tmp_path):
    rows = [(d, t) for d, t, *_ in cases.rows()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in queries.op12_bpe_stream(spark, str(tmp_path)).collect()) == sorted(want)


# --- whitening ------------------------------------------------------------------------------------------------------


def plain_whitening(vectors, most=4):
    """Of the rows that are whole: deviations, and components by a symmetric eigenvalue routine."""
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, found = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(len(s), len(s)))
    top = [(values[-1 - k], found[:, -1 - k]) for k in range(min(most, len(s))) if values[-1 - k] > 1e-9 * max(values)]
    return n, ((n * x - s) ** 2).sum(axis=1).tolist(), [((x - s / n) @ v / np.sqrt(e), e / values.sum()) for e, v in top]


def checked(spark, vectors, bad=(), most=4):
    rows = [(i, list(map(float, v))) for i, v in enumerate(vectors)] + [(1000 + i, v) for i, v in enumerate(bad)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as x", "2 as id", "3 as v", "4 as component").repartition(3)
    got = {(r["vec_id"], r["component"]): r for r in whitening.whitened(frame, most=most).collect()}
    n, deviation, top = plain_whitening(vectors, most)
    assert sorted(got) == [(i, k + 1) for i in range(len(vectors)) for k in range(len(top))]
    for k, (want, share) in enumerate(top):
        own = np.array([got[i, k + 1]["whitened"] for i in range(len(vectors))])
        assert min(abs(own - want).max(), abs(own + want).max()) < 1e-6
        assert all(abs(got[i, k + 1]["explained"] - share) < 1e-9 and got[i, k + 1]["n"] == n and got[i, k + 1]["deviation"] == deviation[i] for i in range(len(vectors)))
    assert all(r["identity_error"] < 1e-10 for r in got.values())
    return got


def test_whitening_equals_a_plain_one(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(60, 9)) * np.arange(1, 10)).tolist()
    bad = [None, [1.0, None] + [0.0] * 7, [float("nan")] * 9, [float("inf")] + [0.0] * 8]
    checked(spark, vectors + vectors[:7] + vectors[:1] * 30, bad)


def test_fewer_components_than_asked_for(spark):
    base = np.random.default_rng(2).integers(-5, 5, (20, 2))
    checked(spark, np.c_[base, base[:, :1] * 2].tolist())  # rank 2 of 3 dimensions
    checked(spark, [[1.0], [2.0], [4.0]])
    checked(spark, np.random.default_rng(3).normal(size=(4, 12)).tolist())  # fewer rows than dimensions


def test_large_entries_are_exact(spark):
    vectors = [[2.0**30, 3.0, 1.0], [-(2.0**31), 5.0, 2.0], [2.0**29, -7.0, 2.5], [1.0, 1.0, 1.0]]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = whitening.whitened(rows).collect()
    assert len(got) == 12 and all(r["deviation"] is None for r in got) and max(r["identity_error"] for r in got) < 1e-4
    fit = whitening.scatter(whitening.integer_vectors(rows.withColumnRenamed("embedding", "vector"), "vector").select("x"))
    x = [[math.floor(256 * c) for c in v] for v in vectors]
    s = [sum(c) for c in zip(*x)]
    assert fit.sums == s and fit.values == [[4 * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(3)] for i in range(3)]


def test_equal_eigenvalues_share_a_space(spark):
    vectors = [[s * 2.0 * (i == j) for j in range(5)] for i in range(5) for s in (1, -1)]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = whitening.whitened(rows).toPandas()
    y = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert y.shape == (10, 4) and abs(np.cov(y.T, bias=True) - np.eye(4)).max() < 1e-9 and abs(got.explained - 0.2).max() < 1e-12


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        found = whitening.whitened(spark.createDataFrame(rows, schema))
        assert found.count() == 0 and found.columns[0] == "vec_id"
    with pytest.raises(ValueError, match="several lengths"):
        whitening.whitened(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))


def test_polynomial_and_roots():
    rng = np.random.default_rng(5)
    x = rng.integers(-9, 9, (30, 6))
    a = x.T @ x
    poly = whitening.combined(p := whitening.primes_for(10**30), [whitening.polynomial_modulo(a % q, q).tolist() for q in p])
    assert poly[-1] == 1 and poly[-2] == -int(np.trace(a)) and abs(poly[0] / np.linalg.det(a.astype(float)) - 1) < 1e-12
    roots, bits = whitening.largest_roots(poly, 6)
    assert np.allclose([r / 2**bits for r in roots], np.linalg.eigvalsh(a.astype(float))[::-1])
    assert [whitening.above(poly, t, 0) for t in (0, 10**9)] == [6, 0]
    roots, bits = whitening.largest_roots([0, 0, -3, 1], 3)  # 3, and 0 twice
    assert len(roots) == 1 and abs(roots[0] / 2**bits - 3) < 1e-12
