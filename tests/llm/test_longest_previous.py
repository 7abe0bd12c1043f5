from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tallyloom.llm import longest_previous as lp

WIDTH = 50


def brute(rows: list[tuple], width: int = WIDTH) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, sha256 of what stays); null ids come last."""
    rank = lambda i: (i is None, i or 0)
    least: dict[bytes, tuple] = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for k in range(len(t) - width + 1):
            s = t[k : k + width]
            least[s] = min(least.get(s, rank(i)), rank(i))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if least[t[k : k + width]] < rank(i):
                gone[k : k + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, **options) -> list[tuple]:
    rows = lp.keep_first(df, **options).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows), key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_against_brute_force(docs, texts, parts):
    assert got(docs, parts=parts) == brute([(r[0], r[1]) for r in texts])


def planted(seed: int) -> list[tuple]:
    """Passages, runs of one letter, texts repeated whole, ids that repeat, no ids, characters of several bytes."""
    r = random.Random(seed)
    letters = "abcd é日😀"
    text = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [text(r.randint(30, 200)) for _ in range(4)] + ["z" * 300, "ab" * 100]
    rows = []
    for i in range(60):
        pieces = [r.choice(passages)[r.randint(0, 20) :] if r.random() < 0.4 else text(r.randint(0, 90)) for _ in range(r.randint(0, 6))]
        rows.append((r.choice([i, i, i, 7, None]), "".join(pieces)))
    rows += [(100, rows[3][1]), (2, rows[3][1]), (None, rows[3][1]), rows[5], rows[5], (200, None), (201, "x" * 49), (202, "x" * 50), (203, "x" * 50)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted_repeats_in_small_blocks_with_hot_minimisers(spark, seed, monkeypatch):
    rows = planted(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df, hot_share=0.02) == brute(rows)


def test_hash_collisions_change_nothing():
    """Windows of different bytes that share a hash are told apart."""
    texts = [b"q" * 60, b"r" * 60, b"q" * 60 + b"s" * 60, b"t" * 70]
    raw = b"".join(t + b"\xff" for t in texts)
    order = np.arange(4)
    plain = sorted(zip(*(x.tolist() for x in lp.previous_factors(raw, order, WIDTH))))

    class Same(lp.Bytes):
        def spans(self, a, b):
            return np.zeros(len(a), np.uint64)

    kept, lp.Bytes = lp.Bytes, Same
    try:
        assert sorted(zip(*(x.tolist() for x in lp.previous_factors(raw, order, WIDTH)))) == plain
    finally:
        lp.Bytes = kept
    assert {s for s, _, _ in plain} == {2}


def test_factors_are_the_longest():
    """Against a comparison of all pairs of suffixes, inside strings."""
    r = random.Random(5)
    for _ in range(20):
        parts = ["".join(r.choice("ab") for _ in range(40)) for _ in range(3)]
        strings = ["".join(r.choice(parts) for _ in range(r.randint(1, 3)))[r.randint(0, 9) :].encode() for _ in range(12)]
        order = np.array([r.randint(0, 5) for _ in strings])
        want = []
        for i, s in enumerate(strings):
            for a in range(len(s) - 31):
                best = 0
                for j, t in enumerate(strings):
                    if order[j] < order[i]:
                        for b in range(len(t) - 31):
                            n = 0
                            while a + n < len(s) and b + n < len(t) and s[a + n] == t[b + n]:
                                n += 1
                            best = max(best, n)
                if best >= 32:
                    want.append((i, a, a + best))
        found = lp.previous_factors(b"".join(s + b"\xff" for s in strings), order, 32)
        assert sorted(zip(*(x.tolist() for x in found))) == want


def test_smaller_values_before():
    r = random.Random(2)
    for _ in range(50):
        order = np.array([r.randint(0, 6) for _ in range(40)])
        shared = np.array([0] + [r.randint(3, 9) for _ in range(39)])
        out = lp.nearest_smaller(order, shared, 5)
        for i in range(40):
            j, least = i, 99
            while j > 0 and least >= 5:
                least, j = min(least, shared[j]), j - 1
                if order[j] < order[i]:
                    break
            want = least if j != i and order[j] < order[i] and least >= 5 else 0
            assert (out[i] if out[i] >= 5 else 0) == want


def test_blocks_of_several_documents(spark, monkeypatch):
    rows = [(i, f"{i} " + "the same long line of text that all of the documents hold " * (1 + i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert got(df, parts=3) == brute(rows)


def test_empty_table_and_columns_that_clash(spark, empty):
    assert got(empty) == []
    df = spark.createDataFrame([(1, "a" * 80, b"x", 3), (2, "a" * 80, b"y", 4)], "doc_id long, text string, blob binary, block long")
    assert got(df) == brute([(1, "a" * 80), (2, "a" * 80)])
