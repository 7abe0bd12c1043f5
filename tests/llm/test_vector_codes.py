from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from tallyloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, v int, position int, part int, code int"


def brute(rows: list[tuple], parts: int = 4, rounds: int = 4, entries: int = 256) -> tuple[list[tuple], str]:
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) and abs(x) < vc.LIMIT for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    cuts = vc.bounds(size, parts)
    books = [[r[1][a : a + n] for r in kept[:entries]] for a, n in cuts]

    def assign(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, n) in enumerate(cuts):
            members: dict[int, list] = {}
            for r in kept:
                members.setdefault(assign(r[1][a : a + n], books[p])[1], []).append(r[1][a : a + n])
            for k, xs in members.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, v, lab in kept:
        got = [assign(v[a : a + n], books[p]) for p, (a, n) in enumerate(cuts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in got), sum(e for e, _ in got)))
    total: dict = {}
    for _, lab, _, e in out:
        total[lab] = total.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[lab], digest) for i, lab, c, e in out), key=str), digest


def got(df, **options) -> list[tuple]:
    return sorted(map(tuple, vc.compressed_digests(df, **options).collect()), key=str)


def vectors(seed: int, n: int, size: int, spread: float = 0.2) -> list[tuple]:
    r = random.Random(seed)
    hot = [r.gauss(0, spread) for _ in range(size)]
    rows = []
    for i in range(n):
        v = list(hot) if i % 3 == 0 else [r.gauss(0, spread) for _ in range(size)]
        if i % 5 == 0:
            v[: size // 4] = hot[: size // 4]
        rows.append((i * 3 + 1, v, r.choice([1, 2, 3, None])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("size,entries", [(16, 256), (16, 20), (10, 20)])
def test_against_plain_lloyd(spark, size, entries):
    rows = vectors(size + entries, 400, size)
    assert got(frame(spark, rows), entries=entries) == brute(rows, entries=entries)[0]


def test_odd_rows(spark):
    rows = vectors(1, 80, 8)
    odd = [(900, None, 1), (901, [], 1), (902, [0.1] * 7 + [None], 1), (903, [0.1] * 7 + [float("nan")], 2), (904, [float("inf")] + [0.0] * 7, 2), (905, [0.1] * 6, None), (906, [2e5] * 8, 1)]
    odd += [(None, [0.3] * 8, None), (None, [0.3] * 8, None), (None, [-0.3] * 8, 1), (1, [0.01] * 8, 1), rows[5], rows[5], (-4, [-0.0001, 0.0, 1e-9, -1e-9, 0.5, 0.25, -0.5, 1.0], 3)]
    assert got(frame(spark, rows + odd), entries=12) == brute(rows + odd, entries=12)[0]


def test_ties_go_to_the_first_entry_and_unused_ones_stay(spark):
    rows = [(i, [0.25] * 4, 1) for i in range(6)] + [(10, [-0.25] * 4, 1), (11, [0.0] * 4, None)]
    found = got(frame(spark, rows), entries=6)
    assert found == brute(rows, entries=6)[0]
    # all go to entry 0 at first, which moves away; entries 2 to 5 are never used
    assert {r[1] for r in found} == {"00000000", "01010101"}
    books = vc.compress(frame(spark, rows), entries=6)[1]
    assert all((b[1:] == 256).all() for b in books)


def test_large_components_are_summed_in_integers(spark):
    r = random.Random(4)
    rows = [(i, [r.uniform(-1.3e5, 1.3e5) for _ in range(8)], 1) for i in range(60)]
    x = np.array([[round(1024 * c) for c in v[:2]] for _, v, _ in rows])
    assert (float(np.abs(x).max()) * 2) ** 2 * 2 > vc.EXACT
    assert got(frame(spark, rows), entries=7) == brute(rows, entries=7)[0]


def test_nearest_in_both_kinds_of_arithmetic(monkeypatch):
    r = np.random.default_rng(1)
    x, book = r.integers(-50, 50, (500, 3)), r.integers(-50, 50, (40, 3))
    fast = vc.nearest(x, book)
    monkeypatch.setattr(vc, "EXACT", 0.0)
    slow = vc.nearest(x, book)
    assert all((a == b).all() for a, b in zip(fast, slow))


def test_codes_decode_near_their_vectors(spark):
    rows = vectors(7, 300, 8)
    found, books = vc.compress(frame(spark, rows))
    by_id = {i: v for i, v, _ in rows}
    for r in found.collect():
        away = sum((a - b) ** 2 for a, b in zip(by_id[r.vec_id], vc.decoded(r.code, books)))
        assert abs(math.sqrt(away) - math.sqrt(r.error) / 1024) < math.sqrt(8) / 1024


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    found = vc.compressed_digests(empty)
    assert found.collect() == [] and found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vc.compressed_digests(frame(spark, [(1, None, 1)])).collect() == []
