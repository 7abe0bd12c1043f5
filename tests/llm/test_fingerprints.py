import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import fingerprints as P


@pytest.mark.parametrize("window", [16, 8])
def test_entropy_of_every_window(window):
    r = random.Random(1)
    x = np.frombuffer(bytes(r.choice(b"aaaabcdefgh ijk") for _ in range(400)), np.uint8)
    got = P.entropy_classes(x, window)
    for i in range(len(x) - window + 1):
        c = Counter(x[i : i + window].tolist())
        h = -sum(n / window * math.log2(n / window) for n in c.values())
        assert abs(got[i] - h / math.log2(window) * 1000) <= 1


def ranks():
    return P.class_ranks(np.arange(P.CLASSES)[::-1] + 1)


def test_a_text_has_one_digest_whatever_stands_beside_it():
    r = random.Random(2)
    texts = [bytes(r.choice(b"etaoin shrdlu") for _ in range(n)) for n in (0, 1, 63, 64, 65, 300, 5000)]
    alone = [P.digests([t], ranks())[0] for t in texts]
    together = P.digests(texts[::-1] + texts, ranks())
    for a, b, c in zip(alone, together[: len(texts)][::-1], together[len(texts) :]):
        assert np.array_equal(a, b) and np.array_equal(a, c)
        assert P.likeness(a, b) == 1.0
    assert P.likeness(alone[0], alone[-1]) == 0.0


def test_likeness_orders_edits():
    r = random.Random(3)
    text = lambda n: bytes(r.choice(b"etaoin shrdlu,.") for _ in range(n))
    a = text(6000)
    own, half, tenth, other = P.digests([a, a[:3000] + text(3000), a[:5400] + text(600), text(6000)], ranks())
    assert P.likeness(own, tenth) > P.likeness(own, half) > 0.3 > 0.1 > P.likeness(own, other)


@pytest.mark.parametrize("n", [60, 100, 200, 400, 511, 513])
def test_short_texts_keep_likeness(n):
    r = random.Random(n)
    text = lambda k: bytes(r.choice(b"etaoin shrdlu,.") for _ in range(k))
    pairs = [(a := text(n), a[: n - n // 2] + text(n // 2), text(n)) for _ in range(40)]
    got = [(P.likeness(*P.digests([a, b], ranks())), P.likeness(*P.digests([a, c], ranks()))) for a, b, c in pairs]
    assert sum(near > far for near, far in got) >= 38


@pytest.mark.parametrize("ranges", [1, 5])
def test_edited_texts_and_neighbours(docs, texts, ranges):
    unique = docs.dropDuplicates(["doc_id"]).withColumn("doc_id", F.coalesce("doc_id", F.lit(500)))
    rows = sorted({(500 if i is None else i): t or "" for i, t, _, _ in texts}.items())
    got = {r.doc_id: r for r in P.fingerprinted(unique, ranges=ranges).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[1][:h]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1
        if t == edited:
            assert got[i].fingerprint == got[i].edited_fingerprint
        if t == after[1]:
            assert got[i].near_next == 1.0


def plain_chain(text, ranks):
    """One text, window by window: classes, elections, filters."""
    w = P.WINDOW
    level = []
    for i in range(len(text) - w + 1):
        c = Counter(text[i : i + w])
        full = int(P._F[w])
        level.append((full - sum(int(P._F[n]) for n in c.values())) * (P.CLASSES - 1) // full)
    votes = Counter()
    for first in range(-w + 1, len(level)):  # every run of w starts, those at the edges being short
        run = [(int(ranks[level[i]]), i) for i in range(max(0, first), min(len(level), first + w))]
        if run and min(run)[0] < P.CLASSES:
            votes[min(run)[1]] += 1
    chosen = sorted(i for i, n in votes.items() if n * 4 >= w) or ([0] if text else [])
    filters = [set() for _ in range(-(-len(chosen) // P.FEATURES))]
    for k, i in enumerate(chosen):
        window = np.frombuffer(text[i : i + w].ljust(w, b"\0"), np.uint8)
        code = int(P.window_codes(window, np.zeros(1, np.int64), w)[0])
        filters[k // P.FEATURES] |= {code >> 11 * h & P.FILTER_BITS - 1 for h in range(P.HASHES)}
    return filters


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if (len(a), sum(map(len, a))) > (len(b), sum(map(len, b))):
        a, b = b, a
    score = 0
    for x in a:
        best = -math.inf
        for y in b:
            chance = len(x) * len(y) / P.FILTER_BITS
            best = max(best, (len(x & y) - chance) / max(min(len(x), len(y)) - chance, 1e-9))
        score += len(x) * max(0, best)
    return min(1, score / sum(map(len, a)))


def test_query_matches_a_plain_digest(spark, texts):
    unique = {i: t or "" for i, t, _, _ in texts if i is not None and len(t or "") < 3000}
    rows = sorted(unique.items())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = sum(P.class_counts([t.encode()]) for _, t in rows)
    plain = Counter()
    for _, t in rows:
        raw = t.encode()
        for i in range(len(raw) - P.WINDOW + 1):
            c, full = Counter(raw[i : i + P.WINDOW]), int(P._F[P.WINDOW])
            plain[(full - sum(int(P._F[n]) for n in c.values())) * (P.CLASSES - 1) // full] += 1
    assert {k: n for k, n in enumerate(counts.tolist()) if n} == plain
    ranks = P.class_ranks(counts)
    got = {r.doc_id: r for r in P.fingerprinted(df, ranges=3).collect()}
    chains = [plain_chain(t.encode(), ranks) for _, t in rows]
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        h = len(t) // 2
        bits = np.unpackbits(np.frombuffer(base64.b64decode(got[i].fingerprint), np.uint8).reshape(-1, P.FILTER_BITS // 8), axis=1)
        assert [set(np.flatnonzero(b).tolist()) for b in bits] == chains[k], i
        assert got[i].near_next == pytest.approx(plain_likeness(chains[k], chains[(k + 1) % len(rows)]))
        assert got[i].near_edited == pytest.approx(plain_likeness(chains[k], plain_chain((t[: len(t) - h] + after[:h]).encode(), ranks)))


def test_repeated_rows_null_ids_and_empty_table(docs, empty, texts, spark):
    assert P.fingerprinted(docs, ranges=4).count() == len(texts)
    assert P.fingerprinted(empty).count() == 0
    one = P.fingerprinted(spark.createDataFrame([(None, "only one")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_texts_of_almost_one_byte_are_told_apart():
    """No window of these is selected; what follows their first 16 bytes counts all the same."""
    texts = [b"a" * 100, (b"a" * 16 + b"b") * 1000, (b"a" * 20 + b"c") * 3000, b"a" * 63_000, b"b" * 100]
    counts = P.class_counts(texts)
    a, b, c, long, other = P.digests(texts, P.class_ranks(counts), P.every_rank(counts))
    assert P.likeness(a, long) == 1.0  # one window throughout
    assert max(P.likeness(a, b), P.likeness(a, c), P.likeness(b, c), P.likeness(a, other)) < 1.0
    assert P.likeness(b, P.digests([texts[1] + texts[1]], P.class_ranks(counts), P.every_rank(counts))[0]) == 1.0
