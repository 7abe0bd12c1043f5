import random
import re
from itertools import combinations

import numpy as np
import xxhash

from tallyloom.llm import simhash
from tallyloom.llm.components import components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_classes(fps):
    ids = sorted(fps, key=lambda i: (i is None, i or 0))
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(ids, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            if x != y:
                lo, hi = sorted((x, y), key=ids.index)
                parent[hi] = lo
    return {i: find(i) for i in ids}


def test_fingerprints(texts):
    for _, t, _, _ in texts:
        assert simhash.fingerprint(t or "") == plain_fingerprint(t)


def test_classes_match_all_pairs(docs, texts):
    want = plain_classes({i: plain_fingerprint(t) for i, t, _, _ in texts})
    rows = simhash.near_classes(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.fp % (1 << 64) == plain_fingerprint(dict((i, t) for i, t, _, _ in texts)[r.id])
        assert r.component_id == want[r.id]


def test_position_sets_cover():
    for radius, width, count in ((4, 3, 20), (4, 4, 70), (4, 2, 28), (3, 3, 56)):
        sets = simhash.position_sets(radius, width)
        assert len(sets) == count
        assert all(any(set(s) <= set(left) for s in sets) for left in combinations(range(8), 8 - radius))


def test_links_of_random_balls_connect_what_is_near():
    r = random.Random(5)
    fps = set()
    for _ in range(30):
        base = r.getrandbits(64)
        for _ in range(r.choice([1, 3, 40])):
            x = base
            for _ in range(r.randint(0, 6)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    want = plain_classes(dict(enumerate(fps)))
    links = []
    for positions in simhash.position_sets(4, 3):
        keys = np.array([int.from_bytes(bytes(f >> 8 * p & 255 for p in positions), "big") for f in fps], np.int64)
        order = np.argsort(keys, kind="stable")
        links += simhash.postings_links(keys[order], np.array(fps, np.uint64)[order], 4, small=8).tolist()
    at = {f: i for i, f in enumerate(fps)}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert (a ^ b).bit_count() <= 4
        x, y = sorted((find(at[a]), find(at[b])))
        parent[y] = x
    assert {i: find(i) for i in range(len(fps))} == want


def test_count_filter_tallies_bytes():
    r = np.random.default_rng(3)
    x = r.integers(0, 256, (500, 8), np.uint8) * (r.random((500, 8)) < 0.5).astype(np.uint8)
    assert simhash.shared_bytes(x.view(np.uint64).ravel()).tolist() == (x == 0).sum(axis=1).tolist()


def test_long_lists_are_split_without_loss(spark):
    r = random.Random(9)
    fps = set()
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(r.randint(0, 5)):
                x ^= 1 << r.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    df = spark.createDataFrame([(f,) for f in sorted(fps)], "fp long")
    longest = lambda n: simhash.postings(df, long_list=n).groupBy("key").count().agg({"count": "max"}).first()[0]
    assert longest(5) < longest(1000)
    want = plain_classes({f: f % (1 << 64) for f in fps})
    for n in (5, 1000):
        got = {x.node: x.component for x in components(simhash.near_links(df, long_list=n)).collect()}
        groups = {}
        for f in fps:
            groups.setdefault(got.get(f, f), set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g for g in fps if want[g] == c) for c in set(want.values()))


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(100)] + [(1000, k) for k in range(1001, 1300)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(101)} | {k: 1000 for k in range(1000, 1300)}


def test_a_large_group_of_copies(spark):
    df = spark.range(2000).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'all of these are one and the same text', concat_ws(' ', id, id * 7, id * 13, id * 31, id * 17)) AS text")
    rows = simhash.near_classes(df).collect()
    assert sum(r.component_id == 0 for r in rows) == 1000 and len(rows) == 2000


def test_empty_table(empty):
    assert simhash.near_classes(empty).count() == 0
