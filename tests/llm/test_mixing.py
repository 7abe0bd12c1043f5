import re
from collections import Counter, defaultdict

import pytest

from tallyloom.llm.mixing import emit_copies, mixed, mixing_summary


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    budget, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        share = {s: budget * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
            free.remove(s)
    return target


def test_targets_and_bounds(docs, texts):
    sizes = defaultdict(int)
    for _, t, _, s in texts:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    want = plain_targets(dict(sizes))
    source = {i: s for i, _, _, s in texts}
    rows = mixing_summary(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size
    assert sorted(rows, key=str) == sorted(mixing_summary(docs.repartition(7)).collect(), key=str)


def test_large_sources_come_near(spark):
    df = spark.range(20000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 50 AS INT)) AS text", "concat('s', IF(id % 3 = 0, 0, id % 20)) AS source")
    got = mixing_summary(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "first"}).collect()
    for r in got:
        assert r["sum(taken)"] == pytest.approx(r["first(target)"], rel=0.1)


def test_copies_keep_columns_and_counts(docs):
    mix = mixed(docs)
    out = emit_copies(mix)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in ((r.id, r.n) for r in mix.groupBy("id").agg({"copies": "sum"}).toDF("id", "n").collect()) if v})


def test_empty_table_and_no_words(empty, docs):
    assert mixing_summary(empty).count() == 0
    assert {r.taken for r in mixing_summary(docs.where("doc_id IN (1, 2, 3)")).collect()} == {0}


def test_rows_without_an_id_draw_by_their_text(spark):
    df = spark.range(3000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('word ', id) AS text", "concat('s', id % 3) AS source")
    rows = mixing_summary(df).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r.target] += r.taken
        target[r.target] = sorted({*target.get(r.target, ()), r.taken})
    assert len(rows) == 3000 and sorted(target.values()) == [[0, 2], [2, 4], [4]]
    assert all(n == pytest.approx(t, rel=0.1) for t, n in taken.items())
    assert sorted(rows, key=str) == sorted(mixing_summary(df.repartition(5)).collect(), key=str)
