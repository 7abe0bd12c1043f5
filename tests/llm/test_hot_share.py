from __future__ import annotations

import random

from tallyloom.llm import longest_previous as lp
from tests.llm.test_longest_previous import brute, got


def test_strings_of_a_minimiser_stay_bounded_as_texts_grow():
    for size in (10**8, 10**9, 6 * 10**9, 3 * 10**10):
        for parts in (1, 12, 200):
            assert lp.share_of_hot(size, parts) * lp.STRING_BYTES * size <= lp.LONE_BYTES * 1.001
    assert lp.share_of_hot(0, 4) == lp.share_of_hot(1000, 4) == 1 / 16


def test_many_hot_minimisers_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lp, "LONE_BYTES", 64)
    r = random.Random(5)
    passages = ["".join(r.choices("abcd ", k=120)) for _ in range(3)]
    rows = [(k, r.choice(passages) + "".join(r.choices("abcd ", k=40)) + r.choice(passages)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs) == brute(rows)
