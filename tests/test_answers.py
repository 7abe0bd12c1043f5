"""The cache of answers: every open key is asked once, known ones are not, expired ones are again."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyloom.operators import answers, versions

NOW = datetime(2026, 5, 1)


class Geocoder:
    """Answers what it knows; remembers what it was asked."""

    def __init__(self, leaves_out=()):
        self.asked, self.leaves_out = [], leaves_out

    def __call__(self, keys):
        self.asked += [r.query_key for r in keys.collect()]
        return keys.where(~F.col("query_key").isin(*self.leaves_out, "-")).select("query_key", F.when(F.col("query_key") != "nowhere", F.concat(F.lit("at "), "query_key")).alias("answer"))


def run(spark, path, keys, day, ask):
    queries = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "query_key string, n int")
    got = answers.looked_up(queries, path, ask, NOW + timedelta(days=day))
    return sorted(((r.n, r.answer) for r in got.collect()))


def test_each_key_is_asked_once(spark, tmp_path):
    path, ask = f"{tmp_path}/cache", Geocoder()
    keys = ["a", "b", "a", None, "nowhere", "a"]
    want = [(0, "at a"), (1, "at b"), (2, "at a"), (3, None), (4, None), (5, "at a")]
    assert run(spark, path, keys, 0, ask) == want and sorted(ask.asked) == ["a", "b", "nowhere"]
    assert run(spark, path, keys, 3, ask) == want and len(ask.asked) == 3  # nothing found is an answer, too
    assert run(spark, path, ["c", "a"], 5, ask) == [(0, "at c"), (1, "at a")] and ask.asked[3:] == ["c"]


def test_expired_keys_and_keys_left_out(spark, tmp_path):
    path, ask = f"{tmp_path}/cache", Geocoder(leaves_out=("b",))
    assert run(spark, path, ["a", "b"], 0, ask) == [(0, "at a"), (1, None)]
    run(spark, path, ["b", "c"], 6, ask)
    assert ask.asked[2:] in (["b", "c"], ["c", "b"])  # b is still open
    run(spark, path, ["a", "c"], 7, ask)
    assert ask.asked[4:] == ["a"]  # seven days old; c is one
    kept = answers.compacted(spark, path, NOW + timedelta(days=12))
    assert [r.query_key for r in versions.read(spark, path, kept).orderBy("query_key").collect()] == ["a", "c"] and len(kept.folders) == 1
    run(spark, path, ["a", "c"], 12.5, ask)
    assert ask.asked[5:] == []


def test_a_run_only_adds(spark, tmp_path):
    path, ask = f"{tmp_path}/cache", Geocoder()
    for k in range(3):
        run(spark, path, [f"k{k}"], k, ask)
    assert len(versions.current(spark, path).folders) == 3 and len(list((tmp_path / "cache/data").iterdir())) == 3
    assert answers.known(spark, path, NOW + timedelta(days=3)).count() == 3
    assert answers.known(spark, f"{tmp_path}/none", NOW).count() == 0
