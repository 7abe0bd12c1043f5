"""Stateful streams against their batch twins, in several batchings, across restarts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import merge, versions
from tallyloom.streaming import stateful, streams

START = datetime(2026, 3, 1)


@pytest.fixture
def store(spark):
    old = {k: spark.conf.get(k, None) for k in (*stateful.STATE_STORE, "spark.sql.shuffle.partitions")}
    for k, v in (stateful.STATE_STORE | {"spark.sql.shuffle.partitions": "2"}).items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def fed(spark, tmp_path, batches, schema, make, name, sink):
    """Runs a stream over batches, restarted for each, on one checkpoint."""
    source = tmp_path / f"{name}-in"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        streams.run_available(make(spark.readStream.schema(schema).parquet(str(source))), sink, f"{tmp_path}/{name}-state", "update" if name.startswith("closure") else "append")


def test_policies_side_by_side_in_any_batching(spark, tmp_path, store):
    r = random.Random(3)
    names = [*stateful.POLICIES, "unknown"]
    events, at = [], START
    for k in range(400):
        at += timedelta(seconds=r.choice([0, 1, 5, 40, 600]))
        events.append((k, r.choice(names[:3] if k % 2 else names), f"u{r.randint(0, 1)}", at))
    schema = "event_id long, policy string, key string, ts timestamp"
    want = sorted(map(tuple, stateful.decided(spark.createDataFrame(events, schema)).collect()))
    assert {w[5] for w in want} == {True, False}
    for name, cuts in (("one", [400]), ("some", [37, 180, 400])):
        parts = [events[a:b] for a, b in zip([0, *cuts], cuts)]
        out = str(tmp_path / f"{name}-out")
        fed(spark, tmp_path, parts, schema, stateful.admission_stream, name, out)
        assert sorted(map(tuple, spark.read.parquet(out).collect())) == want


def test_windows_end_and_late_requests(spark, tmp_path, store):
    schema = "event_id long, policy string, key string, ts timestamp"
    row = lambda k, s: (k, "auth.register.post", "u", START + timedelta(seconds=s))
    out = str(tmp_path / "late-out")
    fed(spark, tmp_path, [[row(k, k) for k in range(6)], [row(6, 3600), row(7, 30)], [row(8, 40_000)], [row(9, 50)]], schema, stateful.admission_stream, "late", out)
    got = {r.event_id: (r.allowed, r.remaining) for r in spark.read.parquet(out).collect()}
    assert got[4] == (True, 0) and got[5] == (False, 0) and got[6] == (True, 4) and got[7] == (False, 0) and got[8] == (True, 4)
    assert 9 not in got  # behind the watermark


REPORTS = "place_id long, reporter string, reported_at timestamp"


def test_closure_equals_the_batch_in_any_batching(spark, tmp_path, store):
    r = random.Random(5)
    reports = [(r.randint(1, 6), f"r{r.randint(0, 4)}", START + timedelta(hours=r.randint(0, 400))) for _ in range(60)]
    places = spark.range(1, 8).select("id", F.lit(False).alias("is_closed"), F.lit(None).cast("timestamp").alias("closed_at"))
    want = {s.id: (s.closure_report_count, s.is_closed, s.closed_at) for s in merge.closure_state(places, spark.createDataFrame(reports, REPORTS)).collect() if s.closure_report_count}
    assert {w[1] for w in want.values()} == {True, False} or all(w[1] for w in want.values())
    for name, cuts in (("closure-one", [60]), ("closure-some", [1, 9, 33, 60])):
        path = f"{tmp_path}/{name}-states"
        fed(spark, tmp_path, [reports[a:b] for a, b in zip([0, *cuts], cuts)], REPORTS, stateful.closure_states, name, versions.sink(path, name, stateful.with_states))
        assert {s.place_id: (s.closure_report_count, s.is_closed, s.closed_at) for s in versions.read(spark, path).collect()} == want


def test_open_places_forget(spark, tmp_path, store):
    day = lambda d: START + timedelta(days=d)
    path = f"{tmp_path}/states"
    batches = [[(1, "a", day(0)), (1, "b", day(0)), *[(2, x, day(0)) for x in "abc"]], [(3, "a", day(90))], [(1, "c", day(91))]]
    make = lambda df: stateful.closure_states(df, late="1 day", forget_after=30 * 86_400)
    fed(spark, tmp_path, batches, REPORTS, make, "closure-forget", versions.sink(path, "s", stateful.with_states))
    got = {s.place_id: (s.closure_report_count, s.is_closed) for s in versions.read(spark, path).collect()}
    assert got == {1: (1, False), 2: (3, True), 3: (1, False)}
