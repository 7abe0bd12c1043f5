"""Streams that keep state per key: the admission of single requests, and places that close after enough reports.

Both need the RocksDB state store (``STATE_STORE``). State lives with Spark's checkpoints, so a lost executor or a
restart goes on where the last batch ended; timers on event time let go of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from tallyloom.streaming.streams import window_end

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

#: Requests allowed per window, and the window's seconds, by the request's kind.
POLICIES = {
    "auth.login.post": (10, 60),
    "auth.register.post": (5, 3600),
    "auth.me.get": (30, 60),
    "takedown-request.post": (5, 3600),
    "closure-report.post": (20, 3600),
    "community.posts.post": (10, 3600),
    "community.comments.post": (30, 3600),
    "v1.places.reactions.post": (60, 60),
}
Decision = Row("event_id", "policy", "key", "micros", "limit", "allowed", "remaining", "reset_at")
State = Row("place_id", "closure_report_count", "is_closed", "closed_micros")


# ---- admission of requests ------------------------------------------------------------------------


def decided(events: DataFrame, policies: dict[str, tuple[int, int]] = POLICIES) -> DataFrame:
    """Batch: (event_id, policy, key, ts) with limit, allowed, remaining, reset_at (epoch seconds). Events of an unknown policy are let
    through without a limit."""
    table = F.create_map(*[x for name, (limit, width) in policies.items() for x in (F.lit(name), F.struct(F.lit(limit).alias("limit"), F.lit(width).alias("width")))])
    known = events.withColumn("p", F.try_element_at(table, F.col("policy")))
    known = known.withColumn("reset_at", window_end(F.col("ts"), F.col("p.width")))
    nth = F.row_number().over(Window.partitionBy("policy", "key", "reset_at").orderBy("ts", "event_id"))
    counted = known.withColumn("nth", nth)
    return counted.select(
        "event_id",
        "policy",
        "key",
        "ts",
        F.col("p.limit").alias("limit"),
        F.coalesce(F.col("nth") <= F.col("p.limit"), F.lit(True)).alias("allowed"),
        F.when(F.col("p").isNotNull(), F.greatest(F.col("p.limit") - F.col("nth"), F.lit(0))).alias("remaining"),
        "reset_at",
    )


class Admission(StatefulProcessor):
    """Per policy and key: how many requests each open window has let in. A window is forgotten when the watermark passes its end."""

    def __init__(self, policies: dict[str, tuple[int, int]]):
        self.policies = policies

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "reset_at long", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        policy, who = key
        limit, width = self.policies.get(policy, (None, None))
        held: dict[int, int] = {}
        for r in sorted(rows, key=lambda r: (r.micros, r.event_id)):
            if limit is None:
                yield Decision(r.event_id, policy, who, r.micros, None, True, None, None)
                continue
            reset_at = r.micros // (width * 1_000_000) * width + width
            if reset_at not in held:
                held[reset_at] = self.counts.getValue((reset_at,))[0] if self.counts.containsKey((reset_at,)) else 0
                self.handle.registerTimer(reset_at * 1000)
            held[reset_at] = n = min(held[reset_at] + 1, limit + 1)
            yield Decision(r.event_id, policy, who, r.micros, limit, n <= limit, max(limit - n, 0), reset_at)
        for reset_at, n in held.items():
            self.counts.updateValue((reset_at,), (n,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ended = (expiredTimerInfo.getExpiryTimeInMs() // 1000,)
        if self.counts.containsKey(ended):
            self.counts.removeKey(ended)
        return iter([])

    def close(self) -> None:
        pass


def admission_stream(events: DataFrame, policies: dict[str, tuple[int, int]] = POLICIES, late: str = "10 minutes") -> DataFrame:
    """Stream of (event_id, policy, key, ts): every event's decision, in the batch in which it arrives.

    Within a batch events are taken in order of time and id. Where batches follow each other in time, the decisions are those
    of ``decided``, however the events are cut into batches. An event later than the watermark is dropped undecided.
    """
    schema = "event_id long, policy string, key string, micros long, `limit` int, allowed boolean, remaining int, reset_at long"
    keyed = events.select(F.col("event_id").cast("long"), "policy", "key", "ts", F.unix_micros("ts").alias("micros")).withWatermark("ts", late).groupBy("policy", "key")
    out = keyed.transformWithState(Admission(policies), schema, "Append", "EventTime")
    return out.select("event_id", "policy", "key", F.timestamp_micros("micros").alias("ts"), "limit", "allowed", "remaining", "reset_at")


# ---- closure of places ----------------------------------------------------------------------------


class Closure(StatefulProcessor):
    """Per place: the first report of each reporter. The place closes with the threshold-th of them, at that report's time.

    A reporter's earlier report may still arrive; the time of closure then moves with it, as it would if all reports were read at once.
    """

    def __init__(self, threshold: int, forget_after: int | None):
        self.threshold, self.forget_after = threshold, forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getMapState("first", "reporter string", "at long")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = 0
        for r in rows:
            reporter = (r.reporter or "",)
            known = self.first.getValue(reporter)[0] if self.first.containsKey(reporter) else None
            if known is None or r.micros < known:
                self.first.updateValue(reporter, (r.micros,))
            last = max(last, r.micros)
        if self.forget_after is not None:
            due = last // 1000 + self.forget_after * 1000
            before = self.timer.get()[0] if self.timer.exists() else None
            if before is None or due > before:
                if before is not None:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(due)
                self.timer.update((due,))
        times = sorted(at[0] for _, at in self.first.iterator())
        closed = len(times) >= self.threshold
        yield State(key[0], len(times), closed, times[self.threshold - 1] if closed else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.first.exists() and len(list(self.first.keys())) < self.threshold:  # a closed place stays closed
            self.first.clear()
            self.timer.clear()
            yield State(key[0], 0, False, None)

    def close(self) -> None:
        pass


def closure_states(reports: DataFrame, threshold: int = 3, late: str = "30 days", forget_after: int | None = None) -> DataFrame:
    """Stream of (place_id, reporter, reported_at) to a place's new state whenever reports arrive: (place_id, closure_report_count,
    is_closed, closed_at), to be merged into the snapshot by place.

    forget_after: seconds without a report after which an open place's reports no longer count; by default they always do.
    State is a row per place and reporter.
    """
    schema = "place_id long, closure_report_count long, is_closed boolean, closed_micros long"
    rows = reports.select(F.col("place_id").cast("long"), "reporter", "reported_at", F.unix_micros("reported_at").alias("micros")).withWatermark("reported_at", late)
    out = rows.groupBy("place_id").transformWithState(Closure(threshold, forget_after), schema, "Update", "None" if forget_after is None else "EventTime")
    return out.select("place_id", "closure_report_count", "is_closed", F.timestamp_micros("closed_micros").alias("closed_at"))


def with_states(places: DataFrame | None, states: DataFrame) -> DataFrame:
    """The merge of a batch of states into the kept ones: the new state of a place wins."""
    if places is None:
        return states
    return places.join(states.select("place_id"), "place_id", "left_anti").unionByName(states)
