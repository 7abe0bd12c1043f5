"""A cache of answers from outside, such as a geocoder's, as a table of versions: what is asked, what is known, for how long.

A run looks up its keys, has the open ones asked once each, and puts the answers back. The table is a log of small
additions: each version holds one more folder of rows, so a run rewrites nothing; ``compacted`` folds the log into one row
per key and lets expired rows go. Two runs at once may both ask a key; the later answer counts.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import versions

DAYS = 7
SCHEMA = "query_key string, answer string, created_at timestamp"


def known(spark: SparkSession, path: str, now: datetime, days: int = DAYS) -> DataFrame:
    """(query_key, answer, created_at) of keys whose last answer is not older than so many days. An answer may be NULL: nothing was found."""
    version = versions.current(spark, path)
    if not version.number:
        return spark.createDataFrame([], SCHEMA)
    rows = versions.read(spark, path, version).where(F.col("created_at") > F.lit(now) - F.make_dt_interval(F.lit(days)))
    last = rows.groupBy("query_key").agg(F.max_by(F.struct("answer", "created_at"), F.struct("created_at", "answer")).alias("a"))
    return last.select("query_key", "a.answer", "a.created_at")


def open_keys(queries: DataFrame, answered: DataFrame) -> DataFrame:
    """The distinct keys of queries without an answer; a NULL key is none."""
    keys = queries.where(F.col("query_key").isNotNull()).groupBy("query_key").agg(F.count(F.lit(1)).alias("times"))
    return keys.join(answered.select("query_key"), "query_key", "left_anti").select("query_key")


def looked_up(queries: DataFrame, path: str, ask: Callable[[DataFrame], DataFrame], now: datetime, days: int = DAYS) -> DataFrame:
    """queries with answer and created_at, after what was open has been asked and put into the cache.

    ask: (query_key) to (query_key, answer), called once with the distinct open keys; keys that it leaves out stay open.
    """
    spark = queries.sparkSession
    before = known(spark, path, now, days)
    asked = ask(open_keys(queries, before)).select(F.col("query_key").cast("string"), F.col("answer").cast("string"), F.lit(now).cast("timestamp").alias("created_at"))
    added(spark, path, asked)
    return queries.join(known(spark, path, now, days), "query_key", "left")


def added(spark: SparkSession, path: str, rows: DataFrame) -> versions.Version:
    """One more version, with rows beside those that are there. The rows are computed and written once, whoever else commits meanwhile."""
    return versions.append(rows.select("query_key", "answer", "created_at"), path)


def compacted(spark: SparkSession, path: str, now: datetime, days: int = DAYS) -> versions.Version:
    """A version of one row per key that is still known, in place of the log."""
    return versions.update(spark, path, lambda _: known(spark, path, now, days))
