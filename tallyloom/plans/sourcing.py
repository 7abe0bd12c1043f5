"""Queries of the source registry and the collecting side's reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import sourcing
from tallyloom.plans.registry import query

_PATTERNS = """pat AS (SELECT id, expansion_phase, CASE id % 6 WHEN 0 THEN '{"adapter":"adapter_required","hold":"legal_hold"}' WHEN 1 THEN '{"adapter":"adapter_required"}' WHEN 2 THEN '{"adapter":"inline_table","listUrl":"u","verifiedAt":"2026","verifiedBy":"x"}'
  WHEN 3 THEN '{"adapter":"inline_table","verifiedAt":"2026","verifiedBy":"x"}' WHEN 4 THEN '{"adapter":"city_portal"}' ELSE '{"note":"none"}' END AS p FROM agencies)"""
_STATUS = "CASE id % 6 WHEN 0 THEN 'legal_hold' WHEN 1 THEN 'pending' WHEN 2 THEN 'verified_in_code' ELSE 'invalid_source_pattern' END"


def _patterns(t):
    return t.spark.sql(_PATTERNS.split("pat AS (", 1)[1][:-1].replace("FROM agencies", "FROM {agencies}").replace('{"', '{{"').replace('"}', '"}}'), agencies=t.agencies)


@query("source_registry_status", f"SELECT id, {_STATUS} AS verification_status FROM pat", _PATTERNS)
def source_registry_status(t):
    return _patterns(t).select("id", sourcing.verification_status(F.col("p")).alias("verification_status"))


@query(
    "source_registry_summary",
    "SELECT coalesce(g, 'all') AS priority_group, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE s = '{s}') AS {s}" for s in sourcing.STATUSES) + f" FROM (SELECT expansion_phase AS g, {_STATUS} AS s FROM pat) GROUP BY ROLLUP (g)",
    _PATTERNS,
)
def source_registry_summary(t):
    return sourcing.registry_summary(_patterns(t).withColumn("verification_status", sourcing.verification_status(F.col("p"))))


@query(
    "batch_run_summary",
    """SELECT count(*) AS total, count(*) FILTER (WHERE r = 'success') AS success, count(*) FILTER (WHERE r = 'adapter_required') AS adapter_required, count(*) FILTER (WHERE r = 'unsupported') AS unsupported, count(*) FILTER (WHERE r = 'config_error') AS config_error,
  count(*) FILTER (WHERE r = 'failed') AS failed, sum(id % 7)::BIGINT AS posts_seen, sum(id % 5)::BIGINT AS posts_fetched, sum(id % 11)::BIGINT AS raw_parsed_rows, sum(id % 9)::BIGINT AS parsed_rows, sum(id % 13)::BIGINT AS normalized_visits, sum(id % 3)::BIGINT AS places_seen,
  sum(id % 2)::BIGINT AS kakao_matched_places, sum(id % 6)::BIGINT AS loaded_sources, sum(id % 8)::BIGINT AS loaded_places, sum(id % 4)::BIGINT AS loaded_visits, sum(id % 10)::BIGINT AS skipped_invalid_places,
  count(*) FILTER (WHERE r IN ('unsupported', 'config_error', 'failed')) = 0 AS ok, 'timeout=' || count(*) FILTER (WHERE r = 'failed') AS failure_reasons FROM (SELECT id, CASE id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'adapter_required' ELSE 'failed' END AS r FROM agencies)""",
)
def batch_run_summary(t):
    result = F.when(F.col("id") % 4 == 0, "success").when(F.col("id") % 4 == 1, "adapter_required").otherwise("failed")
    n = dict(zip(sourcing.COUNTERS, (7, 5, 11, 9, 13, 3, 2, 6, 8, 4, 10)))
    runs = t.agencies.select(result.alias("result"), F.when(result == "failed", "timeout").alias("failure_reason"), *[(F.col("id") % k).alias(c) for c, k in n.items()])
    s = sourcing.run_summary(runs)
    return s.withColumn("failure_reasons", F.array_join(F.transform(F.map_entries("failure_reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query(
    "provider_attempts",
    """SELECT event_id, CASE WHEN coalesce(max(CAST(good OR fatal AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'not_called' WHEN cost > 25 THEN 'budget' WHEN good THEN 'accepted' WHEN fatal THEN 'stopped' WHEN ok THEN 'low_confidence' ELSE 'retried' END AS state
FROM (SELECT *, ok AND c >= 0.8 AND cost <= 25 AS good, NOT ok AND event_id % 7 = 0 AS fatal FROM (SELECT event_id, user_id, event_id % 3 <> 0 AS ok, CASE WHEN event_id % 40 < 39 THEN 0.5 ELSE 0.9 END AS c, value AS cost FROM events))""",
)
def provider_attempts(t):
    e = F.col("event_id")
    a = t.events.select("event_id", F.col("user_id").alias("task_id"), e.alias("seq"), (e % 3 != 0).alias("ok"), (e % 7 != 0).alias("retryable"), F.when(e % 40 < 39, 0.5).otherwise(0.9).alias("mean_confidence"), F.col("value").alias("cost"), F.lit(25.0).alias("budget_left"))
    return sourcing.first_good_attempt(a, 0.8).select("event_id", "state")


@query("posts_page", "SELECT id, published_at FROM sources ORDER BY id LIMIT 25 OFFSET 50")
def posts_page(t):
    return sourcing.paged(t.sources.select("id", "published_at"), "id", 50, 25)


@query("refs_last_wins", "SELECT hash, arg_max(id, id) AS id, arg_max(source_title, id) AS source_title FROM sources GROUP BY 1")
def refs_last_wins(t):
    return sourcing.last_by_key(t.sources.select("hash", "id", "source_title"), "hash", "id")


@query("rows_first_wins", "SELECT agency_id, file_kind, published_at, min(id) AS id FROM sources GROUP BY 1, 2, 3")
def rows_first_wins(t):
    return sourcing.first_rows(t.sources.select("agency_id", "file_kind", "published_at", "id"), ["agency_id", "file_kind", "published_at"], "id")


@query("agency_scope", "SELECT id FROM agencies WHERE upper_region IN ('ASIA', 'EUROPE')")
def agency_scope(t):
    return t.agencies.withColumn("parent_region", F.col("upper_region")).where(sourcing.in_scope("east", {"east": ("ASIA", "EUROPE")})).select("id")


@query("lens_colours", "SELECT adm_cd, metric_key, ref_period, 'hsl(173,58%,' || CAST(round_even(86 - 50 * p, 0) AS INT) || '%)' AS colour FROM (SELECT adm_cd, metric_key, ref_period, percent_rank() OVER (PARTITION BY metric_key, ref_period ORDER BY value) AS p FROM metrics WHERE household_size = 0 AND value IS NOT NULL)")
def lens_colours(t):
    from pyspark.sql.window import Window

    m = t.metrics.where("household_size = 0 AND value IS NOT NULL").withColumn("p", F.percent_rank().over(Window.partitionBy("metric_key", "ref_period").orderBy("value")))
    return m.select("adm_cd", "metric_key", "ref_period", sourcing.lens_colour(F.col("p")).alias("colour"))
