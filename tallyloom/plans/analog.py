"""The engine's roles (places, visits, agencies, ...) derived from the star-schema tables.

Each role is one SELECT that Spark and DuckDB read alike, so that a query and its SQL start from the same rows.
"""

from __future__ import annotations

import datetime
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

AS_OF = datetime.date(2001, 11, 4)

ROLES = {
    "places": """
SELECT p_partkey AS id, p_name || ' ' || CAST(p_partkey AS STRING) AS name,
  CASE WHEN p_partkey % 50 = 7 THEN NULL ELSE p_brand END AS region, p_type AS category,
  CASE WHEN p_partkey % 13 = 5 THEN NULL ELSE p_brand || ' Street ' || CAST(p_size AS STRING) END AS road_address,
  CASE WHEN p_partkey % 19 = 3 THEN NULL ELSE 'Old ' || p_type || ' Lane' END AS jibun_address,
  CASE WHEN p_partkey % 11 = 2 THEN NULL ELSE 33e0 + (p_partkey % 1000) * 5e-3 END AS lat,
  CASE WHEN p_partkey % 11 = 2 THEN NULL ELSE 126e0 + (p_partkey * 7 % 1000) * 4e-3 END AS lng,
  p_partkey % 97 <> 1 AS valid_place, p_partkey % 89 <> 1 AS is_restaurant_like, p_size > 48 AS is_large_chain,
  CASE WHEN p_partkey % 101 = 4 THEN TIMESTAMP '2001-01-01 00:00:00' END AS hidden_at,
  CASE WHEN p_partkey % 103 = 4 THEN TIMESTAMP '2001-02-01 00:00:00' END AS deleted_at,
  CASE WHEN p_partkey % 202 = 4 THEN 'earlier' END AS hidden_reason,
  p_partkey % 17 = 0 AS is_closed, CASE WHEN p_partkey % 17 = 0 THEN TIMESTAMP '2000-05-05 00:00:00' END AS closed_at,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'k' || CAST(p_partkey AS STRING) END AS kakao_place_id,
  'n' || CAST(p_partkey AS STRING) AS natural_key
FROM part""",
    "visits": """
SELECT l_orderkey * 10 + l_linenumber AS visit_id, l_partkey AS place_id, l_suppkey AS agency_id, l_orderkey AS source_id,
  CAST(l_shipdate AS DATE) AS visit_date, CAST(floor(l_extendedprice) AS BIGINT) AS amount,
  CASE WHEN l_quantity >= 5 THEN CAST(floor(l_quantity / 5) AS INT) END AS party_size,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag || l_linestatus || CAST(l_linenumber AS STRING) END AS department_name,
  1e0 - l_discount * 4 AS confidence
FROM lineitem""",
    "agencies": """
SELECT s_suppkey AS id, s_name AS name, n_name AS parent_region, r_name AS upper_region,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 'tier' || CAST(s_suppkey % 4 AS STRING) END AS gov_tier,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'executive' ELSE 'council' END AS branch,
  'p' || CAST(s_suppkey % 4 + 1 AS STRING) AS expansion_phase,
  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'sub' || CAST(s_suppkey % 5 AS STRING) END AS sub_region,
  substring(s_name, 10, 9) AS short_name, CASE WHEN s_suppkey % 2 = 0 THEN 'city' ELSE 'gu' END AS kind,
  CASE WHEN s_suppkey % 8 = 0 THEN 'crawl_ready' WHEN s_suppkey % 8 < 5 THEN 'adapter_required' ELSE 'on_hold' END AS status
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "sources": """
SELECT o_orderkey AS id, o_custkey % 100 AS agency_id, o_orderpriority AS source_title, CAST(o_orderdate AS DATE) AS published_at,
  o_orderstatus AS file_kind, 'h' || CAST(o_orderkey % 5000 AS STRING) AS hash,
  CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE 's/' || CAST(o_orderkey AS STRING) END AS storage_path
FROM orders""",
    "regions": """
SELECT CAST(10 + r_regionkey AS STRING) AS adm_cd, 'sido' AS level, CAST(NULL AS STRING) AS parent_cd, r_name AS name FROM region
UNION ALL SELECT CAST(10000 + n_nationkey AS STRING), 'sigungu', CAST(10 + n_regionkey AS STRING), n_name FROM nation
UNION ALL SELECT DISTINCT CAST(10000000 + c_nationkey * 100 + c_custkey % 12 AS STRING), 'emd', CAST(10000 + c_nationkey AS STRING), 'D' || CAST(c_custkey % 12 AS STRING) FROM customer""",
    "metrics": """
SELECT CAST(10000000 + c_nationkey * 100 + c_custkey % 12 AS STRING) AS adm_cd, c_mktsegment AS metric_key, 0 AS household_size,
  CASE WHEN c_custkey % 3 = 0 THEN '2023' ELSE '2024' END AS ref_period,
  CASE WHEN max(c_custkey) % 29 = 0 THEN NULL ELSE floor(avg(c_acctbal)) END AS value
FROM customer GROUP BY 1, 2, 3, 4
UNION ALL SELECT CAST(10000000 + c_nationkey * 100 + c_custkey % 12 AS STRING), 'HOUSEHOLD', CAST(1 + c_custkey % 4 AS INT), '2024', CAST(count(*) AS DOUBLE)
FROM customer GROUP BY 1, 2, 3, 4""",
    "catalog": """
SELECT * FROM (VALUES ('AUTOMOBILE', 'convenience', 1), ('BUILDING', 'housing', 1), ('FURNITURE', 'education', -1),
  ('HOUSEHOLD', 'demographics', 1), ('MACHINERY', 'convenience', -1)) AS t(metric_key, category, direction)""",
    "weights": """
SELECT * FROM (VALUES (1, 1, 'convenience', 28), (1, 1, 'housing', 15), (1, 1, 'education', 5),
  (1, 2, 'convenience', 24), (1, 2, 'housing', 22), (1, 2, 'education', 8), (1, 3, 'convenience', 16), (1, 3, 'housing', 18), (1, 3, 'education', 22),
  (1, 4, 'convenience', 14), (1, 4, 'housing', 16), (1, 4, 'education', 24)) AS t(profile_version, household_size, category, weight)""",
    "reports": """
SELECT event_id AS report_id, event_id % 400 AS place_id, 'fp' || CAST(user_id % 7 AS STRING) AS reporter, ts AS reported_at FROM events WHERE event_type = 'error'""",
    "requests": """
SELECT event_id % 300 AS place_id, ts AS requested_at FROM events WHERE event_type = 'signup' AND event_id % 5 = 0""",
    "reactions": """
SELECT event_id % 500 AS place_id, user_id, CASE WHEN value > 20 THEN 'like' ELSE 'dislike' END AS reaction, ts AS changed_at, event_id AS seq
FROM events WHERE event_type = 'view'""",
    "posts": """
SELECT conv_id AS post_id, CASE conv_id % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'review' ELSE 'tip' END AS category,
  TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' HOUR AS created_at,
  CASE WHEN conv_id % 23 = 1 THEN TIMESTAMP '2024-02-01 00:00:00' END AS hidden_at, CAST(NULL AS TIMESTAMP) AS deleted_at, text AS body
FROM conversations WHERE turn = 0""",
    "comments": """
SELECT conv_id AS post_id, turn AS comment_id, TIMESTAMP '2024-01-01 00:00:00' + (conv_id + turn * 30) * INTERVAL '1' HOUR AS created_at,
  CASE WHEN (conv_id + turn) % 19 = 1 THEN TIMESTAMP '2024-03-01 00:00:00' END AS hidden_at, CAST(NULL AS TIMESTAMP) AS deleted_at
FROM conversations WHERE turn > 0""",
    "usage": """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'claude-haiku-4-5' WHEN 1 THEN 'gpt-5.5' WHEN 2 THEN 'gemini-2.5-flash' ELSE 'unlisted' END AS model,
  CAST(floor(value * 1000) AS BIGINT) AS tokens_in, CAST(floor(value * 100) AS BIGINT) AS tokens_out,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS thinking, ts AS created_at,
  CASE WHEN event_type = 'error' THEN 1 + CAST(event_id % 3 AS INT) ELSE 0 END AS status,
  CASE event_id % 5 WHEN 0 THEN 'legal_hold' WHEN 1 THEN 'adapter_hold' WHEN 2 THEN 'no_recent_data' WHEN 3 THEN 'unlisted' END AS hold,
  CASE event_id % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN 'unsupported_adapter' WHEN 2 THEN 'adapter_required' ELSE 'E' || CAST(event_id % 6 AS STRING) END AS code,
  CASE event_id % 8 WHEN 0 THEN 'Database constraint hit' WHEN 1 THEN 'HTTP 403 from host' WHEN 2 THEN 'R2 bucket missing' WHEN 3 THEN 'legal hold'
    WHEN 4 THEN 'Vision confidence low' WHEN 5 THEN 'no posts' WHEN 6 THEN 'kakao quota' ELSE 'odd' END AS message
FROM events""",
}
_BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def with_roles(sql: str, after: str = "") -> str:
    """sql with the roles that it uses as CTEs."""
    used = [r for r in ROLES if re.search(rf"\b{r}\b", sql + after)]
    ctes = [f"{r} AS ({ROLES[r]})" for r in used] + ([after] if after else [])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + sql


class Tables:
    """The roles, and the tables they come from, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, role: str) -> DataFrame:
        if role in _BASE:
            return self.base(role)
        if role not in ROLES:
            raise AttributeError(role)
        sql = ROLES[role]
        used = {t: self.base(t) for t in _BASE if re.search(rf"(?:FROM|JOIN) {t}\b", sql)}
        for t in used:
            sql = re.sub(rf"((?:FROM|JOIN) ){t}\b", rf"\1{{{t}}}", sql)
        return self.spark.sql(sql, **used)

    @cached_property
    def grades(self) -> DataFrame:
        from tallyloom.operators.grading import place_grade

        return place_grade(self.places, self.visits, AS_OF)

    @cached_property
    def public(self) -> DataFrame:
        from tallyloom.operators.grading import places_public

        return places_public(self.places, self.grades)


SHOWN = "hidden_at IS NULL AND deleted_at IS NULL AND valid_place AND is_restaurant_like AND NOT is_large_chain"
#: CTEs of the marts, for the SQL of queries above them.
GRADES = f"""
agg AS (SELECT v.place_id, p.region, count(*) AS visit_count, count(DISTINCT department_name) AS department_count, count(DISTINCT agency_id) AS agency_count,
    min(visit_date) AS first_visit_at, max(visit_date) AS last_visit_at
  FROM visits v JOIN places p ON p.id = v.place_id WHERE visit_date >= DATE '2000-11-04' AND {SHOWN} GROUP BY 1, 2),
scored AS (SELECT *, CAST(visit_count * log10(department_count + 1) AS DECIMAL(10, 4)) AS score, count(*) OVER (PARTITION BY region) AS region_places FROM agg),
ranked AS (SELECT *, CASE WHEN region_places >= 30 THEN percent_rank() OVER (PARTITION BY region ORDER BY score) ELSE percent_rank() OVER (ORDER BY score) END AS pct FROM scored),
grades AS (SELECT place_id, region, visit_count, department_count, agency_count, first_visit_at, last_visit_at, score, region_places, pct,
  CASE WHEN visit_count <= 2 AND first_visit_at >= DATE '2001-08-04' THEN '✦' WHEN pct >= 0.90 THEN '★★★' WHEN pct >= 0.70 THEN '★★' WHEN pct >= 0.40 THEN '★' END AS grade FROM ranked)"""
PUBLIC = f"""{GRADES},
public AS (SELECT p.id, p.name, p.region, p.category, p.road_address, p.lat, p.lng, p.is_closed, coalesce(g.score, 0)::DECIMAL(10, 4) AS score,
  coalesce(g.grade, '✦') AS grade, coalesce(g.visit_count, 0) AS visit_count, g.last_visit_at
  FROM places p LEFT JOIN grades g ON g.place_id = p.id WHERE {SHOWN})"""
FIELDS = """
latest AS (SELECT adm_cd, metric_key, arg_max(value, ref_period) AS value FROM metrics WHERE household_size = 0 AND value IS NOT NULL GROUP BY 1, 2),
norm AS (SELECT l.adm_cd, r.parent_cd, c.category, CASE WHEN direction = 1 THEN percent_rank() OVER w ELSE 1 - percent_rank() OVER w END * 100 AS mscore
  FROM latest l JOIN catalog c ON c.metric_key = l.metric_key JOIN regions r ON r.adm_cd = l.adm_cd AND r.level = 'emd'
  WINDOW w AS (PARTITION BY r.parent_cd, l.metric_key ORDER BY l.value)),
field AS (SELECT adm_cd, parent_cd, category, avg(mscore) AS raw, count(*) AS metric_count FROM norm GROUP BY 1, 2, 3)"""
FIELD_SCORES = f"""{FIELDS},
field_scores AS (SELECT adm_cd, parent_cd, category, round(raw::DECIMAL(20, 10), 2)::DOUBLE AS field_score, metric_count,
  rank() OVER (PARTITION BY parent_cd, category ORDER BY raw DESC) AS rank_in_sigungu, count(*) OVER (PARTITION BY parent_cd, category) AS sigungu_count FROM field)"""
COMPOSITE = f"""{FIELD_SCORES},
comp AS (SELECT adm_cd, parent_cd, profile_version, household_size, sum(weight * raw) / nullif(sum(weight), 0) AS raw, count(*) AS field_count
  FROM field JOIN weights USING (category) GROUP BY 1, 2, 3, 4),
composite AS (SELECT adm_cd, parent_cd, profile_version, household_size, round(raw::DECIMAL(20, 10), 2)::DOUBLE AS score, field_count,
  rank() OVER w AS rank_in_sigungu, count(*) OVER (PARTITION BY parent_cd, profile_version, household_size) AS sigungu_emd_count
  FROM comp WINDOW w AS (PARTITION BY parent_cd, profile_version, household_size ORDER BY raw DESC))"""
