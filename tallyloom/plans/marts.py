"""Queries of the two marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import grading, livability
from tallyloom.plans.analog import AS_OF, COMPOSITE, FIELD_SCORES, FIELDS, GRADES, PUBLIC, SHOWN
from tallyloom.plans.registry import query


@query("place_grade", "SELECT * FROM grades", GRADES)
def place_grade(t):
    return t.grades


@query("place_grade_small_region", "SELECT * FROM grades", GRADES.replace("p.region,", "p.region || p.category AS region,"))
def place_grade_small_region(t):
    """Finer regions, most of them below the size from which they are ranked on their own."""
    return grading.place_grade(t.places.withColumn("region", F.concat("region", "category")), t.visits, AS_OF)


@query(
    "agency_stats",
    f"""SELECT a.id AS agency_id, count(v.visit_id) FILTER (WHERE p.id IS NOT NULL) AS visit_count, count(DISTINCT v.place_id) FILTER (WHERE p.id IS NOT NULL) AS place_count,
  max(v.visit_date) FILTER (WHERE p.id IS NOT NULL) AS last_visit_at
FROM agencies a LEFT JOIN visits v ON v.agency_id = a.id LEFT JOIN (SELECT * FROM places WHERE {SHOWN}) p ON p.id = v.place_id GROUP BY a.id""",
)
def agency_stats(t):
    return grading.agency_stats(t.agencies, t.visits, t.places)


@query("places_public", "SELECT * FROM public", PUBLIC)
def places_public(t):
    return t.public


@query(
    "place_visits_public",
    f"""SELECT v.visit_id, v.place_id, p.name AS place_name, v.agency_id, a.name AS agency_name, a.parent_region, v.visit_date, v.amount, v.party_size, v.department_name, s.source_title
FROM visits v JOIN places p ON p.id = v.place_id JOIN sources s ON s.id = v.source_id JOIN agencies a ON a.id = v.agency_id WHERE {SHOWN.replace('hidden_at', 'p.hidden_at')}""",
)
def place_visits_public(t):
    return grading.place_visits_public(t.visits, t.places, t.sources, t.agencies)


@query("grade_distribution", "SELECT grade, count(*) AS n FROM public GROUP BY 1", PUBLIC)
def grade_distribution(t):
    return t.public.groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


@query("latest_metric", "SELECT * FROM latest", FIELDS)
def latest_metric(t):
    return livability.latest_metrics(t.metrics)


@query("field_scores", "SELECT * FROM field_scores", FIELD_SCORES)
def field_scores(t):
    return livability.field_scores(t.metrics, t.catalog, t.regions)


@query("livability_composite", "SELECT * FROM composite", COMPOSITE)
def livability_composite(t):
    return livability.composite_scores(t.metrics, t.catalog, t.regions, t.weights)


@query(
    "claims_rule_summary",
    """SELECT adm_cd, CAST(count(*) FILTER (WHERE claim = 'strength') AS INT) AS strengths, count(*) FILTER (WHERE claim = 'weakness') AS weaknesses,
  CASE WHEN count(*) FILTER (WHERE claim = 'strength') > 0 THEN 'Strong in ' || array_to_string(list_transform(list_slice(list_sort(list({'r': rank_in_sigungu, 'c': category}) FILTER (WHERE claim = 'strength')), 1, 2), lambda x: x.c), '·') || '.' END AS summary
FROM (SELECT *, CASE WHEN rank_in_sigungu <= ceil(sigungu_count / 3.0) THEN 'strength' WHEN rank_in_sigungu >= ceil(sigungu_count * 2 / 3.0) THEN 'weakness' END AS claim FROM field_scores) GROUP BY 1""",
    FIELD_SCORES,
)
def claims_rule_summary(t):
    return livability.rule_summary(livability.field_scores(t.metrics, t.catalog, t.regions))


@query("top_share", "SELECT adm_cd, category, greatest(1, CAST(round_even(rank_in_sigungu * 100.0 / sigungu_count, 0) AS INT)) AS top_pct FROM field_scores", FIELD_SCORES)
def top_share(t):
    f = livability.field_scores(t.metrics, t.catalog, t.regions)
    return f.select("adm_cd", "category", livability.top_share(F.col("rank_in_sigungu"), F.col("sigungu_count")).alias("top_pct"))


@query(
    "household_ratio",
    """SELECT adm_cd AS region, coalesce(sum(value) FILTER (WHERE household_size = 1), 0) AS h1, coalesce(sum(value) FILTER (WHERE household_size = 2), 0) AS h2,
  coalesce(sum(value) FILTER (WHERE household_size = 3), 0) AS h3, coalesce(sum(value) FILTER (WHERE household_size = 4), 0) AS h4,
  round(coalesce(sum(value) FILTER (WHERE household_size = 1), 0) * 100.0::DOUBLE / sum(value), 1) AS solo_ratio
FROM metrics WHERE household_size > 0 AND metric_key = 'HOUSEHOLD' GROUP BY 1""",
)
def household_ratio(t):
    h = t.metrics.where("household_size > 0 AND metric_key = 'HOUSEHOLD'").select(F.col("adm_cd").alias("region"), F.col("household_size").alias("size"), F.col("value").alias("households"))
    return livability.household_ratio(h)
