"""Serving queries over the public views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import grading, livability, serving
from tallyloom.plans.analog import AS_OF, COMPOSITE, FIELD_SCORES, PUBLIC, SHOWN
from tallyloom.plans.registry import query

LEGACY = {"city": {"branch": "executive", "gov_tier": "tier1"}, "gu": {"branch": "council"}}
LABELS = {"gov_tier": {"tier0": "National", "tier1": "Regional", "tier2": "Local"}, "branch": {"executive": "Executive", "council": "Council"}}


@query("places_bbox", "SELECT * FROM public WHERE lat BETWEEN 33.5 AND 36 AND lng BETWEEN 126.5 AND 129 AND grade IN ('★★★', '★★') ORDER BY score DESC NULLS LAST, last_visit_at DESC NULLS LAST, id LIMIT 100", PUBLIC)
def places_bbox(t):
    return serving.places_list(t.public, (33.5, 126.5, 36.0, 129.0), ["★★★", "★★"], 100)


def _search_sql(order: str) -> str:
    return f"""
SELECT p.id, p.name, p.region, p.category, p.score, p.grade, p.last_visit_at, p.visit_count, coalesce(a.agencies, 0) AS unique_agency_count, a.avg_amount_per_person,
  list_filter([CASE WHEN p.name ILIKE '%ring%' THEN 'name' END, CASE WHEN p.road_address ILIKE '%ring%' THEN 'address' END, CASE WHEN p.category ILIKE '%ring%' THEN 'category' END,
    CASE WHEN coalesce(a.department_match, false) THEN 'department' END], lambda x: x IS NOT NULL) AS matched_fields
FROM public p LEFT JOIN vagg a ON a.place_id = p.id
WHERE p.grade IN ('★★★', '★★', '✦') AND p.region IN ('Brand#2', 'Brand#17', 'Brand#4')
  AND (p.name ILIKE '%ring%' OR p.road_address ILIKE '%ring%' OR p.category ILIKE '%ring%' OR coalesce(a.department_match, false))
ORDER BY {order}, p.id LIMIT 50"""


_VISIT_AGG = """,
vagg AS (SELECT place_id, count(DISTINCT agency_id) AS agencies, CAST(round(avg(CASE WHEN party_size > 0 THEN amount / party_size END)) AS INT) AS avg_amount_per_person,
  bool_or(department_name ILIKE '%ring%') AS department_match FROM visits WHERE visit_date >= DATE '2000-11-04' GROUP BY 1)"""


def _search(sort: str, order: str):
    @query(f"places_search_{sort}", _search_sql(order), PUBLIC + _VISIT_AGG)
    def run(t):
        return serving.search(t.public, t.visits, AS_OF, "ring", ["Brand#2", "Brand#17", "Brand#4"], ["★★★", "★★", "✦"], sort, 50)


_search("score", "coalesce(p.name ILIKE 'ring%', false) DESC, p.score DESC NULLS LAST, p.last_visit_at DESC NULLS LAST")
_search("recent", "p.last_visit_at DESC NULLS LAST, p.score DESC NULLS LAST")
_search("visits", "p.visit_count DESC NULLS LAST, p.score DESC NULLS LAST")


@query("place_detail", "SELECT * FROM public WHERE id = 42 LIMIT 1", PUBLIC)
def place_detail(t):
    return t.public.where("id = 42").limit(1)


@query(
    "place_visits",
    f"""SELECT v.visit_id, v.place_id, p.name AS place_name, v.agency_id, a.name AS agency_name, a.parent_region, v.visit_date, v.amount, v.party_size, v.department_name, s.source_title
FROM visits v JOIN places p ON p.id = v.place_id JOIN sources s ON s.id = v.source_id JOIN agencies a ON a.id = v.agency_id WHERE {SHOWN} AND v.place_id = 42 ORDER BY v.visit_date DESC, v.visit_id LIMIT 100""",
)
def place_visits(t):
    return serving.place_visits(grading.place_visits_public(t.visits, t.places, t.sources, t.agencies), 42)


@query(
    "stats_summary",
    f"""SELECT (SELECT count(*) FROM public) AS places, (SELECT count(*) FROM visits v JOIN places p ON p.id = v.place_id WHERE {SHOWN}) AS visits,
  (SELECT max(visit_date) FROM visits v JOIN places p ON p.id = v.place_id WHERE {SHOWN}) AS last_visit_at, (SELECT count(*) FROM agencies) AS agencies""",
    PUBLIC,
)
def stats_summary(t):
    return serving.stats_summary(t.public, t.visits, t.agencies, t.places)


_REGION_COUNTS = """SELECT region, count(*) AS place_count, count(*) FILTER (WHERE grade = '★★★') AS top_place_count, count(*) FILTER (WHERE grade = '★★') AS recommended_place_count,
  count(*) FILTER (WHERE grade = '✦') AS new_place_count, max(last_visit_at) AS last_visit_at FROM public WHERE region IS NOT NULL GROUP BY region"""


@query("region_counts", f"SELECT *, region AS label FROM ({_REGION_COUNTS})", PUBLIC)
def region_counts(t):
    return serving.region_counts(t.public)


@query(
    "region_counts_with_empty",
    f"""SELECT g.region, g.label, coalesce(place_count, 0) AS place_count, coalesce(top_place_count, 0) AS top_place_count, coalesce(recommended_place_count, 0) AS recommended_place_count,
  coalesce(new_place_count, 0) AS new_place_count, c.last_visit_at
FROM (SELECT 'Brand#' || i AS region, 'Region ' || i AS label FROM range(1, 31) t(i)) g LEFT JOIN ({_REGION_COUNTS}) c USING (region)""",
    PUBLIC,
)
def region_counts_with_empty(t):
    i = F.col("id").cast("string")
    return serving.region_counts(t.public, t.spark.range(1, 31).select(F.concat(F.lit("Brand#"), i).alias("region"), F.concat(F.lit("Region "), i).alias("label")))


@query(
    "region_tree",
    """SELECT a.adm_cd, a.name, coalesce(array_to_string(list_sort(list(b.adm_cd || ':' || b.name) FILTER (WHERE b.adm_cd IS NOT NULL)), ','), '') AS children
FROM regions a LEFT JOIN (SELECT * FROM regions WHERE level = 'sigungu' AND parent_cd IS NOT NULL) b ON b.parent_cd = a.adm_cd WHERE a.level = 'sido' GROUP BY 1, 2""",
)
def region_tree(t):
    return serving.region_tree(t.regions).select("adm_cd", "name", F.array_join(F.transform("children", lambda c: F.concat(c["adm_cd"], F.lit(":"), c["name"])), ",").alias("children"))


@query(
    "agencies_ordered",
    """SELECT id, name, row_number() OVER (ORDER BY nullif(gov_tier, '') NULLS FIRST, nullif(branch, '') NULLS FIRST, nullif(expansion_phase, '') NULLS FIRST, nullif(parent_region, '') NULLS FIRST,
  nullif(sub_region, '') NULLS FIRST, nullif(short_name, '') NULLS FIRST, id) AS place FROM agencies""",
)
def agencies_ordered(t):
    from pyspark.sql.window import Window

    return t.agencies.select("id", "name", F.row_number().over(Window.orderBy(*serving.agency_order(), "id")).alias("place"))


@query(
    "agencies_labels",
    """SELECT id, g AS gov_tier, CASE g WHEN 'tier0' THEN 'National' WHEN 'tier1' THEN 'Regional' WHEN 'tier2' THEN 'Local' END AS gov_tier_label,
  b AS branch, CASE b WHEN 'executive' THEN 'Executive' WHEN 'council' THEN 'Council' END AS branch_label
FROM (SELECT id, coalesce(gov_tier, CASE WHEN kind = 'city' THEN 'tier1' END) AS g, coalesce(branch, CASE kind WHEN 'city' THEN 'executive' WHEN 'gu' THEN 'council' END) AS b FROM agencies)""",
)
def agencies_labels(t):
    return serving.with_taxonomy(t.agencies, LEGACY, LABELS).select("id", "gov_tier", "gov_tier_label", "branch", "branch_label")


@query("agency_detail", "SELECT id, name, parent_region FROM agencies WHERE id = 7")
def agency_detail(t):
    return t.agencies.where("id = 7").select("id", "name", "parent_region")


@query(
    "subregion_rank",
    """SELECT c.adm_cd, r.name, c.score, c.rank_in_sigungu, c.sigungu_emd_count, m.value AS metric_value FROM composite c JOIN regions r ON r.adm_cd = c.adm_cd
LEFT JOIN metrics m ON m.adm_cd = c.adm_cd AND m.metric_key = 'BUILDING' AND m.household_size = 0 WHERE c.parent_cd = '10003' AND c.household_size = 2 AND c.profile_version = 1""",
    COMPOSITE,
)
def subregion_rank(t):
    c = livability.composite_scores(t.metrics, t.catalog, t.regions, t.weights)
    return serving.subregions(c, t.metrics, t.regions, "10003", "BUILDING", 2, 1)


@query("field_map", "SELECT adm_cd, array_to_string(list_sort(list(category || '=' || CAST(CAST(round(field_score * 100) AS INT) AS VARCHAR))), ',') AS fields FROM field_scores GROUP BY 1", FIELD_SCORES)
def field_map(t):
    m = serving.field_map(livability.field_scores(t.metrics, t.catalog, t.regions))
    each = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 100).cast("int").cast("string")))
    return m.select("adm_cd", F.array_join(F.array_sort(each), ",").alias("fields"))


@query(
    "boundary_scores",
    """SELECT r.adm_cd, r.name, r.parent_cd, c.score, c.rank_in_sigungu, f.n AS n_fields FROM regions r LEFT JOIN (SELECT * FROM composite WHERE household_size = 1) c USING (adm_cd)
LEFT JOIN (SELECT adm_cd, CAST(count(*) AS INT) AS n FROM field_scores GROUP BY 1) f USING (adm_cd) WHERE r.level = 'emd'""",
    COMPOSITE,
)
def boundary_scores(t):
    fs = livability.field_scores(t.metrics, t.catalog, t.regions)
    b = serving.boundaries(t.regions, livability.composite_scores(t.metrics, t.catalog, t.regions, t.weights), fs)
    return b.select("adm_cd", "name", "parent_cd", "score", "rank_in_sigungu", F.when(F.col("fields").isNotNull(), F.size("fields")).alias("n_fields"))


@query(
    "neighborhood_detail_metrics",
    "SELECT m.metric_key, c.category, m.value, m.ref_period FROM metrics m JOIN catalog c ON c.metric_key = m.metric_key WHERE m.adm_cd = '10000305' AND m.household_size = 0",
)
def neighborhood_detail_metrics(t):
    return t.metrics.where("adm_cd = '10000305' AND household_size = 0").join(t.catalog, "metric_key").select("metric_key", "category", "value", "ref_period")


@query("neighborhood_households", "SELECT household_size, value FROM metrics WHERE adm_cd = '10000305' AND metric_key = 'HOUSEHOLD'")
def neighborhood_households(t):
    return t.metrics.where("adm_cd = '10000305' AND metric_key = 'HOUSEHOLD'").select("household_size", "value")


@query(
    "neighborhood_detail_summary",
    """SELECT adm_cd, arg_max(summary, household_size) AS summary, arg_max(source, household_size) AS source FROM
(SELECT adm_cd, household_size, adm_cd || '/' || household_size AS summary, 'rule' AS source FROM metrics WHERE household_size IN (0, 2) AND metric_key = 'HOUSEHOLD' AND ref_period = '2024') GROUP BY 1""",
)
def neighborhood_detail_summary(t):
    s = t.metrics.where("metric_key = 'HOUSEHOLD' AND ref_period = '2024'").selectExpr("adm_cd", "household_size", "1 AS profile_version", "concat(adm_cd, '/', household_size) AS summary", "'rule' AS source")
    return serving.best_summary(s, 2)


_BOUNDS = """bd AS (SELECT adm_cd, '{"type":"Polygon","coordinates":[[[' || CAST(CAST(substring(adm_cd, 5, 2) AS INT) AS STRING) || ',' || CAST(CAST(substring(adm_cd, 7, 2) AS INT) AS STRING) || '],[-1.5,2e1],[7,' || CAST(CAST(substring(adm_cd, 7, 2) AS INT) AS STRING) || ']]]}' AS geojson FROM regions WHERE level = 'emd')"""


def _bounds(t):
    inner = _BOUNDS.split("bd AS (", 1)[1][:-1].replace("{", "{{").replace("}", "}}")
    return t.spark.sql(inner.replace("FROM regions", "FROM {regions}"), regions=t.regions)


@query("boundary_lookup", "SELECT adm_cd, geojson FROM bd WHERE adm_cd = '10000305'", _BOUNDS)
def boundary_lookup(t):
    return serving.boundary(_bounds(t), "10000305")


@query(
    "geometry_boxes",
    """SELECT adm_cd, (least(y, 20) + greatest(y, 20)) / 2 AS center_lat, (-1.5 + greatest(x, 7)) / 2 AS center_lng, -1.5::DOUBLE AS min_lng, least(y, 20) AS min_lat, greatest(x, 7) AS max_lng, greatest(y, 20) AS max_lat
FROM (SELECT adm_cd, CAST(substring(adm_cd, 5, 2) AS DOUBLE) AS x, CAST(substring(adm_cd, 7, 2) AS DOUBLE) AS y FROM regions WHERE level = 'emd')""",
)
def geometry_boxes(t):
    from tallyloom.functions.geo import geometry_box

    return _bounds(t).select("adm_cd", geometry_box(F.col("geojson")).alias("b")).select("adm_cd", "b.*")


_POI = """pc AS (SELECT adm_cd, 'T' || (CAST(adm_cd AS BIGINT) % 3) AS poi_type, CASE WHEN CAST(adm_cd AS BIGINT) % 2 = 0 THEN 'pip' ELSE 'near' END AS distance_basis, CAST(adm_cd AS BIGINT) % 5 AS count FROM regions WHERE level = 'emd'),
pt AS (SELECT * FROM (VALUES ('T0', 'convenience', 'Shops', 2), ('T1', 'education', 'Schools', 1), ('T2', 'housing', 'Parks', 3)) AS v(poi_type, category, display_name, sort_order))"""


def _poi(t):
    counts, types = _POI.split("),\npt AS (")
    return t.spark.sql(counts.split("pc AS (", 1)[1].replace("FROM regions", "FROM {regions}"), regions=t.regions), t.spark.sql(types[:-1])


@query("poi_evidence", "SELECT adm_cd, category, poi_type, display_name, count, sort_order FROM pc JOIN pt USING (poi_type) WHERE distance_basis = 'pip' AND count > 0", _POI)
def poi_evidence(t):
    return serving.poi_evidence(*_poi(t))


@query("reaction_counts", "SELECT place_id, count(*) FILTER (WHERE reaction = 'like') AS like_count, count(*) FILTER (WHERE reaction = 'dislike') AS dislike_count FROM reactions GROUP BY 1")
def reaction_counts(t):
    return serving.reaction_counts(t.reactions)


@query(
    "reaction_default_row",
    """SELECT p.id AS place_id, count(*) FILTER (WHERE reaction = 'like') AS like_count, count(*) FILTER (WHERE reaction = 'dislike') AS dislike_count FROM places p LEFT JOIN reactions r ON r.place_id = p.id GROUP BY 1""",
)
def reaction_default_row(t):
    return serving.reaction_counts(t.reactions, t.places)


@query(
    "posts_last_activity",
    """SELECT p.post_id, p.category, p.created_at, count(c.comment_id) AS comment_count, max(c.created_at) AS last_comment_at FROM posts p
LEFT JOIN (SELECT * FROM comments WHERE hidden_at IS NULL AND deleted_at IS NULL) c USING (post_id) WHERE p.hidden_at IS NULL AND p.deleted_at IS NULL GROUP BY 1, 2, 3
ORDER BY coalesce(max(c.created_at), p.created_at) DESC, p.post_id LIMIT 30""",
)
def posts_last_activity(t):
    return serving.posts_by_activity(t.posts, t.comments)


@query("post_comments", "SELECT comment_id, created_at FROM comments WHERE post_id = 3 AND hidden_at IS NULL ORDER BY created_at")
def post_comments(t):
    return t.comments.where("post_id = 3 AND hidden_at IS NULL").select("comment_id", "created_at").orderBy("created_at")


@query(
    "client_list",
    """SELECT *, coalesce(lat <> 0 AND lng <> 0, false) AS on_map FROM public WHERE grade IN ('★★★', '★★') AND NOT is_closed AND contains(lower(concat_ws(' ', name, road_address, region, category)), 'brand#1')""",
    PUBLIC,  # no food category's name holds the word asked for
)
def client_list(t):
    return serving.client_list(t.public, "Brand#1", ["★★★", "★★"])


@query("map_clusters", "SELECT coalesce(region, 'unknown') AS label, count(*) AS n, avg(coalesce(lat, 37.5)) AS lat, avg(coalesce(lng, 127.0)) AS lng FROM public GROUP BY 1", PUBLIC)
def map_clusters(t):
    return serving.clusters(t.public, (37.5, 127.0))


@query(
    "sitemap_topk",
    "SELECT id, 'https://example.org/place/' || trim(lower(regexp_replace(name, '[^0-9A-Za-z가-힣]+', '-', 'g')), '-') || '-' || id AS loc, score FROM public ORDER BY score DESC NULLS LAST, id LIMIT 5000",
    PUBLIC,
)
def sitemap_topk(t):
    return serving.top_sitemap(t.public, "https://example.org/place")


@query("monthly_counts", "SELECT strftime(visit_date, '%Y-%m') AS month, count(*) AS n FROM visits GROUP BY 1")
def monthly_counts(t):
    return t.visits.groupBy(F.date_format("visit_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "moving_avg_alert",
    """SELECT day, n, avg(n) OVER w AS mean_before, coalesce(abs(n - avg(n) OVER w) > 0.3 * avg(n) OVER w, false) AS alert FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""",
)
def moving_avg_alert(t):
    return serving.running_mean(t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")), "day", "n")
