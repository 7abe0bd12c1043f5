"""Queries of snapshot merges: tables before and after a batch of changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import merge
from tallyloom.plans.registry import query

_DIGEST = "count(*) AS n"


@query(
    "upsert_source",
    """SELECT coalesce(n.agency_id, o.agency_id) AS agency_id, coalesce(n.hash, o.hash) AS hash, coalesce(n.title, o.title) AS title, coalesce(n.storage_path, o.storage_path) AS storage_path
FROM (SELECT agency_id, hash, 'old' AS title, max(storage_path) AS storage_path FROM sources GROUP BY 1, 2) o
FULL JOIN (SELECT agency_id, hash, 'new' AS title, max(CASE WHEN id % 3 = 0 THEN NULL ELSE storage_path END) AS storage_path FROM sources WHERE id % 5 < 2 GROUP BY 1, 2) n ON n.agency_id = o.agency_id AND n.hash = o.hash""",
)
def upsert_source(t):
    """Conflict on (agency, hash); a NULL storage path leaves the old one."""
    s = t.sources
    old = s.groupBy("agency_id", "hash").agg(F.lit("old").alias("title"), F.max("storage_path").alias("storage_path"))
    new = s.where("id % 5 < 2").groupBy("agency_id", "hash").agg(F.lit("new").alias("title"), F.max(F.when(F.col("id") % 3 != 0, F.col("storage_path"))).alias("storage_path"))
    return merge.merge(old, new, ["agency_id", "hash"], keep_if_null=("storage_path",))


@query(
    "upsert_visit",
    """SELECT coalesce(o.visit_id, n.visit_id) AS visit_id, coalesce(n.place_id, o.place_id) AS place_id, coalesce(n.agency_id, o.agency_id) AS agency_id, coalesce(n.department_name, o.department_name) AS department_name,
  coalesce(n.party_size, o.party_size) AS party_size FROM
(SELECT min(visit_id) AS visit_id, place_id, agency_id, department_name, 1 AS party_size FROM visits GROUP BY place_id, agency_id, department_name) o FULL JOIN
(SELECT min(visit_id) AS visit_id, place_id, agency_id, department_name, 2 AS party_size FROM visits WHERE visit_id % 3 = 0 GROUP BY place_id, agency_id, department_name) n
ON n.place_id = o.place_id AND n.agency_id = o.agency_id AND n.department_name = o.department_name""",
)
def upsert_visit(t):
    """Keys compare with '=': a NULL department never conflicts; the id of a met visit stays."""
    key = ["place_id", "agency_id", "department_name"]
    side = lambda v, p: v.groupBy(*key).agg(F.min("visit_id").alias("visit_id"), F.lit(p).alias("party_size"))
    return merge.merge(side(t.visits, 1), side(t.visits.where("visit_id % 3 = 0"), 2), key, keep=("visit_id",)).select("visit_id", *key, "party_size")


@query(
    "upsert_agency",
    """SELECT coalesce(n.tier, o.tier) AS tier, coalesce(n.region, o.region) AS region, coalesce(n.v, o.v) AS v FROM (SELECT gov_tier AS tier, parent_region AS region, min(id) AS v FROM agencies GROUP BY 1, 2) o
FULL JOIN (SELECT gov_tier AS tier, parent_region AS region, -min(id) AS v FROM agencies WHERE id % 3 = 0 GROUP BY 1, 2) n ON n.tier IS NOT DISTINCT FROM o.tier AND n.region IS NOT DISTINCT FROM o.region""",
)
def upsert_agency(t):
    """Keys compare NULL-equal."""
    side = lambda a, sign: a.groupBy(F.col("gov_tier").alias("tier"), F.col("parent_region").alias("region")).agg((F.min("id") * sign).alias("v"))
    return merge.merge(side(t.agencies, 1), side(t.agencies.where("id % 3 = 0"), -1), ["tier", "region"], null_equal=True)


@query(
    "upsert_region",
    """SELECT o.adm_cd, CASE WHEN n.adm_cd IS NULL THEN o.name ELSE n.name END AS name, coalesce(n.center_lat, o.center_lat) AS center_lat FROM
(SELECT adm_cd, name, CASE WHEN CAST(adm_cd AS BIGINT) % 3 = 0 THEN NULL ELSE 1.5::DOUBLE END AS center_lat FROM regions) o LEFT JOIN
(SELECT adm_cd, 'new ' || name AS name, CASE WHEN CAST(adm_cd AS BIGINT) % 2 = 0 THEN NULL ELSE 2.5::DOUBLE END AS center_lat FROM regions WHERE level = 'emd') n ON n.adm_cd = o.adm_cd""",
)
def upsert_region(t):
    """A missing centre leaves the old one."""
    code = F.col("adm_cd").cast("long")
    old = t.regions.select("adm_cd", "name", F.when(code % 3 != 0, F.lit(1.5)).alias("center_lat"))
    new = t.regions.where("level = 'emd'").select("adm_cd", F.concat(F.lit("new "), "name").alias("name"), F.when(code % 2 != 0, F.lit(2.5)).alias("center_lat"))
    return merge.merge(old, new, ["adm_cd"], keep_if_null=("center_lat",))


@query(
    "upsert_metric",
    """SELECT o.adm_cd, o.metric_key, o.household_size, o.ref_period, CASE WHEN n.value IS NULL THEN o.value ELSE n.value END AS value FROM metrics o LEFT JOIN
(SELECT adm_cd, metric_key, household_size, ref_period, CASE WHEN metric_key = 'BUILDING' THEN NULL ELSE value + 1 END AS value FROM metrics WHERE ref_period = '2024') n
ON n.adm_cd = o.adm_cd AND n.metric_key = o.metric_key AND n.household_size = o.household_size AND n.ref_period = o.ref_period""",
)
def upsert_metric(t):
    """A change without a value is none."""
    key = ["adm_cd", "metric_key", "household_size", "ref_period"]
    new = t.metrics.where("ref_period = '2024'").select(*key, F.when(F.col("metric_key") != "BUILDING", F.col("value") + 1).alias("value"))
    return merge.merge(t.metrics.select(*key, "value"), new.where("value IS NOT NULL"), key)


@query(
    "upsert_boundary",
    """SELECT coalesce(n.adm_cd, o.adm_cd) AS adm_cd, coalesce(n.geojson, o.geojson) AS geojson, coalesce(n.ref_year, o.ref_year) AS ref_year FROM
(SELECT adm_cd, 'old ' || name AS geojson, 2023 AS ref_year FROM regions WHERE level <> 'sido') o FULL JOIN
(SELECT adm_cd, 'new ' || name AS geojson, 2024 AS ref_year FROM regions WHERE level <> 'emd') n ON n.adm_cd = o.adm_cd""",
)
def upsert_boundary(t):
    """The new shape and its year win together."""
    side = lambda where, word, year: t.regions.where(where).select("adm_cd", F.concat(F.lit(word), "name").alias("geojson"), F.lit(year).alias("ref_year"))
    return merge.merge(side("level <> 'sido'", "old ", 2023), side("level <> 'emd'", "new ", 2024), ["adm_cd"])


@query(
    "upsert_poi",
    """SELECT coalesce(n.adm_cd, o.adm_cd) AS adm_cd, coalesce(n.poi_type, o.poi_type) AS poi_type, coalesce(n.distance_basis, o.distance_basis) AS distance_basis, coalesce(n.ref_period, o.ref_period) AS ref_period,
  coalesce(n.n, o.n) AS "count", coalesce(n.run, o.run) AS ingest_run_id FROM
(SELECT region AS adm_cd, category AS poi_type, 'pip' AS distance_basis, '2024' AS ref_period, count(*) AS n, 1 AS run FROM places WHERE region IS NOT NULL GROUP BY 1, 2) o FULL JOIN
(SELECT region AS adm_cd, category AS poi_type, 'pip' AS distance_basis, CASE WHEN region = 'Brand#11' THEN '2025' ELSE '2024' END AS ref_period, count(*) AS n, 2 AS run FROM places WHERE region IS NOT NULL AND id % 3 = 0 GROUP BY 1, 2) n
ON n.adm_cd = o.adm_cd AND n.poi_type = o.poi_type AND n.distance_basis = o.distance_basis AND n.ref_period = o.ref_period""",
)
def upsert_poi(t):
    """Counts by region, kind, basis and period: a recount wins, another period is a row of its own."""
    key = ["adm_cd", "poi_type", "distance_basis", "ref_period"]
    placed = t.places.where("region IS NOT NULL").withColumn("distance_basis", F.lit("pip"))
    counted = lambda df, period, run: df.groupBy(F.col("region").alias("adm_cd"), F.col("category").alias("poi_type"), "distance_basis", period.alias("ref_period")).agg(F.count(F.lit(1)).alias("count"), F.lit(run).alias("ingest_run_id"))
    later = F.when(F.col("region") == "Brand#11", "2025").otherwise("2024")
    return merge.merge(counted(placed, F.lit("2024"), 1), counted(placed.where("id % 3 = 0"), later, 2), key)


@query(
    "unnest_update",
    "SELECT p.id, coalesce(r.lat, p.lat) AS lat, coalesce(p.road_address, r.part) AS road_address FROM places p LEFT JOIN unnested r ON r.id = p.id",
    """batches AS (SELECT id % 7 AS batch, list(id ORDER BY id) AS ids, list(id / 1000.0::DOUBLE ORDER BY id) AS lats, list('part ' || id ORDER BY id) FILTER (WHERE id % 4 < 2) AS parts FROM places WHERE id % 5 = 0 GROUP BY 1),
unnested AS (SELECT unnest(ids) AS id, unnest(lats) AS lat, unnest(list_resize(parts, len(ids))) AS part FROM batches)""",
)
def unnest_update(t):
    """An update from parallel arrays, of which one is shorter; an address that is there stays."""
    own = F.array_sort(F.collect_list("id"))
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("id") % 4 < 2, F.col("id")))), lambda i: F.concat(F.lit("part "), i.cast("string")))
    batches = t.places.where("id % 5 = 0").groupBy((F.col("id") % 7).alias("batch")).agg(own.alias("ids"), F.transform(own, lambda i: i / F.lit(1000.0)).alias("lats"), parts.alias("parts"))
    rows = merge.unnested(batches, id="ids", lat="lats", part="parts").drop("batch").withColumnRenamed("lat", "new_lat")
    joined = t.places.select("id", "lat", "road_address").join(rows, "id", "left")
    return joined.select("id", F.coalesce("new_lat", "lat").alias("lat"), F.coalesce("road_address", "part").alias("road_address"))


_NEW_PLACES = "SELECT CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'k' || CAST(p_partkey AS STRING) END AS kakao_place_id, 'n' || CAST(CASE WHEN p_partkey % 9 = 1 THEN p_partkey + 1000000 ELSE p_partkey END AS STRING) AS natural_key, 'upd ' || p_name AS name FROM part WHERE p_partkey % 3 = 0 OR p_partkey > 1900"


@query(
    "upsert_place",
    f"""SELECT o.id, coalesce(n.kakao_place_id, o.kakao_place_id) AS kakao_place_id, CASE WHEN n.hit IS NULL THEN o.natural_key ELSE n.natural_key END AS natural_key, CASE WHEN n.hit IS NULL THEN o.name ELSE n.name END AS name FROM old o LEFT JOIN upd n ON n.hit = o.id
UNION ALL SELECT NULL, kakao_place_id, natural_key, name FROM fnd WHERE hit IS NULL""",
    f"""old AS (SELECT id, kakao_place_id, natural_key, name FROM places), fnd AS (SELECT n.*, coalesce(a.id, b.id) AS hit FROM ({_NEW_PLACES}) n LEFT JOIN old a ON a.kakao_place_id = n.kakao_place_id LEFT JOIN old b ON b.natural_key = n.natural_key),
upd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY natural_key DESC) AS rn FROM fnd WHERE hit IS NOT NULL) WHERE rn = 1)""",
)
def upsert_place(t):
    """Found by outer id, else by natural key."""
    old = t.places.select("id", "kakao_place_id", "natural_key", "name")
    return merge.merge_places(old, t.spark.sql(_NEW_PLACES.replace("FROM part", "FROM {part}"), part=t.part))


@query(
    "closure_state",
    """SELECT p.id, coalesce(c.n, 0) AS closure_report_count, p.is_closed OR coalesce(c.n, 0) >= 3 AS is_closed, coalesce(p.closed_at, c.reached) AS closed_at FROM places p LEFT JOIN
(SELECT place_id, count(*) AS n, min(first_at) FILTER (WHERE nth = 3) AS reached FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY first_at, reporter) AS nth FROM (SELECT place_id, reporter, min(reported_at) AS first_at FROM reports GROUP BY 1, 2)) GROUP BY 1) c ON c.place_id = p.id""",
)
def closure_state(t):
    return merge.closure_state(t.places, t.reports)


@query(
    "takedown_hide",
    """SELECT p.id, coalesce(p.hidden_at, r.first_at) AS hidden_at, coalesce(p.hidden_reason, CASE WHEN p.hidden_at IS NULL AND r.first_at IS NOT NULL THEN 'takedown_request' END) AS hidden_reason
FROM places p LEFT JOIN (SELECT place_id, min(requested_at) AS first_at FROM requests GROUP BY 1) r ON r.place_id = p.id""",
)
def takedown_hide(t):
    return merge.takedown(t.places, t.requests).select("id", "hidden_at", "hidden_reason")


@query(
    "mark_invalid",
    """SELECT id, valid_place AND NOT f AS valid_place, CASE WHEN f THEN coalesce(hidden_at, TIMESTAMP '2002-01-01 00:00:00') ELSE hidden_at END AS hidden_at, CASE WHEN f THEN coalesce(hidden_reason, 'not_a_place') ELSE hidden_reason END AS hidden_reason
FROM (SELECT *, id % 10 = 3 AND deleted_at IS NULL AS f FROM places)""",
)
def mark_invalid(t):
    flagged = t.places.where("id % 10 = 3").select("id")
    return merge.mark_invalid(t.places, flagged, F.lit("2002-01-01 00:00:00").cast("timestamp_ntz"), "not_a_place").select("id", "valid_place", "hidden_at", "hidden_reason")


@query(
    "reactions_merge",
    "SELECT place_id, user_id, reaction FROM (SELECT *, row_number() OVER (PARTITION BY place_id, user_id ORDER BY changed_at DESC) AS rn FROM (SELECT place_id, user_id, CASE WHEN seq % 4 = 0 THEN NULL ELSE reaction END AS reaction, changed_at FROM reactions)) WHERE rn = 1 AND reaction IS NOT NULL",
)
def reactions_merge(t):
    r = t.reactions.select("place_id", "user_id", F.when(F.col("seq") % 4 != 0, F.col("reaction")).alias("reaction"), "changed_at", "seq")
    return merge.reactions_merge(r.where("seq % 2 = 0"), r.where("seq % 2 = 1")).select("place_id", "user_id", "reaction")


@query(
    "move_dedupe",
    """SELECT visit_id, place_id, agency_id, department_name FROM (SELECT *, row_number() OVER (PARTITION BY place_id, agency_id, department_name, visit_date ORDER BY mover, visit_id) AS rn FROM
(SELECT visit_id, CASE WHEN place_id % 20 = 1 THEN place_id + 1 ELSE place_id END AS place_id, agency_id, department_name, visit_date, place_id % 20 = 1 AS mover FROM visits)) WHERE rn = 1 OR NOT mover OR department_name IS NULL""",
)
def move_dedupe(t):
    moves = t.places.where("id % 20 = 1").selectExpr("id AS from_id", "id + 1 AS to_id")
    v = t.visits.select("visit_id", "place_id", "agency_id", "department_name", "visit_date")
    return merge.move_visits(v, moves, ["place_id", "agency_id", "department_name", "visit_date"]).drop("visit_date")


@query("join_update", "SELECT id, name, CASE WHEN u IS NULL THEN lat ELSE u END AS lat FROM (SELECT id, name, lat, CASE WHEN id % 11 = 2 THEN 37.5::DOUBLE END AS u FROM places)")
def join_update(t):
    source = t.places.where("id % 11 = 2").select("id", F.lit(37.5).alias("lat"))
    return merge.join_update(t.places.select("id", "name", "lat"), source, "id", ["lat"])


@query("orphan_delete", "SELECT id FROM places WHERE id IN (SELECT place_id FROM visits) OR id % 2 = 1")
def orphan_delete(t):
    kept = merge.without_orphans(t.places, t.visits, t.places.where("id % 2 = 0").select("id"))
    return kept.select("id")
