"""Queries that apply scalar functions to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import dates, geo, text
from tallyloom.plans.registry import query

_HAVERSINE = "2 * 6371000.0 * asin(sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lng) - radians(a.lng)) / 2), 2)))"


@query("haversine_pairs", f"SELECT a.id, round({_HAVERSINE}, 3) AS metres FROM places a JOIN places b ON b.id = a.id + 1 WHERE a.lat IS NOT NULL AND b.lat IS NOT NULL")
def haversine_pairs(t):
    a = t.places.where("lat IS NOT NULL").select("id", "lat", "lng")
    b = a.select((F.col("id") - 1).alias("id"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    return a.join(b, "id").select("id", F.round(geo.haversine(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")), 3).alias("metres"))


_BIT = "(CASE WHEN {b} % 2 = 0 THEN (x >> (17 - {b} // 2)) & 1 ELSE (y >> (16 - {b} // 2)) & 1 END)"
_DIGITS = " || ".join("substr('0123456789bcdefghjkmnpqrstuvwxyz', (" + " + ".join(f"{_BIT.format(b=b)} * {1 << (4 - b % 5)}" for b in range(5 * k, 5 * k + 5)) + ")::INT + 1, 1)" for k in range(7))


@query(
    "geohash7",
    f"SELECT id, CASE WHEN x IS NOT NULL THEN {_DIGITS} END AS geohash FROM (SELECT id, CASE WHEN lng IS NOT NULL THEN least(floor((lng + 180) / 360 * 262144), 262143)::BIGINT END AS x, CASE WHEN lat IS NOT NULL THEN least(floor((lat + 90) / 180 * 131072), 131071)::BIGINT END AS y FROM places)",
)
def geohash7(t):
    return t.places.select("id", geo.geohash(F.col("lat"), F.col("lng")).alias("geohash"))


@query("padded_bounds", "SELECT a - greatest((b - a) * 0.12, 0.05) AS south, b + greatest((b - a) * 0.12, 0.05) AS north, c - greatest((d - c) * 0.12, 0.05) AS west, d + greatest((d - c) * 0.12, 0.05) AS east FROM (SELECT min(lat) AS a, max(lat) AS b, min(lng) AS c, max(lng) AS d FROM places)")
def padded_bounds(t):
    return geo.padded_bounds(t.places)


_SQUARES = """sq AS (SELECT i AS ord, 'Z' || CAST(i AS STRING) AS code, 126e0 + i * 4e-1 AS x0, 33e0 + i * 5e-1 AS y0 FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8)) t(i))"""


@query(
    "poi_pip_counts",
    "SELECT code, category, count(*) AS n FROM (SELECT p.id, p.category, arg_min(s.code, s.ord) AS code FROM places p JOIN sq s ON p.lng > s.x0 AND p.lng < s.x0 + 0.6 AND p.lat > s.y0 AND p.lat < s.y0 + 0.7 AND NOT (p.lng > s.x0 + 0.2 AND p.lng < s.x0 + 0.4 AND p.lat > s.y0 + 0.2 AND p.lat < s.y0 + 0.4) GROUP BY 1, 2) GROUP BY 1, 2",
    _SQUARES,
)
def poi_pip_counts(t):
    """Overlapping squares with a hole each; points on their edges are kept out by a tiny shift of the polygons."""
    inner = _SQUARES.split("sq AS (", 1)[1][:-1]
    ring = "array(array(x0 + {a}, y0 + {b}), array(x0 + {c}, y0 + {b}), array(x0 + {c}, y0 + {d}), array(x0 + {a}, y0 + {d}), array(x0 + {a}, y0 + {b}))"
    outer, hole = ring.format(a="1e-9", b="1e-9", c="0.6", d="0.7"), ring.format(a="0.2 + 1e-9", b="0.2 + 1e-9", c="0.4 - 1e-9", d="0.4 - 1e-9")
    polygons = t.spark.sql(inner).selectExpr("code", "ord AS `order`", f"to_json(named_struct('type', 'Polygon', 'coordinates', array({outer}, {hole}))) AS geojson")
    polygons = polygons.select("code", "order", geo.polygon_rings(F.col("geojson")).alias("rings"))
    points = t.places.where("lat IS NOT NULL").select("id", "lat", "lng")
    hit = geo.points_in_polygons(points, polygons)
    return hit.join(t.places.select("id", "category"), "id").groupBy("code", "category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sane_points",
    "SELECT id, coalesce(lat <> 0 AND lng <> 0 AND lat BETWEEN 33 AND 39.5 AND lng BETWEEN 124 AND 132, false) AS sane FROM places",
)
def sane_points(t):
    return t.places.select("id", geo.sane_point(F.col("lat"), F.col("lng")).alias("sane"))


_NAMES = "nm AS (SELECT id, CASE id % 9 WHEN 0 THEN 'Starbucks ' || name WHEN 1 THEN '(주) BBQ ' || name WHEN 2 THEN '정보 없음' WHEN 3 THEN '미상.' WHEN 4 THEN '파리 바게트 ' || name WHEN 5 THEN name || ' 카페' WHEN 6 THEN '돼지국밥 ' || name ELSE name END AS x, road_address FROM places)"


def _named(t):
    return t.spark.sql(_NAMES.split("nm AS (", 1)[1][:-1].replace("FROM places", "FROM {places}"), places=t.places)


def _brand_sql() -> str:
    from tallyloom.functions.vocabulary import BRANDS

    squeeze = lambda a: "".join(c for c in a.lower() if c.isalnum())
    cases = " ".join(f"WHEN {' OR '.join(f'''contains(k, '{squeeze(a)}')''' for a in aliases)} THEN '{brand}'" for brand, aliases in BRANDS)
    return f"SELECT id, CASE {cases} END AS brand FROM (SELECT id, lower(regexp_replace(x, '[^0-9a-zA-Z가-힣]+', '', 'g')) AS k FROM nm)"


@query("brand_classify", _brand_sql(), _NAMES)
def brand_classify(t):
    return _named(t).select("id", text.chain_brand(F.col("x")).alias("brand"))


@query(
    "name_keys",
    r"""SELECT id, lower(regexp_replace(x, '[\s㈜주식회사()（）·.,-]+', '', 'g')) AS name_key, coalesce(regexp_replace(road_address, '[\s·.,-]', '', 'g'), '') AS address_key,
  coalesce(lower(regexp_replace(x, '[\s./_()（）-]+', '', 'g')) NOT IN ('', 'unknown', 'none', 'na', '정보없음', '미상', '해당없음', '없음', '장소없음', '불명'), false) AS valid FROM nm""",
    _NAMES,
)
def name_keys(t):
    c = F.col
    return _named(t).select("id", text.name_key(c("x")).alias("name_key"), text.address_key(c("road_address")).alias("address_key"), text.is_place_name(c("x")).alias("valid"))


@query(
    "natural_keys",
    r"SELECT id, sha1(lower(regexp_replace(x, '[\s㈜주식회사()（）·.,-]+', '', 'g')) || '|' || coalesce(regexp_replace(road_address, '[\s·.,-]', '', 'g'), '')) AS natural_key FROM nm",
    _NAMES,
)
def natural_keys(t):
    from tallyloom.operators.etl.resolve import natural_key

    none = F.lit(None).cast("double")
    return _named(t).select("id", natural_key(F.col("x"), F.col("road_address"), none, none).alias("natural_key"))


def _food_sql() -> str:
    from tallyloom.functions.vocabulary import DEFAULT_FOOD, FOOD

    hits = ", ".join("{'h': " + " + ".join(f"contains(k, '{w.lower()}')::INT" for w in words) + f", 'o': {-i}, 'key': '{key}'" + "}" for i, (key, words) in enumerate(FOOD.items()))
    return f"SELECT id, CASE WHEN b.h > 0 THEN b.key ELSE '{DEFAULT_FOOD}' END AS food FROM (SELECT id, list_max([{hits}]) AS b FROM (SELECT id, lower(x) AS k FROM nm))"


@query("food_category", _food_sql(), _NAMES)
def food_category(t):
    from tallyloom.functions.vocabulary import DEFAULT_FOOD, FOOD

    return _named(t).select("id", text.keyword_category(F.col("x"), FOOD, DEFAULT_FOOD).alias("food"))


@query(
    "place_text_split",
    r"""SELECT id, trim(regexp_replace(CASE WHEN regexp_matches(v, '^(.+?)\(([^()]+)\)\s*$') THEN regexp_extract(v, '^(.+?)\(([^()]+)\)\s*$', 1) ELSE v END, '\s+', ' ', 'g')) AS name,
  CASE WHEN regexp_matches(v, '^(.+?)\(([^()]+)\)\s*$') THEN trim(regexp_extract(v, '^(.+?)\(([^()]+)\)\s*$', 2)) END AS address_hint
FROM (SELECT id, trim(regexp_replace(CASE WHEN id % 3 = 0 THEN name || ' (' || coalesce(road_address, 'x') || ')' WHEN id % 3 = 1 THEN name || '  (a) tail' ELSE name END, '\s+', ' ', 'g')) AS v FROM places)""",
)
def place_text_split(t):
    c = F.col
    made = F.when(c("id") % 3 == 0, F.concat(c("name"), F.lit(" ("), F.coalesce("road_address", F.lit("x")), F.lit(")"))).when(c("id") % 3 == 1, F.concat(c("name"), F.lit("  (a) tail"))).otherwise(c("name"))
    return t.places.select("id", text.place_parts(made).alias("p")).select("id", "p.name", "p.address_hint")


_USERS = "us AS (SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN '홍길동 과장 외 ' || CAST(event_id % 9 AS STRING) || '명' WHEN 1 THEN '직원 ' || CAST(event_id % 13 AS STRING) || ' 명' WHEN 2 THEN '0명' WHEN 3 THEN '김철수 시장 등' WHEN 4 THEN '외' || CAST(event_id % 5 AS STRING) || '인 ' ELSE NULL END AS x FROM events)"


def _users(t):
    return t.spark.sql(_USERS.split("us AS (", 1)[1][:-1].replace("FROM events", "FROM {events}"), events=t.events)


@query(
    "party_size",
    r"""SELECT id, CASE WHEN n > 0 THEN n END AS party_size FROM (SELECT id, coalesce(try_cast(nullif(regexp_extract(x, '외\s*([0-9]+)\s*[명인]', 1), '') AS INT) + 1, try_cast(nullif(regexp_extract(x, '([0-9]+)\s*[명인]', 1), '') AS INT)) AS n FROM us)""",
    _USERS,
)
def party_size(t):
    return _users(t).select("id", text.party_size(F.col("x")).alias("party_size"))


@query("mask_names")
def mask_names(t):
    """Needs lookbehind, which the SQL engine's patterns lack; tested against Python's own."""
    u = _users(t)
    return u.select("id", text.masked_names(F.col("x")).alias("masked"), text.names_in_department(F.col("x")).alias("named"))


_AMOUNTS = "am AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN '-1,' || CAST(100 + event_id % 900 AS STRING) || '원' WHEN 1 THEN '12.5' WHEN 2 THEN 'N/A' WHEN 3 THEN CAST(event_id AS STRING) ELSE NULL END AS x, event_id % 2 = 0 AS k FROM events)"


@query(
    "amount_parse",
    "SELECT id, n AS amount, CASE WHEN k AND n < 10000 THEN n * 1000 ELSE n END AS scaled FROM (SELECT id, k, try_cast(nullif(regexp_replace(x, '[^0-9]', '', 'g'), '') AS BIGINT) AS n FROM am)",
    _AMOUNTS,
)
def amount_parse(t):
    a = t.spark.sql(_AMOUNTS.split("am AS (", 1)[1][:-1].replace("FROM events", "FROM {events}"), events=t.events)
    return a.select("id", text.amount(F.col("x")).alias("amount"), text.scaled_amount(F.col("x"), F.col("k")).alias("scaled"))


_DAYS = "dy AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '.') WHEN 1 THEN substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 3, 8) WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 14:05' WHEN 3 THEN '17' ELSE '2001.13.45' END AS d, CASE WHEN o_orderkey % 2 = 0 THEN '09:30:15' END AS c, CAST(o_orderdate AS DATE) AS day FROM orders)"


@query(
    "date_parse",
    """SELECT id, CASE id % 5 WHEN 0 THEN day + coalesce(c, '00:00:00')::TIME WHEN 1 THEN CASE WHEN year(day) % 100 < 70 THEN day + INTERVAL 0 DAY + ((year(day) % 100 + 2000 - year(day)) * INTERVAL 1 YEAR) ELSE day::TIMESTAMP END + coalesce(c, '00:00:00')::INTERVAL
  WHEN 2 THEN day + coalesce(c, '14:05:00')::TIME END AS used_at FROM dy""",
    _DAYS,
)
def date_parse(t):
    d = t.spark.sql(_DAYS.split("dy AS (", 1)[1][:-1].replace("FROM orders", "FROM {orders}"), orders=t.orders)
    return d.select("id", dates.used_at(F.col("d"), F.col("c")).alias("used_at"))


@query(
    "document_text_keys",
    r"SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents",
)
def document_text_keys(t):
    s = text.spaces(F.col("text"))
    return t.documents.select("doc_id", F.char_length(s).cast("long").alias("n"), F.md5(s).alias("digest"))


@query("page_links", r"SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS links, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages")
def page_links(t):
    return t.pages.select("page_id", F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links"), F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"))


_SAID = """sd AS (SELECT id, CASE id % 7 WHEN 0 THEN '주민 간담회' WHEN 1 THEN '의회 의원 격려 만찬 행사 참석자 식사 자리' WHEN 2 THEN '정기 회의' WHEN 3 THEN ' 커피 ' WHEN 4 THEN '' ELSE name END AS name, kakao_place_id, lat, lng, road_address, jibun_address, region,
  CASE WHEN id % 4 = 0 THEN 'fail' END AS status FROM places)"""


def _said(t):
    return t.spark.sql(_SAID.split("sd AS (", 1)[1][:-1].replace("FROM places", "FROM {places}"), places=t.places)


@query(
    "non_place_names",
    """SELECT id, regexp_matches(name, '간담회|관계자|현안|업무|협의|협력|논의|방문|민원|격려|의견|추진|점검|보고|워크숍') AS hint,
  regexp_matches(replace(name, ' ', ''), '간담회|의회|의원|회의$') AND (kakao_place_id IS NULL OR coalesce(lat, 0) = 0 OR coalesce(lng, 0) = 0 OR coalesce(status, '') = 'fail' OR length(trim(name)) >= 18) AS strict FROM sd""",
    _SAID,
)
def non_place_names(t):
    c = F.col
    return _said(t).select("id", text.holds_non_place_hint(c("name")).alias("hint"), text.strictly_no_place(c("name"), c("kakao_place_id"), c("lat"), c("lng"), c("status")).alias("strict"))


@query(
    "place_queries",
    """SELECT id, array_to_string(list_filter([q1, CASE WHEN q2 <> q1 THEN q2 END, CASE WHEN q3 <> q1 AND q3 <> q2 THEN q3 END, CASE WHEN n <> q1 AND n <> q2 AND n <> q3 THEN n END], lambda x: x <> ''), '/') AS asked FROM
(SELECT id, trim(name) AS n, trim(concat_ws(' ', nullif(name, ''), road_address)) AS q1, trim(concat_ws(' ', nullif(name, ''), jibun_address)) AS q2, trim(concat_ws(' ', nullif(name, ''), region)) AS q3 FROM sd)""",
    _SAID,
)
def place_queries(t):
    c = F.col
    return _said(t).select("id", F.array_join(text.place_queries(c("name"), c("road_address"), c("jibun_address"), c("region")), "/").alias("asked"))
