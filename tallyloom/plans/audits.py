"""Queries of quality gates, reports and audits."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tallyloom.operators import audit, quality
from tallyloom.plans.registry import query

ALIASES = {f"NATION_{i}": f"N{i % 25}" for i in range(25)} | {f"Brand#{i}": f"N{i % 25}" for i in range(1, 26)}


def _values(table: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in table.items()) + ")"


@query("table_counts_union", "SELECT 'places' AS table_name, count(*) AS n FROM places UNION ALL SELECT 'visits', count(*) FROM visits UNION ALL SELECT 'agencies', count(*) FROM agencies")
def table_counts_union(t):
    return quality.labelled_counts({"places": t.places, "visits": t.visits, "agencies": t.agencies})


@query(
    "place_quality_counts",
    """SELECT count(*) AS places, count(*) FILTER (WHERE lat IS NOT NULL AND lng IS NOT NULL) AS located, count(*) FILTER (WHERE kakao_place_id IS NULL) AS without_id,
  count(*) FILTER (WHERE hidden_at IS NOT NULL) AS hidden, count(DISTINCT region) AS regions FROM places""",
)
def place_quality_counts(t):
    c = F.col
    return t.places.agg(
        F.count(F.lit(1)).alias("places"),
        F.count_if(c("lat").isNotNull() & c("lng").isNotNull()).alias("located"),
        F.count_if(c("kakao_place_id").isNull()).alias("without_id"),
        F.count_if(c("hidden_at").isNotNull()).alias("hidden"),
        F.countDistinct("region").alias("regions"),
    )


@query("source_kind_counts", "SELECT coalesce(file_kind, 'missing') AS label, count(*) AS n FROM sources GROUP BY 1")
def source_kind_counts(t):
    return quality.count_by(t.sources, "file_kind")


@query(
    "agency_visit_distribution",
    """SELECT count(*) AS agencies, count(*) FILTER (WHERE n = 0) AS without, count(*) FILTER (WHERE n BETWEEN 1 AND 9) AS few, count(*) FILTER (WHERE n >= 10) AS many, max(n) AS most
FROM (SELECT a.id, count(v.visit_id) AS n FROM agencies a LEFT JOIN visits v ON v.agency_id = a.id GROUP BY 1)""",
)
def agency_visit_distribution(t):
    return quality.visit_distribution(t.agencies, t.visits)


@query("confidence_percentiles", "SELECT quantile_cont(confidence, 0.1) AS p10, quantile_cont(confidence, 0.9) AS p90, avg(confidence) AS mean FROM visits")
def confidence_percentiles(t):
    return quality.confidence_percentiles(t.visits, "confidence")


@query(
    "missing_ratio",
    """SELECT 'region' AS "column", count(*) FILTER (WHERE region IS NULL OR trim(region) = '') AS missing, count(*) FILTER (WHERE region IS NULL OR trim(region) = '') * 100.0::DOUBLE / count(*) AS ratio FROM places
UNION ALL SELECT 'lat', count(*) FILTER (WHERE lat IS NULL), count(*) FILTER (WHERE lat IS NULL) * 100.0::DOUBLE / count(*) FROM places
UNION ALL SELECT 'road_address', count(*) FILTER (WHERE road_address IS NULL), count(*) FILTER (WHERE road_address IS NULL) * 100.0::DOUBLE / count(*) FROM places""",
)
def missing_ratio(t):
    return quality.missing_ratios(t.places, ["region", "lat", "road_address"]).withColumn("ratio", F.col("ratio").cast("double"))


@query(
    "labels_completeness",
    "SELECT count(*) AS documents, count(l.doc_id) AS labelled, count(*) FILTER (WHERE l.toxic = 1) AS toxic, count(*) FILTER (WHERE d.lang IS NULL) AS without_lang FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def labels_completeness(t):
    l = t.labels.select(F.col("doc_id").alias("labelled_id"), "toxic")
    d = t.documents.select("doc_id", "lang").join(l, F.col("doc_id") == F.col("labelled_id"), "left")
    return d.agg(F.count(F.lit(1)).alias("documents"), F.count("labelled_id").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("lang").isNull()).alias("without_lang"))


@query(
    "region_mismatch_pairs",
    f"""SELECT q.parent_region, q.region, q.n FROM (SELECT a.parent_region, p.region, count(*) AS n FROM visits v JOIN agencies a ON a.id = v.agency_id JOIN places p ON p.id = v.place_id
WHERE a.parent_region IS NOT NULL AND p.region IS NOT NULL GROUP BY 1, 2) q JOIN {_values(ALIASES)} x(k, v) ON x.k = q.parent_region JOIN {_values(ALIASES)} y(k, v) ON y.k = split_part(q.region, ' ', 1) WHERE x.v <> y.v""",
)
def region_mismatch_pairs(t):
    return audit.region_mismatch(t.visits, t.agencies, t.places, ALIASES)


_ANOMALIES = """anom AS (SELECT v.visit_id, v.place_id, v.agency_id, a.short, coalesce(split_part(road_address, ' ', 1), split_part(jibun_address, ' ', 1)) AS first_token
FROM visits v JOIN (SELECT *, 'Brand#' || (id % 25 + 1) AS short FROM agencies) a ON a.id = v.agency_id JOIN places p ON p.id = v.place_id
WHERE p.hidden_at IS NULL AND p.deleted_at IS NULL AND road_address NOT LIKE '%' || a.short || '%' AND jibun_address NOT LIKE '%' || a.short || '%')"""


def _brand():
    return F.concat(F.lit("Brand#"), (F.col("agency_id") % 25 + 1).cast("string"))


def _anomalies(t):
    return audit.geo_anomalies(t.visits, t.agencies, t.places, _brand())


@query("geo_anomalies", "SELECT * FROM anom", _ANOMALIES)
def geo_anomalies(t):
    return _anomalies(t)


@query(
    "geo_anomaly_groups",
    """SELECT place_id, count(*) AS visits, count(DISTINCT agency_id) AS agencies, array_to_string(list_slice(list_sort(list(DISTINCT a.name)), 1, 3), ',') AS names
FROM anom JOIN agencies a ON a.id = anom.agency_id GROUP BY 1""",
    _ANOMALIES,
)
def geo_anomaly_groups(t):
    return audit.anomaly_groups(t.visits, t.agencies, t.places, _brand()).withColumn("names", F.array_join("names", ","))


@query(
    "geo_anomaly_excerpts",
    """SELECT place_id, count(*) AS visits, array_to_string(list_slice(list_sort(list(visit_id) FILTER (WHERE visit_id % 3 <> 0)), 1, 3), ',') AS excerpts FROM anom GROUP BY 1""",
    _ANOMALIES,
)
def geo_anomaly_excerpts(t):
    """Excerpts here are the visits' own ids; every third visit has none."""
    visits = t.visits.withColumn("excerpt", F.when(F.col("visit_id") % 3 != 0, F.col("visit_id").cast("string")))
    return audit.anomaly_groups(visits, t.agencies, t.places, _brand(), "excerpt").select("place_id", "visits", F.array_join("excerpts", ",").alias("excerpts"))


@query("modal_agency", "SELECT place_id, agency_id, n FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY n DESC, agency_id) AS rn FROM (SELECT place_id, agency_id, count(*) AS n FROM visits GROUP BY 1, 2)) WHERE rn = 1")
def modal_agency(t):
    return audit.modal_agency(t.visits)


@query("orphan_places", "SELECT id FROM places WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.place_id = places.id)")
def orphan_places(t):
    return audit.orphans(t.places, t.visits)


@query(
    "registry_pivot",
    """SELECT expansion_phase, count(*) AS total, count(*) FILTER (WHERE status = 'crawl_ready') AS crawl_ready, count(*) FILTER (WHERE status = 'adapter_required') AS adapter_required,
  count(*) FILTER (WHERE status = 'on_hold') AS on_hold FROM agencies GROUP BY 1""",
)
def registry_pivot(t):
    return quality.status_pivot(t.agencies, "expansion_phase", "status", ["crawl_ready", "adapter_required", "on_hold"])


_MARKERS = """markers AS (SELECT p.id AS place_id, p.kakao_place_id, p.lat, p.lng, p.id % 97 = 1 AS non_place, coalesce(m.missing_storage, 0) AS missing_storage, p.id % 61 AS u, CAST(p.id % 37 = 0 AS INT) AS missing_url,
  0 AS missing_excerpt, CAST(p.id % 41 = 0 AS INT) AS masking_suspects, CAST(p.id % 43 = 0 AS INT) AS policy_violations, m.mean_confidence,
  CASE p.id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'fail' WHEN 2 THEN 'manual_review' WHEN 3 THEN 'warn' ELSE 'pass' END AS kakao_status, CASE p.id % 7 WHEN 0 THEN NULL ELSE 'r' || CAST(p.id % 7 AS STRING) END AS kakao_reason,
  CAST(p.id % 53 = 0 AS INT) AS url_fails, CAST(p.id % 31 = 0 AS INT) AS url_warns
FROM {places} p LEFT JOIN (SELECT v.place_id, round(avg(v.confidence), 6) AS mean_confidence, sum(CASE WHEN s.storage_path IS NULL THEN 1 ELSE 0 END) AS missing_storage
  FROM {visits} v JOIN {sources} s ON s.id = v.source_id GROUP BY 1) m ON m.place_id = p.id)"""
_PLAIN = _MARKERS.replace("{places}", "places").replace("{visits}", "visits").replace("{sources}", "sources")
_AUDITED = _PLAIN + """,
audited AS (SELECT place_id, kakao_status, list_filter([CASE WHEN kakao_place_id IS NULL THEN 'missing_kakao_place_id' END, CASE WHEN lat IS NULL OR lng IS NULL THEN 'missing_coordinates' END,
  CASE WHEN missing_storage > 0 THEN 'missing_storage_path' END, CASE WHEN missing_url > 0 THEN 'missing_source_url' END, CASE WHEN missing_excerpt > 0 THEN 'missing_raw_excerpt' END,
  CASE WHEN masking_suspects > 0 THEN 'masking_suspect' END, CASE WHEN policy_violations > 0 THEN 'representative_policy_violation' END, CASE WHEN mean_confidence < 0.8 THEN 'low_avg_confidence' END,
  CASE WHEN coalesce(kakao_status, 'manual_review') <> 'pass' THEN 'kakao_' || coalesce(kakao_status, 'manual_review') || ':' || coalesce(kakao_reason, 'missing_kakao_status') END,
  CASE WHEN url_fails > 0 THEN 'source_url_fail' END, CASE WHEN url_warns > 0 THEN 'source_url_warn_or_manual_review' END], lambda x: x IS NOT NULL) AS r FROM markers),
status AS (SELECT place_id, CASE WHEN len(r) = 0 THEN 'pass' WHEN list_has_any(r, ['missing_coordinates', 'missing_source_url', 'representative_policy_violation', 'source_url_fail']) OR coalesce(kakao_status, '') = 'fail' THEN 'fail'
  WHEN contains(array_to_string(r, ';'), 'manual_review') THEN 'manual_review' ELSE 'warn' END AS audit_status, array_to_string(r, ';') AS audit_reasons FROM audited)"""


def _markers(t):
    """The markers come from all visits of a place."""
    inner = _MARKERS.split("markers AS (", 1)[1].rstrip()[:-1]
    return t.spark.sql(inner, places=t.places, visits=t.visits, sources=t.sources)


@query("audit_status", "SELECT * FROM status", _AUDITED)
def audit_status(t):
    return audit.marker_audit(_markers(t))


@query("reason_topk", "SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(audit_reasons, ';')) AS reason FROM status) WHERE reason <> '' GROUP BY 1 ORDER BY n DESC, reason LIMIT 30", _AUDITED)
def reason_topk(t):
    return quality.top_reasons(audit.marker_audit(_markers(t)), "audit_reasons")


@query(
    "review_queues",
    """SELECT place_id, queue FROM (SELECT place_id, CASE WHEN non_place THEN 'likely-non-place' WHEN NOT coalesce(lat <> 0 AND lng <> 0, false) THEN 'missing-coordinates' WHEN kakao_status = 'fail' THEN 'kakao-fail'
  WHEN url_warns > 0 OR url_fails > 0 THEN 'source-review' END AS queue FROM markers) WHERE queue IS NOT NULL""",
    _PLAIN,
)
def review_queues(t):
    return audit.review_queue(_markers(t))


_CANDIDATES = """cand AS (SELECT a.id AS place_id, CASE WHEN b.id % 3 = 0 THEN a.kakao_place_id ELSE 'c' || CAST(b.id AS STRING) END AS candidate_id, CASE WHEN b.id % 5 = 0 THEN a.name ELSE b.name END AS candidate_name,
  CASE WHEN b.id % 2 = 0 THEN 'FD6' ELSE 'CE7' END AS group_code, a.lat + (b.id % 9 - 4) * 5e-4 AS lat, a.lng + (b.id % 7 - 3) * 5e-4 AS lng FROM {places} a JOIN {places} b ON b.id BETWEEN a.id AND a.id + 3)"""
_METRES = "2 * 6371000.0 * asin(sqrt(pow(sin((radians({c}.lat) - radians({p}.lat)) / 2), 2) + cos(radians({p}.lat)) * cos(radians({c}.lat)) * pow(sin((radians({c}.lng) - radians({p}.lng)) / 2), 2)))"
_KEY = r"lower(regexp_replace({x}, '[\s㈜주식회사()（）·.,-]+', '', 'g'))"
_BEST = (
    _CANDIDATES.replace("{places}", "places")
    + f""",
sc AS (SELECT c.place_id, c.candidate_id, p.kakao_place_id AS own_id, c.group_code, {_KEY.format(x='p.name')} = {_KEY.format(x='c.candidate_name')} AS name_exact, {_METRES.format(c='c', p='p')} AS metres FROM cand c JOIN places p ON p.id = c.place_id),
ss AS (SELECT *, CASE WHEN candidate_id = own_id THEN -1000 ELSE 0 END + CASE WHEN name_exact THEN -200 ELSE 0 END + CASE WHEN group_code = 'FD6' THEN -50 ELSE 0 END + coalesce(metres, 0.0) AS candidate_score FROM sc),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY candidate_score, candidate_id NULLS FIRST) AS rn FROM ss) WHERE rn = 1)"""
)


def _candidates(t):
    """Every place with itself and the up to three that follow it by id: an equi-join on the shifted id."""
    c = F.col
    near = t.places.select("id", "name", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("step")).select((c("id") - c("step")).alias("place_id"), c("id").alias("near_id"), c("name").alias("near_name"))
    own = t.places.select(c("id").alias("place_id"), "kakao_place_id", "name", "lat", "lng")
    return own.join(near.hint("merge"), "place_id").select(  # four rows a place, which the file's size does not tell: never broadcast
        "place_id",
        F.when(c("near_id") % 3 == 0, c("kakao_place_id")).otherwise(F.concat(F.lit("c"), c("near_id").cast("string"))).alias("candidate_id"),
        F.when(c("near_id") % 5 == 0, c("name")).otherwise(c("near_name")).alias("candidate_name"),
        F.when(c("near_id") % 2 == 0, "FD6").otherwise("CE7").alias("group_code"),
        (c("lat") + (c("near_id") % 9 - 4) * 5e-4).alias("lat"),
        (c("lng") + (c("near_id") % 7 - 3) * 5e-4).alias("lng"),
    )


def _best(t):
    return audit.candidate_scores(t.places, _candidates(t))


@query("candidate_best", "SELECT place_id, candidate_id, own_id, group_code, name_exact, round(metres, 3) AS metres, round(candidate_score, 3) AS candidate_score FROM best", _BEST)
def candidate_best(t):
    return _best(t).select("place_id", "candidate_id", "own_id", "group_code", "name_exact", F.round("metres", 3).alias("metres"), F.round("candidate_score", 3).alias("candidate_score"))


@query(
    "candidate_status",
    """SELECT place_id, CASE WHEN candidate_id IS NULL THEN 'manual_review' WHEN candidate_id = own_id THEN 'pass' WHEN group_code <> 'FD6' THEN 'manual_review' WHEN name_exact AND metres <= 50 THEN 'warn' WHEN metres <= 300 THEN 'manual_review' ELSE 'fail' END AS status,
  CASE WHEN candidate_id IS NULL THEN 'no_candidate' WHEN candidate_id = own_id THEN 'same_id' WHEN group_code <> 'FD6' THEN 'not_food' WHEN name_exact AND metres <= 50 THEN 'candidate_within_50m' WHEN metres <= 300 THEN 'candidate_within_300m' ELSE 'candidate_over_300m' END AS reason FROM best""",
    _BEST,
)
def candidate_status(t):
    return audit.candidate_status(_best(t))


@query(
    "readiness_gates",
    """SELECT 'coordinates' AS gate, located / places AS value, located >= 0.9 * places AS passed FROM tot UNION ALL SELECT 'confidence', mean_confidence, mean_confidence >= 0.8 FROM tot UNION ALL SELECT 'mismatch', mismatches / visits, mismatches <= 0.05 * visits FROM tot""",
    """tot AS (SELECT (SELECT count(*) FROM places) AS places, (SELECT count(lat) FROM places) AS located, (SELECT avg(confidence) FROM visits) AS mean_confidence, (SELECT count(*) FROM visits) AS visits,
  (SELECT count(*) FROM visits v JOIN agencies a ON a.id = v.agency_id JOIN places p ON p.id = v.place_id WHERE p.region = 'Brand#3' AND a.parent_region = 'NATION_4') AS mismatches)""",
)
def readiness_gates(t):
    p = t.places.agg(F.count(F.lit(1)).alias("places"), F.count("lat").alias("located"))
    v = t.visits.agg(F.avg("confidence").alias("mean_confidence"), F.count(F.lit(1)).alias("visits"))
    m = t.visits.join(t.agencies.where("parent_region = 'NATION_4'").select(F.col("id").alias("agency_id")), "agency_id", "left_semi").join(t.places.where("region = 'Brand#3'").select(F.col("id").alias("place_id")), "place_id", "left_semi")
    return audit.readiness(p.crossJoin(v).crossJoin(m.agg(F.count(F.lit(1)).alias("mismatches"))))


_BATCHES = """b AS (SELECT source_id AS batch_id, count(*) AS visits, avg(CAST(confidence AS DECIMAL(12, 6))) AS mean, min(confidence) AS least FROM visits GROUP BY 1),
pl AS (SELECT source_id AS batch_id, count(*) AS places, count(*) FILTER (WHERE lat IS NULL OR lng IS NULL) AS unlocated, count(*) FILTER (WHERE kakao_place_id IS NOT NULL) AS matched FROM
  (SELECT DISTINCT v.source_id, p.id, p.lat, p.lng, p.kakao_place_id FROM visits v JOIN places p ON p.id = v.place_id) GROUP BY 1),
j AS (SELECT s.id AS batch_id, s.agency_id, s.storage_path, 1 AS parsed_rows, coalesce(visits, 0) AS visits, mean, least, coalesce(places, 0) AS places, coalesce(unlocated, 0) AS unlocated, coalesce(matched, 0) AS matched FROM sources s LEFT JOIN b ON b.batch_id = s.id LEFT JOIN pl ON pl.batch_id = s.id),
fired AS (SELECT batch_id, 'zero_normalized_visits' AS code, 'fail' AS severity FROM j WHERE parsed_rows > 0 AND visits = 0 UNION ALL SELECT batch_id, 'low_average_confidence', 'fail' FROM j WHERE mean < 0.8
  UNION ALL SELECT batch_id, 'low_single_confidence', 'quarantine' FROM j WHERE least < 0.5 UNION ALL SELECT batch_id, 'missing_coordinates', 'fail' FROM j WHERE places > 0 AND unlocated / places > 0.05
  UNION ALL SELECT batch_id, 'all_unmatched_places', 'fail' FROM j WHERE visits >= 5 AND places > 0 AND matched = 0 UNION ALL SELECT batch_id, 'missing_storage_path', 'fail' FROM j WHERE storage_path IS NULL),
gates AS (SELECT *, false AS ok FROM fired UNION ALL SELECT batch_id, 'quality_pass', 'warn', true FROM j WHERE batch_id NOT IN (SELECT batch_id FROM fired))"""


def _gates(t):
    v = t.visits
    p = v.select(F.col("source_id").alias("batch_id"), F.col("place_id").alias("place_key")).join(t.places.select(F.col("id").alias("place_key"), "lat", "lng", F.col("kakao_place_id").isNotNull().alias("matched")), "place_key")
    batches = t.sources.select(F.col("id").alias("batch_id"), F.lit(1).alias("parsed_rows"), "storage_path")
    return quality.quality_gates(batches, v.select(F.col("source_id").alias("batch_id"), "confidence"), p, need_storage=True)


@query("quality_gates", "SELECT batch_id, code, severity, ok FROM gates", _BATCHES)
def quality_gates(t):
    return _gates(t)


@query(
    "gate_policy_fail",
    """SELECT agency_id, seq, batch_id, CASE WHEN bool_or(bad) OVER (PARTITION BY agency_id ORDER BY seq ROWS UNBOUNDED PRECEDING) THEN 'stopped' ELSE 'load' END AS decision FROM
(SELECT s.agency_id, s.id AS seq, s.id AS batch_id, bool_or(NOT ok AND severity IN ('fail', 'quarantine') AND code <> 'x') AS bad FROM sources s JOIN gates g ON g.batch_id = s.id GROUP BY 1, 2, 3)""",
    _BATCHES,
)
def gate_policy_fail(t):
    return quality.gate_policy(_gates(t), t.sources.select("agency_id", F.col("id").alias("seq"), F.col("id").alias("batch_id")), "fail")


@query("match_rate", "SELECT count(*) AS seen, count(*) FILTER (WHERE kakao_place_id IS NOT NULL) AS matched, count(*) FILTER (WHERE kakao_place_id IS NOT NULL) / count(*) AS match_rate FROM places")
def match_rate(t):
    return quality.match_rate(t.places.select(F.col("id").alias("place_key"), F.col("kakao_place_id").isNotNull().alias("matched")))


_CLASSES = r"""cls AS (SELECT event_id, status, CASE WHEN status = 0 THEN NULL
  WHEN code = 'adapter_required' THEN CASE hold WHEN 'legal_hold' THEN 'legal_hold' WHEN 'source_not_found' THEN 'source_not_found' WHEN 'no_recent_data' THEN 'no_recent_data' WHEN 'pdf_vision_hold' THEN 'pdf_vision_hold' WHEN 'adapter_hold' THEN 'parser_missing' ELSE 'source_not_found' END
  WHEN code = 'unsupported_adapter' THEN 'parser_missing' WHEN code = 'timeout' THEN 'timeout'
  WHEN regexp_matches(x, 'legal|visibility') THEN 'legal_hold'
  WHEN regexp_matches(x, 'parser|unsupported|extractor|decompress') THEN 'parser_missing'
  WHEN regexp_matches(x, 'kakao|coordinate|unmatched') THEN 'kakao_resolution'
  WHEN regexp_matches(x, 'database|postgres|constraint|duplicate') THEN 'db_constraint'
  WHEN regexp_matches(x, 'r2|storage|bucket') THEN 'storage_failure'
  WHEN regexp_matches(x, 'llm|api key|vision|confidence|anthropic|openai|gemini') THEN 'llm_extraction_failure'
  WHEN regexp_matches(x, 'download|timeout|403|401|auth|js|http|dns|netfunnel') THEN 'auth_js_download'
  WHEN regexp_matches(x, 'source|not found|no posts') THEN 'source_not_found' ELSE 'unknown' END AS reason
FROM (SELECT *, lower(coalesce(code, '') || ' ' || coalesce(message, '')) AS x FROM usage))"""


@query("failure_classify", "SELECT event_id, reason, status IN (1, 3) AND coalesce(reason IN ('auth_js_download', 'llm_extraction_failure', 'storage_failure', 'unknown'), false) AS retry FROM cls", _CLASSES)
def failure_classify(t):
    c = F.col
    u = t.usage.withColumn("reason", quality.failure_reason(c("status"), c("code"), c("message"), c("hold")))
    return u.select("event_id", "reason", quality.should_retry(F.col("status"), F.col("reason")).alias("retry"))


_PRICES = "(VALUES " + ", ".join(f"('{m}', {a}::DECIMAL(10, 4), {b}::DECIMAL(10, 4))" for m, (a, b) in quality.PRICES.items()) + ") pr(model, i, o)"
_COST = f"""cost AS (SELECT event_id, created_at, CAST((tokens_in * i + (tokens_out + coalesce(thinking, 0)) * o)::DECIMAL(38, 4) / 1000000 AS DECIMAL(18, 6)) AS cost FROM usage LEFT JOIN {_PRICES} USING (model))"""


@query("llm_cost_rows", "SELECT event_id, cost::DOUBLE AS cost FROM cost", _COST)
def llm_cost_rows(t):
    return t.usage.select("event_id", quality.token_cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out"), F.col("thinking")).cast("double").alias("cost"))


@query("llm_cost_daily", "SELECT coalesce(sum(cost), 0)::DOUBLE AS spent FROM cost WHERE CAST(created_at AS DATE) = DATE '2024-01-10'", _COST)
def llm_cost_daily(t):
    u = t.usage.withColumn("cost", quality.token_cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out"), F.col("thinking")))
    return quality.daily_cost(u, date(2024, 1, 10)).select(F.col("spent").cast("double").alias("spent"))


@query(
    "backfill_status",
    """SELECT CASE WHEN o.source_id IS NULL THEN 'retry' WHEN hash IS NULL OR hash <> found THEN 'failed' ELSE 'stored' END AS status,
  CASE WHEN o.source_id IS NULL THEN 'not_fetched' WHEN hash IS NULL THEN 'hash_missing' WHEN hash <> found THEN 'hash_mismatch' ELSE 'verified' END AS reason, count(*) AS n
FROM (SELECT id AS source_id, CASE WHEN id % 9 = 0 THEN NULL ELSE sha256(CAST(id % 7 AS VARCHAR)) END AS hash FROM sources WHERE storage_path IS NULL) s
LEFT JOIN (SELECT id AS source_id, sha256(CAST(id % 5 AS VARCHAR)) AS found FROM sources WHERE id % 3 <> 0) o USING (source_id) GROUP BY 1, 2""",
)
def backfill_status(t):
    s = t.sources.select(F.col("id").alias("source_id"), "storage_path", F.when(F.col("id") % 9 != 0, F.sha2((F.col("id") % 7).cast("string"), 256)).alias("hash_sha256"))
    o = t.sources.where("id % 3 <> 0").select(F.col("id").alias("source_id"), (F.col("id") % 5).cast("string").cast("binary").alias("content"))
    return audit.verified_backfill(s, o)


@query(
    "rate_limit_fixed_window",
    """SELECT event_id, reset_at, greatest(3 - nth, 0) AS remaining, nth <= 3 AS allowed FROM (SELECT event_id, reset_at, row_number() OVER (PARTITION BY user_id, reset_at ORDER BY ts, event_id) AS nth
FROM (SELECT *, CAST(floor(epoch(ts) / 86400) * 86400 + 86400 AS BIGINT) AS reset_at FROM events))""",
)
def rate_limit_fixed_window(t):
    from tallyloom.streaming.streams import rate_limited

    return rate_limited(t.events, "user_id", "ts", "event_id", 3, 86_400).select("event_id", "reset_at", "remaining", "allowed")
