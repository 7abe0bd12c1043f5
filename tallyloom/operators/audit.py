"""Audits: region mismatch, geographical anomalies, candidate evidence, marker status, review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.geo import haversine
from tallyloom.functions.text import name_key


def lookup(c: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def region_mismatch(visits: DataFrame, agencies: DataFrame, places: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Visit counts of pairs of agency region and place region that differ; pairs not both known are ignored."""
    a = agencies.select(F.col("id").alias("agency_id"), "parent_region")
    p = places.select(F.col("id").alias("place_id"), "region")
    pairs = visits.join(a, "agency_id").join(p, "place_id").where(F.col("parent_region").isNotNull() & F.col("region").isNotNull()).groupBy("parent_region", "region").agg(F.count(F.lit(1)).alias("n"))
    known = pairs.select("*", lookup(F.col("parent_region"), aliases).alias("a"), lookup(F.split_part("region", F.lit(" "), F.lit(1)), aliases).alias("b"))
    return known.where(F.col("a") != F.col("b")).select("parent_region", "region", "n")


#: The short names of regions by which addresses are searched; other regions are searched as they are.
SHORT_REGIONS = {
    "서울특별시": "서울",
    "대전광역시": "대전",
    "경기도": "경기",
    "인천광역시": "인천",
    "충청남도": "충남",
    "충청북도": "충북",
    "경상남도": "경남",
    "경상북도": "경북",
    "전라남도": "전남",
    "전라북도": "전북",
    "강원특별자치도": "강원",
    "제주특별자치도": "제주",
}


def short_region(region: str = "parent_region") -> Column:
    return F.coalesce(lookup(F.col(region), SHORT_REGIONS), F.col(region))


def geo_anomalies(visits: DataFrame, agencies: DataFrame, places: DataFrame, short: Column | None = None, more: list[str] | None = None) -> DataFrame:
    """Visits whose place lies, by both its addresses, outside the agency's region; short: how addresses name it.

    A NULL address makes NOT LIKE unknown, and an unknown is no anomaly: both addresses must be there. The place's own region is
    the first word of its road address, its old address or, where places have it, the part of one that is known.
    """
    short = short_region() if short is None else short
    # a pattern per row would be compiled for each pair: only names that hold a wildcard are matched as patterns
    a = agencies.select(F.col("id").alias("agency_id"), "parent_region", F.col("name").alias("agency_name")).withColumn("short", short).withColumn("wild", F.col("short").rlike(r"[%_\\]"))
    addresses = ["road_address", "jibun_address"] + (["road_address_part"] if "road_address_part" in places.columns else [])
    p = places.where(F.col("hidden_at").isNull() & F.col("deleted_at").isNull()).select(
        F.col("id").alias("place_id"), "road_address", "jibun_address", F.coalesce(*[F.split_part(c, F.lit(" "), F.lit(1)) for c in addresses]).alias("first_token")
    )
    pattern = F.concat(F.lit("%"), F.col("short"), F.lit("%"))
    named = lambda c: F.when(F.col("wild"), F.like(c, pattern)).otherwise(F.contains(F.col(c), F.col("short")))
    away = ~named("road_address") & ~named("jibun_address")
    return visits.join(a, "agency_id").join(p, "place_id").where(away).select("visit_id", "place_id", "agency_id", "short", "first_token", *(more or []))


def anomaly_groups(visits: DataFrame, agencies: DataFrame, places: DataFrame, short: Column | None = None, excerpt: str | None = None) -> DataFrame:
    """Per place with anomalies: visits, distinct agencies, up to three of their names and of the excerpts.

    Visits are counted per agency and place before addresses are looked at, so each pair is judged once.
    """
    kept = ["agency_id", "place_id"]
    if excerpt:  # the first three of each pair are enough for the first three of a place
        nth = F.row_number().over(Window.partitionBy(*kept).orderBy(F.col(excerpt).isNull(), "visit_id"))
        told = F.collect_list(F.when((F.col("nth") <= 3) & (F.col(excerpt) != ""), F.struct("visit_id", F.col(excerpt).alias("excerpt"))))
        pairs = visits.withColumn("nth", nth).groupBy(*kept).agg(F.count(F.lit(1)).alias("n"), told.alias("told"))
    else:
        pairs = visits.groupBy(*kept).agg(F.count(F.lit(1)).alias("n"), F.array().cast("array<struct<visit_id:bigint,excerpt:string>>").alias("told"))
    odd = geo_anomalies(pairs.withColumn("visit_id", F.lit(None).cast("long")), agencies, places, short, ["n", "told", "agency_name"])
    groups = odd.groupBy("place_id").agg(
        F.sum("n").alias("visits"),
        F.countDistinct("agency_id").alias("agencies"),
        F.slice(F.array_sort(F.collect_set("agency_name")), 1, 3).alias("names"),
        F.slice(F.transform(F.array_sort(F.flatten(F.collect_list("told"))), lambda x: x["excerpt"]), 1, 3).alias("excerpts"),
    )
    return groups if excerpt else groups.drop("excerpts")


def modal_agency(visits: DataFrame) -> DataFrame:
    """The agency with most visits per place; ties go to the smaller id."""
    n = visits.groupBy("place_id", "agency_id").agg(F.count(F.lit(1)).alias("n"))
    rn = F.row_number().over(Window.partitionBy("place_id").orderBy(F.desc("n"), "agency_id"))
    return n.withColumn("rn", rn).where("rn = 1").select("place_id", "agency_id", "n")


def orphans(places: DataFrame, visits: DataFrame) -> DataFrame:
    return places.select("id").join(visits.select(F.col("place_id").alias("id")), "id", "left_anti")


def candidate_scores(places: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best outer candidate per place: least of -1000 same id, -200 same name, -50 food, plus metres away."""
    j = places.select(F.col("id").alias("place_id"), F.col("name").alias("place_name"), F.col("kakao_place_id").alias("own_id"), F.col("lat").alias("plat"), F.col("lng").alias("plng")).join(candidates.hint("merge"), "place_id")  # several a place, in order already for the window below: never broadcast
    metres = haversine(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng"))
    exact = name_key(F.col("place_name")) == name_key(F.col("candidate_name"))
    off = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), -n).otherwise(0)
    total = off(F.col("candidate_id") == F.col("own_id"), 1000) + off(exact, 200) + off(F.col("group_code") == "FD6", 50) + F.coalesce(metres, F.lit(0.0))
    scored = j.select("place_id", "candidate_id", "own_id", "group_code", F.coalesce(exact, F.lit(False)).alias("name_exact"), metres.alias("metres"), total.alias("candidate_score"))
    rn = F.row_number().over(Window.partitionBy("place_id").orderBy("candidate_score", "candidate_id"))
    return scored.withColumn("rn", rn).where("rn = 1").drop("rn")


def _finding(status: str, reason: str) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))


def candidate_status(best: DataFrame) -> DataFrame:
    """(place_id, status, reason) from the best candidate; the order of the cases decides."""
    c = F.col
    case = (
        F.when(c("candidate_id").isNull(), _finding("manual_review", "no_candidate"))
        .when(c("candidate_id") == c("own_id"), _finding("pass", "same_id"))
        .when(c("group_code") != "FD6", _finding("manual_review", "not_food"))
        .when(c("name_exact") & (c("metres") <= 50), _finding("warn", "candidate_within_50m"))
        .when(c("metres") <= 300, _finding("manual_review", "candidate_within_300m"))
        .otherwise(_finding("fail", "candidate_over_300m"))
    )
    return best.select("place_id", case.alias("s")).select("place_id", "s.status", "s.reason")


HARD = ("missing_coordinates", "missing_source_url", "representative_policy_violation", "source_url_fail")


def marker_audit(markers: DataFrame) -> DataFrame:
    """(place_id, audit_status, audit_reasons): reasons in fixed order, then the gravest class."""
    c = F.col
    reason = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), name)
    reasons = F.array_compact(
        F.array(
            reason(c("kakao_place_id").isNull(), "missing_kakao_place_id"),
            reason(c("lat").isNull() | c("lng").isNull(), "missing_coordinates"),
            reason(c("missing_storage") > 0, "missing_storage_path"),
            reason(c("missing_url") > 0, "missing_source_url"),
            reason(c("missing_excerpt") > 0, "missing_raw_excerpt"),
            reason(c("masking_suspects") > 0, "masking_suspect"),
            reason(c("policy_violations") > 0, "representative_policy_violation"),
            reason(c("mean_confidence") < 0.8, "low_avg_confidence"),
            F.when(F.coalesce(c("kakao_status"), F.lit("manual_review")) != "pass", F.concat_ws("", F.lit("kakao_"), F.coalesce("kakao_status", F.lit("manual_review")), F.lit(":"), F.coalesce("kakao_reason", F.lit("missing_kakao_status")))),
            reason(c("url_fails") > 0, "source_url_fail"),
            reason(c("url_warns") > 0, "source_url_warn_or_manual_review"),
        )
    )
    hard = F.exists("r", lambda r: r.rlike("^(" + "|".join(HARD) + ")")) | (F.coalesce(F.col("kakao_status"), F.lit("")) == "fail")
    status = F.when(F.size("r") == 0, "pass").when(hard, "fail").when(F.exists("r", lambda r: F.contains(r, F.lit("manual_review"))), "manual_review").otherwise("warn")
    return markers.withColumn("r", reasons).select("place_id", status.alias("audit_status"), F.array_join("r", ";").alias("audit_reasons"))


def review_queue(markers: DataFrame) -> DataFrame:
    """(place_id, queue): the first queue that takes a marker; a coordinate of 0 counts as missing."""
    c = F.col
    located = F.coalesce((c("lat") != 0) & (c("lng") != 0), F.lit(False))
    queue = (
        F.when(c("non_place"), "likely-non-place")
        .when(~located, "missing-coordinates")
        .when(c("kakao_status") == "fail", "kakao-fail")
        .when((F.coalesce(c("url_warns"), F.lit(0)) > 0) | (F.coalesce(c("url_fails"), F.lit(0)) > 0), "source-review")
    )
    return markers.select("place_id", queue.alias("queue")).where(F.col("queue").isNotNull())


#: Share bounds of a go / no-go report.
GATES = {"coordinates": 0.90, "confidence": 0.80, "mismatch": 0.05}


def readiness(totals: DataFrame) -> DataFrame:
    """(gate, value, passed) rows of totals(places, located, mean_confidence, visits, mismatches)."""
    c = F.col
    gate = lambda name, value, passed: F.struct(F.lit(name).alias("gate"), value.alias("value"), passed.alias("passed"))
    rows = F.array(
        gate("coordinates", c("located") / F.nullif("places", F.lit(0)), c("located") >= GATES["coordinates"] * c("places")),
        gate("confidence", c("mean_confidence"), c("mean_confidence") >= GATES["confidence"]),
        gate("mismatch", c("mismatches") / F.nullif("visits", F.lit(0)), c("mismatches") <= GATES["mismatch"] * c("visits")),
    )
    return totals.select(F.explode(rows).alias("g")).select("g.gate", "g.value", "g.passed")


def verified_backfill(sources: DataFrame, objects: DataFrame) -> DataFrame:
    """(status, reason, n) of sources without a storage path against fetched contents: hash missing or different is final."""
    s = sources.where(F.col("storage_path").isNull()).select("source_id", "hash_sha256")
    j = s.join(objects.select("source_id", F.sha2("content", 256).alias("found")), "source_id", "left")
    status = (
        F.when(F.col("found").isNull(), _finding("retry", "not_fetched"))
        .when(F.col("hash_sha256").isNull(), _finding("failed", "hash_missing"))
        .when(F.col("hash_sha256") != F.col("found"), _finding("failed", "hash_mismatch"))
        .otherwise(_finding("stored", "verified"))
    )
    return j.select(status.alias("s")).groupBy("s.status", "s.reason").agg(F.count(F.lit(1)).alias("n"))
