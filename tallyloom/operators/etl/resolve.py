"""Entity resolution over looked-up candidates: validation, choice, fallback cascade, natural keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import text
from tallyloom.functions import vocabulary as V
from tallyloom.functions.geo import geohash, haversine

NEAR_SOURCE, NEAR_AGENCY, NEAR_REGIONAL = 300.0, 15_000.0, 50_000.0  # metres


def natural_key(name: Column, address: Column, lat: Column, lng: Column) -> Column:
    """Hash of the name's key and the place: its geohash if located, else its address key."""
    return F.sha1(F.concat_ws("|", text.name_key(name), F.coalesce(geohash(lat, lng), text.address_key(address))))


def region_name(c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in V.REGION_ALIASES.items() for x in kv]), c)


def tokens(address: Column) -> Column:
    """Words of an address; spaces go first, so it is nearly the whole that must agree."""
    parts = F.split(F.trim(F.regexp_replace(text.address_key(address), r"[^가-힣A-Za-z0-9]+", " ")), " ")
    return F.filter(parts, lambda t: t != "")


def acceptable(prefix_place: str = "", candidate: str = "c_") -> Column:
    """Whether a candidate may be the place. Columns: name, address_hint, source_lat/lng, agency_lat/lng, agency_tier,
    parent_region; candidate columns with their prefix: name, road_address, jibun_address, lat, lng."""
    p, c = (lambda n: F.col(prefix_place + n)), (lambda n: F.col(candidate + n))
    address = F.coalesce(F.nullif(c("road_address"), F.lit("")), c("jibun_address"))
    part = text.region_part(address)
    no = F.lit(False)
    unlike = ~F.coalesce(text.common_hangul(text.name_key(p("name")), text.name_key(c("name"))), F.lit(True))
    blind = F.coalesce(p("address_hint"), F.lit("")) == ""
    from_agency = haversine(p("agency_lat"), p("agency_lng"), c("lat"), c("lng"))
    most = F.when(p("agency_tier").isin("national", "constitutional"), F.lit(None).cast("double")).when(p("agency_tier") == "regional", NEAR_REGIONAL).otherwise(NEAR_AGENCY)
    far = blind & (from_agency > most)
    elsewhere = region_name(p("parent_region")) != region_name(F.split_part(part, F.lit(" "), F.lit(1)))
    from_source = haversine(p("source_lat"), p("source_lng"), c("lat"), c("lng"))
    other_part = text.region_part(p("address_hint")) != part
    ours, theirs = tokens(p("address_hint")), tokens(address)
    shares = (F.size(ours) == 0) | (F.size(theirs) == 0) | F.arrays_overlap(ours, theirs)
    return (
        F.when(unlike, no)
        .when(F.coalesce(far, no), no)
        .when(F.coalesce(elsewhere, no), no)
        .when(from_source.isNotNull(), from_source <= NEAR_SOURCE)
        .when(blind, True)
        .when(F.coalesce(other_part, no), no)
        .otherwise(shares)
    )


def best_candidates(places: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per place its first acceptable query's choice: a food place if the answer has one, else the first.

    candidates: place_key, query_no, rank, c_id, c_name, c_group_code, c_category, c_road_address, c_jibun_address, c_lat, c_lng.
    """
    w = Window.partitionBy("place_key", "query_no").orderBy((F.coalesce(F.col("c_group_code"), F.lit("")) != V.FOOD_CODE), "rank")
    chosen = candidates.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    fine = places.join(chosen, "place_key").where(acceptable())
    first = F.row_number().over(Window.partitionBy("place_key").orderBy("query_no"))
    return fine.withColumn("rn", first).where("rn = 1").drop("rn")


def resolved(places: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every place with its candidate, or its own data at the source's, else the agency's, coordinates."""
    best = best_candidates(places, candidates).select("place_key", *[c for c in candidates.columns if c.startswith("c_")])
    j = places.join(best, "place_key", "left")
    hit = F.col("c_name").isNotNull()
    name = F.coalesce("c_name", "name")
    lat = F.when(hit, F.col("c_lat")).otherwise(F.coalesce("source_lat", "agency_lat"))
    lng = F.when(hit, F.col("c_lng")).otherwise(F.coalesce("source_lng", "agency_lng"))
    road = F.when(hit, F.nullif("c_road_address", F.lit(""))).otherwise(F.col("address_hint"))
    jibun = F.when(hit, F.col("c_jibun_address"))
    address = F.coalesce(road, jibun, "address_hint")
    brand = text.chain_brand(name)
    return j.select(
        "place_key",
        F.col("c_id").alias("kakao_place_id"),
        natural_key(F.col("name"), address, lat, lng).alias("natural_key"),
        name.alias("name"),
        road.alias("road_address"),
        jibun.alias("jibun_address"),
        text.region_part(address).alias("region"),
        lat.alias("lat"),
        lng.alias("lng"),
        F.col("c_category").alias("category"),
        F.coalesce(F.col("c_id"), F.lit("")).alias("c_id_or_blank"),
        (F.coalesce(F.col("c_id"), F.lit("")) != "").alias("matched"),
        text.is_place_name(name).alias("valid_place"),
        F.when(hit, text.is_restaurant(F.col("c_group_code"), F.col("c_category"))).otherwise(True).alias("is_restaurant_like"),
        brand.isNotNull().alias("is_large_chain"),
        brand.alias("chain_brand"),
    ).drop("c_id_or_blank")


def cached_answers(queries: DataFrame, cache: DataFrame, now: Column, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(queries with an answer not older than so many days, queries still to ask); key and answer columns of the cache."""
    fresh = cache.where(F.col("created_at") > now - F.make_dt_interval(F.lit(days)))
    return queries.join(fresh, "query_key"), queries.join(fresh.select("query_key"), "query_key", "left_anti")
