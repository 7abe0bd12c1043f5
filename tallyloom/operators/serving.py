"""Serving queries: lists, search, detail, counts and rankings over the public views."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import vocabulary as V
from tallyloom.functions.dates import bound
from tallyloom.functions.predicates import in_box, one_of, since_months, visible
from tallyloom.functions.text import keyword_category


def places_list(public: DataFrame, box=None, grades: list[str] | None = None, limit: int = 100) -> DataFrame:
    """Map markers: located places, best first."""
    rows = public.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & one_of("grade", grades))
    if box:
        rows = rows.where(in_box(box))
    return rows.orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("last_visit_at"), "id").limit(limit)


SORTS = {
    "score": ("name_prefix_match", "score", "last_visit_at"),
    "recent": ("last_visit_at", "score"),
    "visits": ("visit_count", "score"),
}


def search(
    public: DataFrame, visits: DataFrame, as_of: date, q: str | None = None, regions: list[str] | None = None, grades: list[str] | None = None, sort: str = "score", limit: int = 50
) -> DataFrame:
    """Places whose name, address, category or a visiting department holds q; which fields matched is told."""
    pattern = f"%{q}%" if q else None
    holds = lambda c: c.ilike(pattern) if pattern else F.lit(False)
    per_head = F.when(F.col("party_size") > 0, F.col("amount") / F.col("party_size"))
    agg = visits.where(since_months("visit_date", as_of, 12)).groupBy("place_id").agg(
        F.countDistinct("agency_id").alias("agencies"),
        F.round(F.avg(per_head)).cast("int").alias("avg_amount_per_person"),
        F.bool_or(holds(F.col("department_name"))).alias("department_match"),
    )
    rows = public.where(one_of("grade", grades) & one_of("region", regions)).join(agg, public["id"] == agg["place_id"], "left")
    department = F.coalesce("department_match", F.lit(False))
    fields = [(F.col("name"), "name"), (F.col("road_address"), "address"), (F.col("category"), "category")]
    matched = F.array_compact(F.array(*[F.when(holds(c), n) for c, n in fields], F.when(department & F.lit(pattern is not None), "department")))
    rows = rows.withColumns(
        {
            "unique_agency_count": F.coalesce("agencies", F.lit(0)),
            "name_prefix_match": F.coalesce(F.col("name").ilike(f"{q}%"), F.lit(False)) if q else F.lit(False),
            "matched_fields": matched,
        }
    )
    if pattern:
        hit = department
        for c, _ in fields:
            hit = hit | F.coalesce(holds(c), F.lit(False))
        rows = rows.where(hit)
    order = [F.desc_nulls_last(c) for c in SORTS[sort]]
    return rows.orderBy(*order, "id").limit(limit).select("id", "name", "region", "category", "score", "grade", "last_visit_at", "visit_count", "unique_agency_count", "avg_amount_per_person", "matched_fields")


def place_visits(public_visits: DataFrame, place_id, limit: int = 100) -> DataFrame:
    return public_visits.where(F.col("place_id") == place_id).orderBy(F.desc("visit_date"), "visit_id").limit(limit)


def stats_summary(public: DataFrame, visits: DataFrame, agencies: DataFrame, places: DataFrame) -> DataFrame:
    """Four totals in one row."""
    shown = places.where(visible()).select(F.col("id").alias("place_id"))
    seen = visits.join(shown, "place_id", "left_semi")
    return (
        public.agg(F.count(F.lit(1)).alias("places"))
        .crossJoin(seen.agg(F.count(F.lit(1)).alias("visits"), F.max("visit_date").alias("last_visit_at")))  # one row each
        .crossJoin(agencies.agg(F.count(F.lit(1)).alias("agencies")))
    )


def region_counts(public: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Counts per region by grade; with a registry (region, label), its regions without places too."""
    counts = public.where(F.col("region").isNotNull()).groupBy("region").agg(
        F.count(F.lit(1)).alias("place_count"),
        F.count_if(F.col("grade") == "★★★").alias("top_place_count"),
        F.count_if(F.col("grade") == "★★").alias("recommended_place_count"),
        F.count_if(F.col("grade") == "✦").alias("new_place_count"),
        F.max("last_visit_at").alias("last_visit_at"),
    )
    if registry is None:
        return counts.withColumn("label", F.col("region"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    names = ["place_count", "top_place_count", "recommended_place_count", "new_place_count"]
    return registry.join(counts, "region", "left").select("region", "label", *[zero(c) for c in names], "last_visit_at")


def region_tree(regions: DataFrame) -> DataFrame:
    """(adm_cd, name, children): upper regions with their sorted children."""
    child = regions.where((F.col("level") == "sigungu") & F.col("parent_cd").isNotNull()).groupBy("parent_cd").agg(F.array_sort(F.collect_list(F.struct("adm_cd", "name"))).alias("children"))
    top = regions.where(F.col("level") == "sido").select("adm_cd", "name")
    return top.join(child, top.adm_cd == child.parent_cd, "left").select("adm_cd", "name", F.coalesce("children", F.array().cast("array<struct<adm_cd:string,name:string>>")).alias("children"))


def labelled(column: str, labels: dict[str, str]) -> Column:
    """A lookup that passes unknown values through."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.element_at(table, F.col(column)), F.col(column))


def with_taxonomy(agencies: DataFrame, legacy: dict[str, dict[str, str]], labels: dict[str, dict[str, str]]) -> DataFrame:
    """Fills taxonomy columns from the legacy kind, and labels from the columns."""
    for column in labels:
        of_kind = {k: v[column] for k, v in legacy.items() if column in v}
        filled = F.col(column)
        if of_kind:
            filled = F.coalesce(filled, F.element_at(F.create_map(*[F.lit(x) for kv in of_kind.items() for x in kv]), F.col("kind")))
        agencies = agencies.withColumn(column, filled).withColumn(f"{column}_label", F.element_at(F.create_map(*[F.lit(x) for kv in labels[column].items() for x in kv]), F.col(column)))
    return agencies


def agency_order(language: str | None = "ko") -> list[Column]:
    """Blank first, then by the language's collation (None: by code points)."""
    text = lambda c: F.collate(F.nullif(F.col(c), F.lit("")), language) if language else F.nullif(F.col(c), F.lit(""))
    return [F.asc_nulls_first(text(c)) for c in ("gov_tier", "branch", "expansion_phase", "parent_region", "sub_region", "short_name")]


def subregions(composite: DataFrame, metrics: DataFrame, regions: DataFrame, parent: str, metric: str, household: int = 1, profile: int = 1) -> DataFrame:
    """Ranked children of a region with one metric beside them (all its periods, as stored)."""
    s = composite.where((F.col("parent_cd") == parent) & (F.col("household_size") == household) & (F.col("profile_version") == profile))
    m = metrics.where((F.col("metric_key") == metric) & (F.col("household_size") == 0)).select("adm_cd", F.col("value").alias("metric_value"))
    names = regions.select("adm_cd", "name")
    return s.join(names, "adm_cd").join(m, "adm_cd", "left").select("adm_cd", "name", "score", "rank_in_sigungu", "sigungu_emd_count", "metric_value")


def field_map(field_table: DataFrame) -> DataFrame:
    """(adm_cd, fields): category to score as a map, aggregated once instead of per row."""
    return field_table.groupBy("adm_cd").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "field_score")))).alias("fields"))


def boundaries(regions: DataFrame, composite: DataFrame, field_table: DataFrame, household: int = 1) -> DataFrame:
    s = composite.where(F.col("household_size") == household).select("adm_cd", "score", "rank_in_sigungu")
    return regions.where(F.col("level") == "emd").select("adm_cd", "name", "parent_cd").join(s, "adm_cd", "left").join(field_map(field_table), "adm_cd", "left")


def best_summary(summaries: DataFrame, household: int, profile: int = 1) -> DataFrame:
    """Per region the line for this household size, else the general one."""
    rows = summaries.where(F.col("household_size").isin(0, household) & (F.col("profile_version") == profile))
    return rows.groupBy("adm_cd").agg(F.max_by(F.struct("summary", "source"), "household_size").alias("best")).select("adm_cd", "best.summary", "best.source")


def boundary(boundaries: DataFrame, adm_cd: str) -> DataFrame:
    """The stored polygon of one neighbourhood, of which the code must have eight digits."""
    if len(adm_cd) != 8 or not (adm_cd.isascii() and adm_cd.isdigit()):
        raise ValueError("adm_cd must have eight digits")
    return boundaries.where(F.col("adm_cd") == adm_cd).select("adm_cd", "geojson")


def poi_evidence(counts: DataFrame, types: DataFrame) -> DataFrame:
    """Points of interest within each neighbourhood, by type in their order; types without any are left out."""
    inside = counts.where((F.col("distance_basis") == "pip") & (F.col("count") > 0)).select("adm_cd", "poi_type", "count")
    return inside.join(types, "poi_type").select("adm_cd", "category", "poi_type", "display_name", "count", "sort_order")


def highlights(field_table: DataFrame, evidence: DataFrame | None = None, most: int = 2) -> DataFrame:
    """(adm_cd, strengths, weaknesses, evidence): upper third best first, lower third worst first, and what is there
    of the first strengths. A field can be both where there are few."""
    rank, total = F.col("rank_in_sigungu"), F.col("sigungu_count")
    strong = F.sort_array(F.collect_list(F.when(rank <= F.ceil(total / 3), F.struct("rank_in_sigungu", "category"))))
    weak = F.sort_array(F.collect_list(F.when(rank >= F.ceil(total * 2 / 3), F.struct((-rank).alias("r"), "category"))))
    names = lambda c: F.transform(c, lambda x: x["category"])
    per = field_table.groupBy("adm_cd").agg(names(strong).alias("strengths"), names(weak).alias("weaknesses"))
    if evidence is None:
        return per
    e = evidence.groupBy("adm_cd").agg(F.array_sort(F.collect_list(F.struct("sort_order", "category", "display_name", "count"))).alias("all"))
    shown = F.filter(F.coalesce("all", F.array().cast("array<struct<sort_order:int,category:string,display_name:string,count:bigint>>")), lambda x: F.array_contains(F.slice("strengths", 1, most), x["category"]))
    return per.join(e, "adm_cd", "left").select("adm_cd", "strengths", "weaknesses", F.transform(shown, lambda x: F.concat_ws(" ", x["display_name"], x["count"].cast("string"))).alias("evidence"))


def top_percent(rank: Column, total: Column) -> Column:
    return F.round(rank * 100.0 / total).cast("int")


def reaction_counts(reactions: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Likes and dislikes per place; with places, a row of zeros for those without reactions."""
    c = reactions.groupBy("place_id").agg(F.count_if(F.col("reaction") == "like").alias("like_count"), F.count_if(F.col("reaction") == "dislike").alias("dislike_count"))
    if places is None:
        return c
    return places.select(F.col("id").alias("place_id")).join(c, "place_id", "left").select("place_id", F.coalesce("like_count", F.lit(0)).alias("like_count"), F.coalesce("dislike_count", F.lit(0)).alias("dislike_count"))


def posts_by_activity(posts: DataFrame, comments: DataFrame, category: str | None = None, limit: int = 30) -> DataFrame:
    """Posts that are shown with the count and last time of their shown comments, most lately active first."""
    shown = lambda df: df.where(F.col("hidden_at").isNull() & F.col("deleted_at").isNull())
    c = shown(comments).groupBy("post_id").agg(F.count(F.lit(1)).alias("comment_count"), F.max("created_at").alias("last_comment_at"))
    rows = shown(posts).where(one_of("category", [category] if category else None)).join(c, "post_id", "left")
    rows = rows.select("post_id", "category", "created_at", F.coalesce("comment_count", F.lit(0)).alias("comment_count"), "last_comment_at")
    return rows.orderBy(F.coalesce("last_comment_at", "created_at").desc(), "post_id").limit(limit)


def client_list(public: DataFrame, text: str = "", grades: list[str] | None = None, regions: list[str] | None = None, closed: bool = False) -> DataFrame:
    """The client's re-filter: case-folded containment in what it shows; a coordinate of 0 counts as missing."""
    rows = public.where(one_of("grade", grades) & one_of("region", regions))
    if not closed:
        rows = rows.where(~F.col("is_closed"))
    if text:
        shown = F.concat_ws(" ", "name", "road_address", "region", "category")
        food = keyword_category(F.concat_ws(" ", "name", "category", "road_address"), V.FOOD, V.DEFAULT_FOOD)
        labels = F.create_map(*[F.lit(x) for kv in V.FOOD_LABELS.items() for x in kv])
        haystack = bound(food, lambda f: F.lower(F.concat_ws(" ", shown, f, F.element_at(labels, f))))
        # the category is looked up only where what is shown does not hold the text by itself
        rows = rows.where(F.lower(shown).contains(text.lower()) | haystack.contains(text.lower()))
    located = F.coalesce((F.col("lat") != 0) & (F.col("lng") != 0), F.lit(False))
    return rows.withColumn("on_map", located)


def clusters(public: DataFrame, centre: tuple[float, float]) -> DataFrame:
    """Mean position and count per region; missing coordinates count as the centre."""
    at = lambda c, k: F.avg(F.coalesce(F.col(c), F.lit(centre[k])))
    return public.groupBy(F.coalesce("region", F.lit("unknown")).alias("label")).agg(F.count(F.lit(1)).alias("n"), at("lat", 0).alias("lat"), at("lng", 1).alias("lng"))


def top_sitemap(public: DataFrame, base: str, limit: int = 5000) -> DataFrame:
    slug = F.trim(F.lower(F.regexp_replace("name", r"[^0-9A-Za-z가-힣]+", "-")), F.lit("-"))
    rows = public.orderBy(F.desc_nulls_last("score"), "id").limit(limit)
    return rows.select("id", F.concat(F.lit(base + "/"), slug, F.lit("-"), F.col("id").cast("string")).alias("loc"), "score")


def running_mean(daily: DataFrame, day: str, value: str, before: int = 7) -> DataFrame:
    """Each day's value beside the mean of the days before it, and whether it is off by more than 30 %."""
    w = Window.orderBy(day).rowsBetween(-before, -1)
    mean = F.avg(value).over(w)
    return daily.select(day, value, mean.alias("mean_before"), F.coalesce(F.abs(F.col(value) - mean) > 0.3 * mean, F.lit(False)).alias("alert"))
