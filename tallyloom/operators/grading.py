"""The visit grading mart: window, aggregate, score, percentile, grade.

Inputs: places(id, region, category, ..., visibility columns) and visits(place_id, agency_id,
visit_date, department_name). Both percentiles rank over one row per place.

No window runs over places, and none over all distinct scores: scores are counted by value, and a score's rank is what the
scores of lower high digits count together, plus those of the same high digits and lower low ones; see below_and_all().
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.predicates import since_months, visible

SMALL_REGION = 30  # places; smaller regions are ranked nationwide
NEW_MONTHS, NEW_VISITS = 3, 2


LOW_BITS = 17  # of a score's digits: a window over low digits has 2^17 rows at most, and so has that over the high ones of a DECIMAL(10, 4)


def below_and_all(counts: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., value, n: how often) to these with below (how many are less) and all, within by. value: a decimal or an integer.

    The value's unscaled digits are parted into high and low ones. Low ones are ordered in windows of their high ones, high ones
    in one window of a row each, so that no task orders more than 2^17 rows of a window, however many distinct values there are.
    """
    kind = counts.schema[value].dataType
    scale = getattr(kind, "scale", 0)
    digits = (F.col(value) * F.lit(10**scale)).cast("long")
    cut = counts.withColumns({"__high": F.shiftright(digits, LOW_BITS), "__low": digits.bitwiseAND(F.lit((1 << LOW_BITS) - 1))})
    heads = cut.groupBy(*by, "__high").agg(F.sum("n").alias("__n"))
    # without by, one window holds all high digits; it is keyed by a hash, not by nothing, so that it is dealt like others
    group = Window.partitionBy(*(by or (F.pmod(F.hash("__high"), F.lit(1)),)))
    upto = lambda w, order, n: F.sum(n).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)
    top = heads.withColumns({"__under": upto(group, "__high", "__n"), "all": F.sum("__n").over(group)}).drop("__n")
    inner = cut.withColumn("__in", upto(Window.partitionBy(*by, "__high"), "__low", "n"))
    same = [F.col(f"i.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*by, "__high")]
    joined = inner.alias("i").join(top.alias("t"), same)
    return joined.select(*[F.col(f"i.{c}").alias(c) for c in (*by, value, "n")], (F.col("__in") + F.col("__under")).alias("below"), "all")


def percent_rank_over_all(df: DataFrame, value: str, out: str) -> DataFrame:
    """percent_rank() OVER (ORDER BY value) without NULL values, as a join to the ranks of distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    share = F.when(F.col("all") > 1, F.col("below").cast("double") / (F.col("all") - 1)).otherwise(F.lit(0.0))
    return df.join(below_and_all(counts, value).select(value, share.alias(out)), value, "left")


def visit_aggregates(visits: DataFrame, places: DataFrame, as_of: date, months: int = 12) -> DataFrame:
    """Per visible place: visits, departments, agencies, first and last day within the look-back."""
    window = visits.where(since_months("visit_date", as_of, months)).select("place_id", "agency_id", "department_name", "visit_date")
    shown = places.where(visible()).select(F.col("id").alias("place_id"), "region")
    per = window.groupBy("place_id").agg(
        F.count(F.lit(1)).alias("visit_count"),
        F.countDistinct("department_name").alias("department_count"),
        F.countDistinct("agency_id").alias("agency_count"),
        F.min("visit_date").alias("first_visit_at"),
        F.max("visit_date").alias("last_visit_at"),
    )
    return per.join(shown, "place_id")


def score(visit_count: str = "visit_count", departments: str = "department_count") -> Column:
    """visits x log10(departments + 1), to four decimals."""
    return (F.col(visit_count) * F.log10(F.col(departments) + 1)).cast("decimal(10,4)")


def grade(percentile: Column, visit_count: Column, first_visit: Column, as_of: date) -> Column:
    """The new track comes first; below the 40th percentile there is no grade."""
    fresh = (visit_count <= NEW_VISITS) & since_months(first_visit, as_of, NEW_MONTHS)
    return (
        F.when(fresh, "✦").when(percentile >= 0.90, "★★★").when(percentile >= 0.70, "★★").when(percentile >= 0.40, "★").otherwise(F.lit(None).cast("string"))
    )


def place_grade(places: DataFrame, visits: DataFrame, as_of: date) -> DataFrame:
    """One row per visible place with visits in the look-back; NULL regions form one region."""
    scored = visit_aggregates(visits, places, as_of).withColumn("score", score())
    counts = scored.groupBy("region", "score").agg(F.count(F.lit(1)).alias("n"))
    ranks = below_and_all(counts, "score", ("region",)).select(F.col("region").alias("of_region"), F.col("score").alias("of_score"), "below", F.col("all").alias("region_places"))
    ranked = scored.join(ranks, F.col("region").eqNullSafe(F.col("of_region")) & (F.col("score") == F.col("of_score"))).drop("of_region", "of_score")
    ranked = ranked.withColumn("region_pct", F.when(F.col("region_places") > 1, F.col("below").cast("double") / (F.col("region_places") - 1)).otherwise(F.lit(0.0)))
    ranked = percent_rank_over_all(ranked, "score", "nation_pct")
    pct = F.when(F.col("region_places") >= SMALL_REGION, F.col("region_pct")).otherwise(F.col("nation_pct"))
    return ranked.withColumn("pct", pct).select(
        "place_id",
        "region",
        "visit_count",
        "department_count",
        "agency_count",
        "first_visit_at",
        "last_visit_at",
        "score",
        F.col("region_places").alias("region_places"),
        "pct",
        grade(F.col("pct"), F.col("visit_count"), F.col("first_visit_at"), as_of).alias("grade"),
    )


def agency_stats(agencies: DataFrame, visits: DataFrame, places: DataFrame) -> DataFrame:
    """Per agency, without visits too: visits to visible places, distinct ones, last day."""
    shown = places.where(visible()).select(F.col("id").alias("place_id"))
    seen = visits.join(shown, "place_id", "left_semi").groupBy("agency_id").agg(
        F.count(F.lit(1)).alias("visit_count"),
        F.countDistinct("place_id").alias("place_count"),
        F.max("visit_date").alias("last_visit_at"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return agencies.select(F.col("id").alias("agency_id")).join(seen, "agency_id", "left").select("agency_id", zero("visit_count"), zero("place_count"), "last_visit_at")


def places_public(places: DataFrame, grades: DataFrame) -> DataFrame:
    """Visible places; one that was never visited, or is ungraded, shows as new with score 0 or its own."""
    g = grades.select(F.col("place_id").alias("id"), "score", "grade", "visit_count", "last_visit_at")
    return (
        places.where(visible())
        .select("id", "name", "region", "category", "road_address", "lat", "lng", "is_closed")
        .join(g, "id", "left")
        .select(
            "id",
            "name",
            "region",
            "category",
            "road_address",
            "lat",
            "lng",
            "is_closed",
            F.coalesce("score", F.lit(0).cast("decimal(10,4)")).alias("score"),
            F.coalesce("grade", F.lit("✦")).alias("grade"),
            F.coalesce("visit_count", F.lit(0)).alias("visit_count"),
            "last_visit_at",
        )
    )


def place_visits_public(visits: DataFrame, places: DataFrame, sources: DataFrame, agencies: DataFrame) -> DataFrame:
    """Visits to visible places with their source and agency; the dimensions are small and Catalyst may broadcast them."""
    shown = places.where(visible()).select(F.col("id").alias("place_id"), F.col("name").alias("place_name"))
    return (
        visits.join(shown, "place_id")
        .join(sources.select(F.col("id").alias("source_id"), "source_title", "published_at"), "source_id")
        .join(agencies.select(F.col("id").alias("agency_id"), F.col("name").alias("agency_name"), "parent_region"), "agency_id")
        .select("visit_id", "place_id", "place_name", "agency_id", "agency_name", "parent_region", "visit_date", "amount", "party_size", "department_name", "source_title")
    )
