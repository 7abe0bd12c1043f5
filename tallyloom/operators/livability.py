"""The neighbourhood livability mart: latest metric, directional percentile in the parent, field mean, composite, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """The value of the last period per region and metric: general households, values that are there."""
    return (
        metrics.where((F.col("household_size") == 0) & F.col("value").isNotNull()).groupBy("adm_cd", "metric_key").agg(F.max_by("value", "ref_period").alias("value"))
    )


def metric_scores(metrics: DataFrame, catalog: DataFrame, regions: DataFrame) -> DataFrame:
    """Percentile of each metric among the parent's regions, turned over where less is better, times 100."""
    emd = regions.where(F.col("level") == "emd").select("adm_cd", "parent_cd")
    joined = latest_metrics(metrics).join(catalog.select("metric_key", "category", "direction"), "metric_key").join(emd, "adm_cd")
    rank = F.percent_rank().over(Window.partitionBy("parent_cd", "metric_key").orderBy("value"))
    return joined.select("adm_cd", "parent_cd", "category", "metric_key", (F.when(F.col("direction") == 1, rank).otherwise(1 - rank) * 100).alias("mscore"))


def fields(metrics: DataFrame, catalog: DataFrame, regions: DataFrame) -> DataFrame:
    return metric_scores(metrics, catalog, regions).groupBy("adm_cd", "parent_cd", "category").agg(F.avg("mscore").alias("raw"), F.count(F.lit(1)).alias("metric_count"))


def _two_places(c: Column) -> Column:
    return F.round(c.cast("decimal(20,10)"), 2).cast("double")


def field_scores(metrics: DataFrame, catalog: DataFrame, regions: DataFrame) -> DataFrame:
    w = Window.partitionBy("parent_cd", "category")
    return fields(metrics, catalog, regions).select(
        "adm_cd",
        "parent_cd",
        "category",
        _two_places(F.col("raw")).alias("field_score"),
        "metric_count",
        F.rank().over(w.orderBy(F.desc("raw"))).alias("rank_in_sigungu"),
        F.count(F.lit(1)).over(w).alias("sigungu_count"),
    )


def _sum_in_order(value: Column, order: Column) -> Column:
    """An aggregate: the sum of doubles in the order of a key, so that equal terms give equal sums in every run. A sum's last bits go by its order, and ranks by its last bits."""
    ordered = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("at"), value.alias("v")))))
    return F.when(F.size(ordered) > 0, F.aggregate(ordered, F.lit(0.0), lambda total, x: total + x["v"]))


def composite_scores(metrics: DataFrame, catalog: DataFrame, regions: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of the fields per profile and household size; a field without a weight drops out. Few fields make a sum."""
    scored = (
        fields(metrics, catalog, regions)
        .join(weights, "category")
        .groupBy("adm_cd", "parent_cd", "profile_version", "household_size")
        .agg((_sum_in_order(F.col("weight") * F.col("raw"), F.col("category")) / F.nullif(F.sum("weight"), F.lit(0))).alias("raw"), F.count(F.lit(1)).alias("field_count"))
    )
    w = Window.partitionBy("parent_cd", "profile_version", "household_size")
    return scored.select(
        "adm_cd",
        "parent_cd",
        "profile_version",
        "household_size",
        _two_places(F.col("raw")).alias("score"),
        "field_count",
        F.rank().over(w.orderBy(F.desc("raw"))).alias("rank_in_sigungu"),
        F.count(F.lit(1)).over(w).alias("sigungu_emd_count"),
    )


# ---- claims and one-line summaries -----------------------------------------------------------------


def claim(rank: Column, total: Column) -> Column:
    """Upper third strength, lower third weakness, strength first; nothing for a rank or total of 0."""
    return (
        F.when((rank <= 0) | (total <= 0), F.lit(None).cast("string"))
        .when(rank <= F.ceil(total / 3), "strength")
        .when(rank >= F.ceil(total * 2 / 3), "weakness")
    )


def top_share(rank: Column, total: Column) -> Column:
    """The rank as a percentage of all, half to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(rank * 100 / total).cast("int"))


def rule_summary(field_table: DataFrame, sentence: tuple[str, str] = ("Strong in ", ".")) -> DataFrame:
    """(adm_cd, claims, summary): the two best-ranked strengths, joined."""
    c = field_table.select("adm_cd", "category", "rank_in_sigungu", claim(F.col("rank_in_sigungu"), F.col("sigungu_count")).alias("claim"))
    strong = F.collect_list(F.when(F.col("claim") == "strength", F.struct("rank_in_sigungu", "category")))
    per = c.groupBy("adm_cd").agg(F.sort_array(strong).alias("strong"), F.count_if(F.col("claim") == "weakness").alias("weaknesses"))
    names = F.transform(F.slice("strong", 1, 2), lambda x: x["category"])
    text = F.when(F.size("strong") > 0, F.concat(F.lit(sentence[0]), F.array_join(names, "·"), F.lit(sentence[1])))
    return per.select("adm_cd", F.size("strong").alias("strengths"), "weaknesses", text.alias("summary"))


def summary_errors(text: Column, strengths: Column, banned: list[str], most: int = 80) -> Column:
    """Why a generated line is refused: empty, too long, a banned word, no strength named."""
    said = F.coalesce(text, F.lit(""))
    return F.array_compact(
        F.array(
            F.when(F.trim(said) == "", "empty"),
            F.when(F.char_length(said) > most, "too_long"),
            *[F.when(said.contains(w), f"banned:{w}") for w in banned],
            F.when(~F.exists(strengths, lambda s: F.contains(said, s)), "no_strength"),
        )
    )


def unpivoted_metrics(wide: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Wide rows of text to (key, metric_key, value); blanks, N/A and other non-numbers drop out."""
    long = wide.unpivot([key], names, "metric_key", "text")
    clean = F.regexp_replace(F.trim("text"), ",", "")
    return long.select(key, "metric_key", clean.try_cast("double").alias("value")).where(F.col("value").isNotNull())


def household_ratio(counts: DataFrame) -> DataFrame:
    """(region, size, households) to one row per region with sizes 1 to 4 and the share of single households."""
    p = counts.groupBy("region").pivot("size", [1, 2, 3, 4]).agg(F.sum("households"))
    named = p.select("region", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"h{k}") for k in (1, 2, 3, 4)])
    total = F.col("h1") + F.col("h2") + F.col("h3") + F.col("h4")
    return named.withColumn("solo_ratio", F.when(total > 0, F.round(F.col("h1") * 100.0 / total, 1)))
