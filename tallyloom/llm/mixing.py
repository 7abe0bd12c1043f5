"""Mixing sources to target weights.

Token totals per source (a partial aggregate, then one row per source) give each source its
target, target / size its repetition rate, and every document floor(rate) copies plus one
further copy with probability equal to the fraction. That draw is a hash of seed and id, so
reruns and retried tasks agree and no state is kept.

Targets: a budget of ``share`` times all words is dealt by weight; a source stops at ``most``
times its own size and what it leaves is dealt again by weight. That fixed point is
min(most * size, level * weight) with one common level, found by ordering the sources by
most * size / weight: no iteration is needed.

Defined cases: null text has no words; a source without words has target 0 and its documents
no copies; null sources form the last source; rows that share an id share its draw; a row without an id draws by its
text; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.common import WORD, text_or_empty, written

BROADCAST_ROWS = 10_000  # a table of sources up to this length is broadcast


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, source_size, target, rate) of (source, size) rows; one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy((F.col("cap").cast("double") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    upto, every = order.rowsBetween(Window.unboundedPreceding, 0), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select(
        "*",
        F.sum("cap").over(upto).alias("caps"),
        (F.sum("w").over(every) - F.sum("w").over(upto)).alias("w_after"),
        (F.sum("source_size").over(every).cast("double") * share).alias("budget"),
    )
    # capped if the level at which this source fills up still fits the budget
    capped = F.col("caps") + F.col("cap").cast("double") / F.col("w") * F.col("w_after") <= F.col("budget")
    per = per.withColumn("capped", capped)
    left = F.col("budget") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)
    w_left = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(every)
    per = per.select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(left / w_left * F.col("w")).alias("target"),
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return per.withColumn("rate", rate)


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """docs' own columns in ``row``, and size, source_size, target, copies of each of its rows."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("source"), F.col(id_col).alias("id"), F.when(F.col(id_col).isNull(), text_or_empty(text_col)).alias("text"), word_count(text_col).alias("size"))
    targets = source_targets(docs.select(F.col(source_col).alias("source"), word_count(text_col).alias("size")), weights, share, most)
    if docs.columns != [id_col, text_col, source_col]:  # whole rows travel: make sure that they don't have to, if sources are few
        targets = written(targets, "targets")
        targets = F.broadcast(targets) if targets.count() <= BROADCAST_ROWS else targets
    # 52 bits of an md5 as a number in [0, 1)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.md5("text")))), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    joined = rows.join(targets.withColumnRenamed("source", "target_source"), F.col("source").eqNullSafe(F.col("target_source")))
    return joined.select("row", "id", "size", "source_size", "target", copies.cast("long").alias("copies"))


def emit_copies(mix: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, with the columns it came with."""
    return mix.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def mixing_summary(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken)."""
    return mixed(docs.select("doc_id", "text", "source")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: {docs}: the table; columns as mixing_summary, plus copies.
MIXING_CTE = r"""
sz AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {docs}),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sz GROUP BY source),
wt AS (SELECT *, source_size * 2 AS cap, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM per),
cu AS (SELECT *, sum(cap) OVER o AS caps, sum(w) OVER () - sum(w) OVER o AS w_after, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM wt
       WINDOW o AS (ORDER BY cap::DOUBLE / w::DOUBLE ASC, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cp AS (SELECT *, caps::DOUBLE + cap::DOUBLE / w::DOUBLE * w_after::DOUBLE <= budget AS capped FROM cu),
tg AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
         (budget - (sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE) / (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::DOUBLE * w::DOUBLE END AS target FROM cp),
rt AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate FROM tg),
mx AS (SELECT sz.*, rt.source_size, rt.target, (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE / pow(2.0, 52)
         < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM sz JOIN rt ON sz.source IS NOT DISTINCT FROM rt.source)
"""
MIXING_SQL = f"WITH {MIXING_CTE} SELECT doc_id, size, source_size, target, size * copies AS taken FROM mx"
