"""Ranks and quantiles over very many distinct values, without a task or a buffer that holds them all."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.operators import grading, quality


def test_ranks_of_a_million_distinct_scores(spark):
    df = spark.range(1_000_000).select("id", (F.pmod(F.col("id") * 7_919_333, F.lit(1_000_003)) / F.lit(10)).cast("decimal(10,4)").alias("score"))
    ranked = grading.percent_rank_over_all(df, "score", "pct")
    assert "SinglePartition" not in ranked._jdf.queryExecution().executedPlan().toString()
    plain = df.withColumn("want", F.percent_rank().over(Window.orderBy("score")))
    off = ranked.join(plain.select("id", "want"), "id").where(F.abs(F.col("pct") - F.col("want")) > 1e-12)
    assert ranked.count() == 1_000_000 and off.count() == 0


def test_ranks_with_ties_nulls_groups_and_negative_values(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([None, r.randint(-20, 20), r.randint(-9_000_000, 9_000_000)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long").where("v IS NOT NULL")
    for by in ((), ("g",)):
        got = grading.below_and_all(df.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n")), "v", by)
        for x in got.collect():
            mine = [v for g, v in rows if v is not None and (not by or g == x["g"])]
            assert (x["below"], x["all"]) == (sum(v < x["v"] for v in mine), len(mine))
    assert grading.percent_rank_over_all(df.where("false"), "v", "p").collect() == []
    assert [x.p for x in grading.percent_rank_over_all(df.limit(1), "v", "p").collect()] == [0.0]


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_are_exact(spark, seed):
    r = np.random.default_rng(seed)
    kinds = [r.normal(size=5000), np.exp(r.normal(size=5000) * 80), r.integers(0, 4, 5000).astype(float), np.concatenate([[-1e308, 1e308], np.nextafter(1.0, 2) ** np.arange(200), np.ones(3000), -np.ones(11)])]
    for values in kinds:
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        got = quality.exact_quantiles(df, "v", (0.0, 0.1, 0.5, 0.9, 1.0))
        for p, v in got.items():
            assert v == pytest.approx(float(np.quantile(values, p)), rel=1e-12)


def test_quantiles_of_little(spark):
    assert quality.exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", (0.1, 0.9)) == {0.1: None, 0.9: None}
    one = quality.confidence_percentiles(spark.createDataFrame([(4.0,)], "v double"), "v").first()
    assert tuple(one) == (4.0, 4.0, 4.0)
    none = quality.confidence_percentiles(spark.createDataFrame([], "v double"), "v").first()
    assert tuple(none) == (None, None, None)
    plan = quality.confidence_percentiles(spark.range(10).selectExpr("id * 1.0D AS v"), "v")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan
