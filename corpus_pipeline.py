"""A corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing.

Each stage works on what its predecessor kept; all but the last return the columns of documents.

Defined cases: a row goes only by a stage's decision on itself, also where it has no doc_id or shares one with
another text; of rows that share doc_id and text the longest stays from the second stage on; a row without
a doc_id loses every tie; an empty table runs through and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import exact_dedup, langid, mixing, packing, simhash
from tallyloom.llm.common import text_or_empty, written

#: A document whose best profile is this far off (1 - distance / worst) is in none of the languages.
LEAST_LANGUAGE_SCORE = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or unlike every profile, go."""
    found = langid.identified(docs, langid.learn(langid.training_rows(docs)))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: a row is found by its id, if it has one, and the digest of its text."""
    text = text_or_empty()
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    digest = F.sha2(F.regexp_replace(text, exact_dedup.SPACE, ""), 256)
    kept = exact_dedup.exact_dedup(docs).where("kept").select(own.alias("__own"), F.col("text_sha256").alias("__digest")).distinct()
    rows = docs.withColumns({"__own": own, "__digest": digest}).join(kept, ["__own", "__digest"], "left_semi")
    longest = rows.groupBy("__own", "__digest").agg(F.max_by(F.struct(*docs.columns), F.struct(F.char_length(text), text)).alias("__row"))
    return longest.select("__row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of near copies stays."""
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "near-rows")  # the key is read back, never made again
    classes = simhash.near_classes(rows, id_col="__row").select(F.col("id").alias("__row"), "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("__row"))).alias("least")
    kept = classes.join(rows.select("__row", "doc_id"), "__row").groupBy("component_id").agg(least).select("least.__row")
    return rows.join(kept, "__row", "left_semi").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' targets."""
    return mixing.emit_copies(mixing.mixed(docs)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mix), ("packing", pack)]

#: Language profiles, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
