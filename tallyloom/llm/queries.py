"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import (
    exact_dedup,
    fill_in_middle,
    fingerprints,
    html_text,
    langid,
    lm_scoring,
    longest_previous,
    mixing,
    packing,
    secrets,
    simhash,
    substrings,
    vector_codes,
)
from tallyloom.llm.common import id_crc_mod, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(langid.training_rows(docs))
    return langid.identify(docs, profiles).select("doc_id", (id_crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.cleaned(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(table(spark, sf_dir, "documents"), id_crc_mod("doc_id", 5) == 1)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_summary(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_classes(table(spark, sf_dir, "documents"))
    return classes.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = longest_previous.keep_first(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle_digests(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed_digests(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {
        "op5_mixing": mixing.MIXING_SQL.replace("{docs}", "documents"),
        "op7_exact_dedup": exact_dedup.EXACT_DEDUP_SQL.replace("{docs}", "documents"),
        "op11_suffix_array_dedup": longest_previous.KEEP_FIRST_SQL.replace("{docs}", "documents"),
        "op12_fill_in_middle": fill_in_middle.FILL_IN_MIDDLE_SQL.replace("{docs}", "documents"),
        "op13_vector_codes": vector_codes.VECTOR_CODES_SQL.replace("{vectors}", "embeddings"),
    }
