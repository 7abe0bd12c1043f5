"""Exact dedup by skew-safe combining, in DataFrame functions only.

Rows are combined three times, each time by digest *and* full content: within each map task
(the partial aggregate before the first shuffle), per salted digest group, and over the at most
``salts`` winners that a content then has. A content that a third of all rows share reaches no
task with more than one row per map task and salt.

The way back from contents to documents carries no text: a document finds its group by SHA-256,
a second 64-bit hash, length and salt. Two contents that shared all of these would be told apart
by the combining steps, and the lookup then fails loudly instead of merging them.

Defined cases: null text counts as empty; empty texts form one group; ties go to the smaller id;
a null id loses every tie; rows that repeat one id count one by one in ``group_size`` and are
all kept if that id stays; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.common import text_or_empty

SPACE = r"[\x20\x09-\x0D]+"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row of docs.

    salts: a quarter of the session's shuffle partitions, 16 at least, so that the share of a hot content that one
    task gets falls as the cluster grows.
    """
    salts = salts or max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.char_length(text).cast("long").alias("n_chars"),
        F.regexp_replace(text, SPACE, "").alias("content"),
    ).select(
        "id",
        "n_chars",
        "content",
        F.sha2("content", 256).alias("digest"),
        F.xxhash64("content").alias("second"),
        F.char_length("content").alias("length"),
        F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"),
    )
    key = ["digest", "second", "length"]
    # the longest original, then the smallest id: the greatest of (n_chars, -id)
    salted = rows.groupBy(*key, "salt", "content").agg(
        F.max(F.struct(F.col("n_chars"), (-F.col("id")).alias("neg_id"))).alias("best"), F.count(F.lit(1)).alias("n")
    )
    combined = (
        salted.repartition("digest")
        .groupBy(*key, "content")
        .agg(F.max("best").alias("best"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salt_set"))
        .select(
            *key,
            (-F.col("best.neg_id")).alias("keep_id"),
            "group_size",
            "salt_set",
            F.count(F.lit(1)).over(Window.partitionBy(*key)).alias("contents"),
        )
    )
    lookup = combined.select(
        *key,
        F.when(F.col("contents") > 1, F.raise_error(F.lit("two contents share digest, second hash and length")).cast("long"))
        .otherwise(F.col("keep_id"))
        .alias("keep_id"),
        "group_size",
        F.explode("salt_set").alias("salt"),
    )
    return (
        rows.select("id", *key, "salt")
        .join(lookup, [*key, "salt"])
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


#: regexp_replace there needs the 'g' option; n_chars is counted, not read, so it holds for any table.
EXACT_DEDUP_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM {docs}),
g AS (SELECT h, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM t GROUP BY h)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.h AS text_sha256 FROM t JOIN g ON t.h = g.h
"""
