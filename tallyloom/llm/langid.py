"""Language identification by rank-order profiles (out-of-place distance).

A profile is the ``profile_size`` most frequent character n-grams of a language in order of rank;
n-grams are taken within words, padded at both ends. A document's own most frequent n-grams are
looked up in each profile: an n-gram that is there costs the difference of ranks, one that
isn't costs ``profile_size``. The language with the least sum wins.

Learning reads only text and label of the training rows: a bounded sample, the
``sample_per_language`` rows per language of least hash of their id (of equal ids, of their text), of which the
n-gram counts are summed; a language of fewer rows is learned from all of them. Prediction reads whole texts.

Defined cases: null text, or text without a letter, is ``und`` with score 0; ties go to the language
first by name; no training rows: all ``und``; repeated rows are judged alike, and count as often as they are there in
learning, up to the bound; a null id is not held out, so its row is learned from; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tallyloom.llm.common import id_crc_mod, written

UNKNOWN = "und"
ORDERS = (1, 2, 3)
_BASE = np.uint64(0x110000)
STEPS = 8  # bounds on the sample's hashes grow by 2^(1/8)
BROADCAST_ROWS = 10_000  # a table of languages up to this length is broadcast


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes (three code points in base 0x110000, ascending) and counts of a text's n-grams."""
    words = Counter(text.lower().split())
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # " word word ... ": each distinct word once, weighted by its count; a space pads both ends
    line = " " + " ".join(words) + " "
    cp = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = cp == 32
    weight = np.fromiter(words.values(), np.int64, len(words))
    word = np.cumsum(space) - 1  # the space before a word belongs to it
    each = np.append(weight, 0)[word]
    letter = np.array([c.isalpha() for c in line]) if not line.isascii() else _ascii_letters(cp)
    codes, counts = [], []
    for n in ORDERS:
        m = len(cp) - n + 1
        code = np.zeros(m, np.uint64)
        ok = np.zeros(m, bool)
        for j in range(n):
            code = code * _BASE + cp[j : j + m]
            ok |= letter[j : j + m]  # holds a letter
            if 0 < j < n - 1:
                ok &= ~space[j : j + m]
        for j in range(1, n - 1):
            ok &= ~space[j : j + m]  # lies in one padded word
        codes.append(code[ok])
        counts.append(each[:m][ok])
    code, back = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(back, np.concatenate(counts), len(code)).astype(np.int64)


def _ascii_letters(cp: np.ndarray) -> np.ndarray:
    return ((cp | np.uint64(32)) - np.uint64(97)) < np.uint64(26)


def top(code: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, ties by code."""
    if len(count) > size:  # only the ties at the edge and what is above them need sorting
        edge = np.partition(count, len(count) - size)[len(count) - size]
        keep = count >= edge
        code, count = code[keep], count[keep]
    return code[np.lexsort((code, -count))][:size]


class Profiles:
    """Ranks of all languages' n-grams in one table."""

    def __init__(self, by_language: dict[str, list[int]], size: int):
        self.languages = sorted(by_language)
        self.size = size
        self.codes = np.unique(np.array([c for x in by_language.values() for c in x], np.uint64))
        self.ranks = np.full((len(self.languages), len(self.codes) + 1), -1, np.int64)
        for i, lang in enumerate(self.languages):
            self.ranks[i, np.searchsorted(self.codes, np.array(by_language[lang], np.uint64))] = np.arange(len(by_language[lang]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, own)
        at[(at >= len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        there = self.ranks[:, at]
        return np.where(there < 0, self.size, np.minimum(np.abs(there - np.arange(len(own))), self.size)).sum(axis=1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        code, count = ngram_counts(text)
        if not len(code):
            return UNKNOWN, 0.0
        own = top(code, count, self.size)
        d = self.distances(own)
        k = int(np.argmin(d))
        return self.languages[k], float(1.0 - d[k] / (self.size * len(own)))


def learn(rows: DataFrame, profile_size: int = 400, sample_per_language: int = 2000) -> Profiles:
    """rows: (id, text, lang), training rows alone. What reaches the driver is profile_size codes a language."""
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    # per language the rows are counted by the logarithm of their place, by ids alone; the bound is where the counts reach the
    # sample, however many rows share an id. Only rows below it are ranked, and no text of another row moves
    order = F.xxhash64("id")
    place = F.greatest(order.cast("double") / F.lit(2.0**64) + 0.5, F.lit(2.0**-64))  # in (0, 1]
    step = F.floor(F.log2(place) * STEPS).cast("int")
    counted = rows.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    reached = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("lang").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
    bounds = written(reached.groupBy("lang").agg(F.coalesce(F.min(F.when(F.col("upto") >= sample_per_language, F.col("step"))), F.max("step")).alias("bound")), "languages")
    bound = F.broadcast(bounds) if bounds.count() <= BROADCAST_ROWS else bounds
    below = rows.join(bound, "lang").where(step <= F.col("bound")).select("lang", "text", "id", order.alias("order"), F.xxhash64("text").alias("second"))
    # ranked twice, first per task that read them: rows that share an id are not gathered in one task
    keys = ["order", "second", "id", "text"]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *by).orderBy(*keys))).where(F.col("rank") <= sample_per_language)
    sample = ranked(ranked(below.withColumn("dealt", F.spark_partition_id()), "dealt"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, list] = {}
            for text, lang in zip(batch.column(0), batch.column(1)):
                total.setdefault(lang.as_py(), []).append(ngram_counts(text.as_py()))
            for lang, parts in total.items():
                code, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(back, np.concatenate([p[1] for p in parts]), len(code)).astype(np.int64)
                yield pa.record_batch([pa.array([lang] * len(code)), pa.array(code.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    counts = sample.select("text", "lang").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("code")))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= profile_size).orderBy("lang", "rank").collect()
    by: dict[str, list[int]] = {}
    for r in best:
        by.setdefault(r["lang"], []).append(r["code"] & 0xFFFFFFFFFFFFFFFF)
    return Profiles(by, profile_size)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' columns, lang_pred and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [profiles.predict(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch(
                [batch.column("id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """Every row of docs, whatever its id, with lang_pred and score of its own text."""
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [profiles.predict(t.as_py()) for t in batch.column(text_col)]
            yield pa.record_batch([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(id_crc_mod("doc_id", 4) != 2).select(F.col("doc_id").alias("id"), "text", "lang")
