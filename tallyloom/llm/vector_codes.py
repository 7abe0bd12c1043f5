"""Vector code compression: product quantisation with exact integer codebooks, learned over distinct parts.

A component x becomes the integer floor(scale * x); a vector is cut into equal consecutive parts. Equal parts at the
same position are first combined into one distinct row with its weight, so that a vector that a third of all rows share counts as four
rows. Weighted Lloyd rounds run over the distinct rows: a task assigns its rows to the codebook's nearest entries (the
codebook, at most ``entries`` per position, travels in the closure) and adds up weight and sums per entry, which Spark
combines; the driver gets one row per entry. Last, codes and errors are joined back to the vectors by their parts. Parts with a share of
all rows, of which there can't be many, are salted in this join.

All arithmetic is exact: products run in floating point where their sums are sure to stay below 2^53, else in integers.

Defined cases: a vector goes if it is null, empty, holds a null or non-finite component or one of 131,072 or more in size (a
sum of such squares leaves 64 bits), or if its length is not that of the kept vector of least id; if ``parts`` doesn't divide that length, the first parts are one component
longer; a null id comes after all others; rows that repeat an id (or have none) are rows of their own, in the order of
their vectors where the first codebook is made; fewer rows than entries make a shorter codebook; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_written, written

ENTRIES = 256
LIMIT = 131_072
EXACT = float(1 << 52)
ROWS_AT_ONCE = 1 << 14  # rows compared with the codebook at a time
_FLOAT = "array<double>"


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector.cast(_FLOAT), lambda x: F.floor(x * scale).cast("long"))


def usable(vector: Column) -> Column:
    sound = F.forall(vector.cast(_FLOAT), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & sound, F.lit(False))


def bounds(size: int, parts: int) -> list[tuple[int, int]]:
    """(first component, number) of each part."""
    sizes = [size // parts + (k < size % parts) for k in range(parts)]
    return [(sum(sizes[:k]), n) for k, n in enumerate(sizes)]


# ---- nearest entries and sums, inside tasks -------------------------------------------------------


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and squared distance of each row's nearest entry, the first one of a tie."""
    code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    widest = float(np.abs(x).max(initial=0)) + float(np.abs(book).max(initial=0))
    exact = widest * widest * max(1, book.shape[1]) < EXACT
    kind = np.float64 if exact else np.int64
    entries = book.astype(kind)
    size = (entries * entries).sum(axis=1)
    for begin in range(0, len(x), ROWS_AT_ONCE):
        rows = x[begin : begin + ROWS_AT_ONCE].astype(kind)
        if exact:
            d = size - 2 * (rows @ entries.T) + (rows * rows).sum(axis=1)[:, None]
        else:
            d = np.stack([((rows - e) ** 2).sum(axis=1) for e in entries], axis=1)
        best = d.argmin(axis=1)
        code[begin : begin + len(rows)] = best
        error[begin : begin + len(rows)] = d[np.arange(len(rows)), best].astype(np.int64)
    return code, error


def matrix(parts: pa.Array, size: int) -> np.ndarray:
    return parts.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def by_position(batch: pa.RecordBatch, books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, places of its rows in the batch, its rows)."""
    position = batch.column("position").to_numpy()
    for p in np.unique(position).tolist():
        at = np.flatnonzero(position == p)
        yield p, at, matrix(batch.column("part").take(pa.array(at)), books[p].shape[1])


# ---- the job --------------------------------------------------------------------------------------


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    return rows.where(usable(F.col("vector"))).select("id", "label", integers(F.col("vector"), scale).alias("v"))


def exploded(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """rows' columns but v, with one row per part: position, part."""
    parts = F.array(*[F.slice("v", F.lit(at + 1), F.lit(n)) if n else F.array().cast("array<bigint>") for at, n in cuts])
    return rows.select(*[c for c in rows.columns if c != "v"], F.posexplode(parts).alias("position", "part"))


def first_books(rows: DataFrame, parts: int, entries: int) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """The parts of the rows of least id: at most ``entries`` rows reach the driver."""
    shortest = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v")
    first = shortest.limit(1).collect()
    if not first:
        return [], []
    size = len(first[0]["v"])
    found = np.array([r["v"] for r in shortest.where(F.size("v") == size).limit(entries).collect()], np.int64)
    cuts = bounds(size, parts)
    return [found[:, at : at + n] for at, n in cuts], cuts


def moved(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one weighted round."""
    widest = max(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            w = batch.column("weight").to_numpy()
            for p, at, rows in by_position(batch, books):
                code, _ = nearest(rows, books[p])
                np.add.at(weight[p], code, w[at])
                np.add.at(sums[p], code, rows * w[at][:, None])
        for p, b in enumerate(books):
            used = np.flatnonzero(weight[p])
            if len(used):
                columns = [np.pad(sums[p][used], ((0, 0), (0, widest - b.shape[1])))[:, k] for k in range(widest)]
                yield pa.record_batch([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), *map(pa.array, [weight[p][used], *columns])], names=names)

    names = ["position", "entry", "weight", *[f"s{k}" for k in range(widest)]]
    schema = "position int, entry int, " + ", ".join(f"{c} long" for c in names[2:])
    totals = distinct.mapInArrow(run, schema).groupBy("position", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]]).collect()
    new = [b.copy() for b in books]
    for r in totals:
        b = new[r["position"]]
        b[r["entry"]] = [r[f"s{k}"] // r["weight"] for k in range(b.shape[1])]
    return new


def assigned(distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """distinct's position and part with code and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros((2, len(batch)), np.int64)
            for p, at, rows in by_position(batch, books):
                code[at], error[at] = nearest(rows, books[p])
            yield pa.record_batch([batch.column("position"), batch.column("part"), batch.column("weight"), pa.array(code.astype(np.int32)), pa.array(error)], names=["position", "part", "weight", "code", "error"])

    return distinct.mapInArrow(run, "position int, part array<long>, weight long, code int, error long")


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encoded(rows: DataFrame, distinct: DataFrame, books: list[np.ndarray], cuts: list[tuple[int, int]]) -> DataFrame:
    """(id, label, code, error) for every row, by a join of its parts with the distinct ones.

    Rows with the same id, label and vector are one row with a count on their way. A part with 1 / (4 * partitions) of
    all rows or more is hot (at most 16 * partitions parts are): it is dealt by a salt, too.
    """
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    codes = assigned(distinct, books)
    total = distinct.agg(F.sum("weight")).first()[0] or 0  # of all positions: len(books) times the rows
    hot = written(distinct.where(F.col("weight") >= F.lit(max(2, total // (4 * len(books) * partitions)))).select("position", "part"), "hot-parts")
    key = ["id", "label", "h1", "h2"]
    tagged = rows.select("id", "label", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "v")
    spread = exploded(tagged, cuts).join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["position", "part"], "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id", "h1"), F.lit(partitions))).otherwise(F.lit(0))
    spread = spread.withColumn("salt", salt.cast("int")).drop("hot")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(partitions - 1))).otherwise(F.array(F.lit(0)))
    held = codes.join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["position", "part"], "left").withColumn("salt", F.explode(salts))
    met = spread.join(held.select("position", "part", "salt", "code", "error"), ["position", "part", "salt"])
    whole = met.groupBy(*key).agg(
        *[F.max(F.when(F.col("position") == p, F.lower(F.lpad(F.hex(F.col("code").cast("long")), 2, "0")))).alias(f"c{p}") for p in range(len(books))],
        F.sum("error").alias("all"),
        F.count(F.lit(1)).alias("met"),
    )
    code = F.concat(*[f"c{p}" for p in range(len(books))])
    # rows that are alike share the sum of their errors; it is split without floating point
    per_row = whole.withColumn("repeats", F.expr(f"met div {len(books)}")).select("id", "label", code.alias("code"), F.expr("`all` div repeats").alias("error"), F.explode(F.array_repeat(F.lit(1), F.col("repeats").cast("int"))).alias("one"))
    return per_row.drop("one")


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 4,
    entries: int = ENTRIES,
    rounds: int = 4,
    scale: int = 1024,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error, label_error), one row per kept row, and the codebooks, per part entries x components.

    code: two hex digits per part, so ``entries`` is 256 at most; label_error: error summed over equal labels, nulls together.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits per part")
    rows = prepared(vectors, id_col, vector_col, label_col, scale)
    books, cuts = first_books(rows, parts, entries)
    label_type = vectors.schema[label_col].dataType.simpleString()
    if not books:
        return vectors.sparkSession.createDataFrame([], f"{id_col} long, {label_col} {label_type}, code string, error long, label_error long"), []
    rows = rows.where(F.size("v") == sum(n for _, n in cuts))
    distinct = written(exploded(rows, cuts).groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight")), "distinct-parts")
    for _ in range(rounds):
        books = moved(distinct, books)
    coded = written(encoded(rows, distinct, books, cuts), "codes")
    drop_written(distinct)
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same")
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("same")), "left")
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), books


def compressed_digests(vectors: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    found, books = compress(vectors, id_col, **options)
    return found.select(id_col, "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def decoded(code: str, books: list[np.ndarray], scale: int = 1024) -> list[float]:
    """The vector that a code stands for: the middles of its entries' cells."""
    return [(x + 0.5) / scale for p, b in enumerate(books) for x in b[int(code[2 * p : 2 * p + 2], 16)].tolist()]


def _round_sql(k: int) -> str:
    return f"""
a{k} AS MATERIALIZED (
  SELECT d.p, d.v, any_value(d.w) AS w, arg_min(b.e, (list_sum(list_transform(list_zip(d.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), b.e)) AS e,
    min(list_sum(list_transform(list_zip(d.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS err
  FROM d JOIN b{k} b ON d.p = b.p GROUP BY d.p, d.v),"""


def _books_sql(k: int) -> str:
    return f"""
s{k} AS (
  SELECT a.p, a.e, i.i, sum(a.v[i.i] * a.w) AS total, sum(a.w) AS n FROM a{k} a, generate_series(1, 16) i(i) GROUP BY a.p, a.e, i.i),
m{k} AS (SELECT p, e, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{k} GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e),"""


#: For vectors of 64 components: 4 rounds and the last assignment, one after the other.
VECTOR_CODES_SQL = (
    """
WITH r AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 1024) AS BIGINT)) AS v FROM {vectors}
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
f AS (SELECT v, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM r QUALIFY e < 256),
b0 AS MATERIALIZED (SELECT p.p, f.e, f.v[16 * p.p + 1:16 * p.p + 16] AS v FROM f, generate_series(0, 3) p(p)),
d AS MATERIALIZED (SELECT p.p, r.v[16 * p.p + 1:16 * p.p + 16] AS v, count(*) AS w FROM r, generate_series(0, 3) p(p) GROUP BY 1, 2),"""
    + "".join(_round_sql(k) + _books_sql(k) for k in range(4))
    + _round_sql(4)
    + """
c AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b4),
q AS (
  SELECT r.vec_id, r.label, lower(printf('%02x%02x%02x%02x', x0.e, x1.e, x2.e, x3.e)) AS code, CAST(x0.err + x1.err + x2.err + x3.err AS BIGINT) AS error
  FROM r JOIN a4 x0 ON x0.p = 0 AND x0.v = r.v[1:16] JOIN a4 x1 ON x1.p = 1 AND x1.v = r.v[17:32]
  JOIN a4 x2 ON x2.p = 2 AND x2.v = r.v[33:48] JOIN a4 x3 ON x3.p = 3 AND x3.v = r.v[49:64])
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM q, c
"""
)
