"""Snapshot merges: what UPSERT, UPDATE ... FROM and DELETE do, as joins that yield the next snapshot.

Conflict rules differ in how NULL keys compare: merge(..., null_equal=True) treats them as equal,
otherwise a row with a NULL key never conflicts and is always added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _match(keys: list[str], null_equal: bool) -> Column:
    pairs = [(F.col(f"o.{k}"), F.col(f"n.{k}")) for k in keys]
    return reduce(lambda a, b: a & b, [o.eqNullSafe(n) if null_equal else o == n for o, n in pairs])


def merge(old: DataFrame, new: DataFrame, keys: list[str], null_equal: bool = False, keep: tuple[str, ...] = (), keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """old with new upserted. keep: columns that a conflict leaves as they were; keep_if_null: those that a NULL doesn't overwrite.

    new holds at most one row per key; see latest().
    """
    here = F.col("o.__old").isNotNull()
    there = F.col("n.__new").isNotNull()
    both = old.withColumn("__old", F.lit(1)).alias("o").join(new.withColumn("__new", F.lit(1)).alias("n"), _match(keys, null_equal), "full_outer")

    def value(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keep:
            return F.when(here, o).otherwise(n)
        if c in keep_if_null:
            return F.coalesce(n, o)
        return F.when(there, n).otherwise(o)

    return both.select(*[value(c).alias(c) for c in old.columns])


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row per key: a batch that repeats a key is applied in order."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def unnested(df: DataFrame, **arrays: str) -> DataFrame:
    """Parallel arrays to rows: the n-th elements of all, by name; a shorter array gives NULLs, a NULL or empty one none of its own."""
    zipped = F.arrays_zip(*[F.coalesce(F.col(a), F.array().cast(df.schema[a].dataType)).alias(name) for name, a in arrays.items()])
    others = [c for c in df.columns if c not in arrays.values()]
    return df.select(*others, F.explode(zipped).alias("__row")).select(*others, *[F.col("__row")[name].alias(name) for name in arrays])


def merge_places(old: DataFrame, new: DataFrame) -> DataFrame:
    """Places are found by outer id, else by natural key; a found one keeps its outer id where the new one has none.

    The two lookups are separate equi-joins; an OR in the join would compare all with all.
    """
    o = old.select("id", "kakao_place_id", "natural_key")
    by_kakao = o.where(F.col("kakao_place_id").isNotNull()).select(F.col("kakao_place_id"), F.col("id").alias("id_k"))
    by_key = o.select("natural_key", F.col("id").alias("id_n"))
    found = new.join(by_kakao, "kakao_place_id", "left").join(by_key, "natural_key", "left").withColumn("hit", F.coalesce("id_k", "id_n"))
    payload = [c for c in new.columns if c not in ("id",)]
    updates = found.where(F.col("hit").isNotNull()).groupBy("hit").agg(F.max_by(F.struct(*payload), "natural_key").alias("n"))
    updated = old.join(updates, old.id == updates.hit, "left").select(
        *[
            (F.coalesce(F.col("n.kakao_place_id"), old.kakao_place_id) if c == "kakao_place_id" else F.when(F.col("hit").isNotNull(), F.col(f"n.{c}")).otherwise(old[c])).alias(c)
            if c in payload
            else old[c]
            for c in old.columns
        ]
    )
    added = found.where(F.col("hit").isNull()).select(*[F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns])
    return updated.unionByName(added)


def join_update(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """UPDATE ... FROM: columns of matched rows take the source's values."""
    s = source.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = target.join(s, target[key] == F.col("__k"), "left")
    hit = F.col("__k").isNotNull()
    return joined.select(*[F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def move_visits(visits: DataFrame, moves: DataFrame, keys: list[str]) -> DataFrame:
    """Visits of moved places go to their new place; a mover that meets an existing visit of equal keys is dropped."""
    m = moves.select(F.col("from_id").alias("place_id"), "to_id")
    moved = visits.join(m, "place_id", "left").withColumn("mover", F.col("to_id").isNotNull()).withColumn("place_id", F.coalesce("to_id", "place_id"))
    solid = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])  # NULL keys never conflict
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy("mover", "visit_id"))
    return moved.withColumn("__rn", rn).where(~solid | (F.col("__rn") == 1) | ~F.col("mover")).select(*visits.columns)


def without_orphans(places: DataFrame, visits: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Places without visits go; with only(id), just those listed."""
    orphan = places.join(visits.select(F.col("place_id").alias("id")).distinct(), "id", "left_anti")
    if only is not None:
        orphan = orphan.join(only, "id", "left_semi")
    return places.join(orphan.select("id"), "id", "left_anti")


def closure_state(places: DataFrame, reports: DataFrame, threshold: int = 3) -> DataFrame:
    """Distinct reporters per place; closed from the threshold on, at the time of the report that reached it.

    A place that was closed before keeps its state and time.
    """
    first = reports.groupBy("place_id", "reporter").agg(F.min("reported_at").alias("at"))
    nth = F.row_number().over(Window.partitionBy("place_id").orderBy("at", "reporter"))
    per = first.withColumn("n", nth).groupBy("place_id").agg(F.count(F.lit(1)).alias("reporters"), F.min(F.when(F.col("n") == threshold, F.col("at"))).alias("reached_at"))
    j = places.join(per, places.id == per.place_id, "left")
    count = F.coalesce("reporters", F.lit(0))
    return j.select("id", count.alias("closure_report_count"), (F.col("is_closed") | (count >= threshold)).alias("is_closed"), F.coalesce("closed_at", "reached_at").alias("closed_at"))


def takedown(places: DataFrame, requests: DataFrame) -> DataFrame:
    """A request hides its place at once; one hidden before keeps its time and reason."""
    r = requests.groupBy(F.col("place_id").alias("id")).agg(F.min("requested_at").alias("__at"))
    j = places.join(r, "id", "left")
    return j.select(
        *[c for c in places.columns if c not in ("hidden_at", "hidden_reason")],
        F.coalesce("hidden_at", "__at").alias("hidden_at"),
        F.coalesce("hidden_reason", F.when(F.col("hidden_at").isNull() & F.col("__at").isNotNull(), "takedown_request")).alias("hidden_reason"),
    )


def mark_invalid(places: DataFrame, flagged: DataFrame, at: Column, reason: str) -> DataFrame:
    """Flagged places that are shown become invalid and hidden; an earlier reason stays."""
    f = flagged.select(F.col("id")).distinct().withColumn("__f", F.lit(True))
    j = places.join(f, "id", "left")
    hit = F.coalesce("__f", F.lit(False)) & F.col("deleted_at").isNull()
    return j.select(
        *[c for c in places.columns if c not in ("valid_place", "hidden_at", "hidden_reason")],
        F.when(hit, False).otherwise(F.col("valid_place")).alias("valid_place"),
        F.when(hit, F.coalesce("hidden_at", at)).otherwise(F.col("hidden_at")).alias("hidden_at"),
        F.when(hit, F.coalesce("hidden_reason", F.lit(reason))).otherwise(F.col("hidden_reason")).alias("hidden_reason"),
    )


def reactions_merge(old: DataFrame, changes: DataFrame) -> DataFrame:
    """(place_id, user_id, reaction, changed_at): the last change per user counts; a NULL reaction takes it back."""
    all_rows = old.select("place_id", "user_id", "reaction", "changed_at").unionByName(changes.select("place_id", "user_id", "reaction", "changed_at"))
    return latest(all_rows, ["place_id", "user_id"], "changed_at").where(F.col("reaction").isNotNull())


def commit_snapshot(df: DataFrame, path: str, staging: str) -> None:
    """All or nothing: write aside, set the live folder aside, put the new one in its place, then drop the old one.

    A crash leaves either folder whole: under path, or, between the two renames, under path + ".old", from where
    the next commit takes it back first.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    new, live, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (staging, path, path.rstrip("/") + ".old"))
    fs = live.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def move(source, target) -> None:
        if not fs.rename(source, target):
            raise OSError(f"{source} could not take the place of {target}")

    if fs.exists(old):
        if fs.exists(live):
            fs.delete(old, True)
        else:
            move(old, live)
    df.write.mode("overwrite").parquet(staging)
    if fs.exists(live):
        move(live, old)
    move(new, live)
    fs.delete(old, True)
