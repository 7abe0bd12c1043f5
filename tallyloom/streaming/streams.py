"""Structured Streaming forms of the operators that run on arriving data, and their batch twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def window_end(ts: Column, seconds: int) -> Column:
    """The end of the fixed window that holds ts, in epoch seconds."""
    return (F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds) * seconds + seconds).cast("long")


def rate_limited(events: DataFrame, key: str, ts: str, order: str, limit: int, seconds: int) -> DataFrame:
    """Batch: each event with its window, what remains, and whether it is let through."""
    e = events.withColumn("reset_at", window_end(F.col(ts), seconds))
    n = F.row_number().over(Window.partitionBy(key, "reset_at").orderBy(ts, order))
    return e.withColumn("nth", n).withColumns({"allowed": F.col("nth") <= limit, "remaining": F.greatest(F.lit(limit) - F.col("nth"), F.lit(0))}).drop("nth")


def rate_stream(events: DataFrame, key: str, ts: str, limit: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Stream: requests, admitted and refused per key and tumbling window, with late data up to the watermark."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds").alias("w"), key).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select(key, F.col("w.start").alias("window_start"), "requests", F.least("requests", F.lit(limit)).alias("admitted"), F.greatest(F.col("requests") - limit, F.lit(0)).alias("refused"))


def new_documents(stream: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """The first arrival per content hash within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def closure_stream(reports: DataFrame, ts: str = "reported_at", late: str = "30 days") -> DataFrame:
    """(place_id, reporter, ts) of first reports, to be counted into the snapshot by ``closure_counts``.

    A reporter's repeats drop out while the watermark remembers them; state is that memory alone. What comes later
    than that is dropped by the merge, whose key is (place_id, reporter).
    """
    return reports.withWatermark(ts, late).dropDuplicatesWithinWatermark(["place_id", "reporter"]).select("place_id", "reporter", ts)


def first_reports(kept: DataFrame, batch: DataFrame) -> DataFrame:
    """The merge of a micro-batch into the table of first reports: one row per (place_id, reporter), the earliest."""
    return kept.unionByName(batch).groupBy("place_id", "reporter").agg(F.min("reported_at").alias("reported_at"))


def closure_counts(kept: DataFrame, threshold: int = 3) -> DataFrame:
    """Distinct reporters per place and whether it counts as closed."""
    return kept.groupBy("place_id").agg(F.count(F.lit(1)).alias("closure_report_count"), (F.count(F.lit(1)) >= threshold).alias("is_closed"))


def merge_sink(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], merge: Callable[[DataFrame, DataFrame], DataFrame]):
    """A foreachBatch function that merges each micro-batch into the snapshot."""

    def apply(batch: DataFrame, _: int) -> None:
        write(merge(read(), batch))

    return apply


def run_available(df: DataFrame, sink: str | Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Processes what is there, then stops: for scheduled refreshes. sink: a folder for Parquet, or a foreachBatch function."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w = w.foreachBatch(sink) if callable(sink) else w.format("parquet").option("path", sink)
    w.start().awaitTermination()
