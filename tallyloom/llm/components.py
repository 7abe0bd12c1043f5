"""Connected components of a link table, without collecting links or components anywhere.

Alternating large-star and small-star steps (Kiveris et al., "Connected components in MapReduce
and beyond"): every step is a join-free aggregate plus window over the links, so a hub is spread by
the shuffle's key and never gathered as a list. Each round is written to the shared folder, which
cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_written, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (u, v) with u > v."""
    if large:
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select("u", "v")
    # the least neighbour of each node, itself included: a partial aggregate, so a hub costs a row per task. Written, so
    # that the join's sides come straight from a shuffle and the runtime optimiser can split a hub.
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = both.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    out = written(moved.where("u <> v").distinct(), "links")
    drop_written(least)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (u, v); component: the least node it reaches."""
    now = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    digest = None
    while True:
        half = _star(now, large=True)
        drop_written(now)
        now = _star(half, large=False)
        drop_written(half)
        # a star forest is reached when a round changes nothing: equal count and order-free digest
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if digest == seen:
            break
        digest = seen
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
