"""Batch quality gates, their policy, completeness reports and failure classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def quality_gates(batches: DataFrame, visits: DataFrame, places: DataFrame, need_storage: bool = False) -> DataFrame:
    """(batch_id, code, severity, ok), one row per gate that fires, one quality_pass row where none does.

    batches(batch_id, parsed_rows, storage_path), visits(batch_id, confidence), places(batch_id, place_key, lat, lng, matched).
    Means are taken of decimals: one of exactly the limit does not depend on the order of summing.
    """
    v = visits.groupBy("batch_id").agg(F.count(F.lit(1)).alias("visits"), F.avg(F.col("confidence").cast("decimal(12,6)")).alias("mean"), F.min("confidence").alias("least"))
    p = places.dropDuplicates(["batch_id", "place_key"]).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("places"), F.count_if(F.col("lat").isNull() | F.col("lng").isNull()).alias("unlocated"), F.count_if("matched").alias("matched")
    )
    b = batches.join(v, "batch_id", "left").join(p, "batch_id", "left").na.fill(0, ["visits", "places", "unlocated", "matched"])
    c = F.col
    rules = [
        ("zero_normalized_visits", "fail", (c("parsed_rows") > 0) & (c("visits") == 0)),
        ("low_average_confidence", "fail", c("mean") < 0.8),
        ("low_single_confidence", "quarantine", c("least") < 0.5),
        ("missing_coordinates", "fail", c("unlocated") / F.nullif(c("places"), F.lit(0)) > 0.05),
        ("all_unmatched_places", "fail", (c("visits") >= 5) & (c("places") > 0) & (c("matched") == 0)),
        ("missing_storage_path", "fail", F.lit(need_storage) & (F.coalesce("storage_path", F.lit("")) == "")),
    ]
    fired = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(False).alias("ok"))) for code, severity, when in rules]))
    fine = F.array(F.struct(F.lit("quality_pass").alias("code"), F.lit("warn").alias("severity"), F.lit(True).alias("ok")))
    return b.select("batch_id", F.explode(F.when(F.size(fired) > 0, fired).otherwise(fine)).alias("g")).select("batch_id", "g.code", "g.severity", "g.ok")


def gate_policy(results: DataFrame, batches: DataFrame, mode: str) -> DataFrame:
    """(agency_id, seq, batch_id, decision): load, skip, or stopped. mode: warn loads all; quarantine skips bad
    batches; fail stops the agency's run at its first bad batch, so that batch and all after it are not loaded."""
    bad = results.groupBy("batch_id").agg(F.bool_or(~F.col("ok") & F.col("severity").isin("fail", "quarantine")).alias("bad"))
    j = batches.join(bad, "batch_id", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    before = F.coalesce(F.bool_or("bad").over(Window.partitionBy("agency_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(False))
    decision = {"warn": F.lit("load"), "quarantine": F.when(F.col("bad"), "skip").otherwise("load"), "fail": F.when(before, "stopped").otherwise("load")}[mode]
    return j.select("agency_id", "seq", "batch_id", decision.alias("decision"))


def match_rate(places: DataFrame) -> DataFrame:
    """Matched share of distinct places; 0 if there are none."""
    per = places.groupBy("place_key").agg(F.bool_or("matched").alias("matched"))
    a = per.agg(F.count(F.lit(1)).alias("seen"), F.count_if("matched").alias("matched"))
    return a.withColumn("match_rate", F.when(F.col("seen") > 0, F.col("matched") / F.col("seen")).otherwise(0.0))


#: Words of an error by what they mean, in the order in which they are looked for.
FAILURE_WORDS = (
    ("legal_hold", ("legal", "visibility")),
    ("parser_missing", ("parser", "unsupported", "extractor", "decompress")),
    ("kakao_resolution", ("kakao", "coordinate", "unmatched")),
    ("db_constraint", ("database", "postgres", "constraint", "duplicate")),
    ("storage_failure", ("r2", "storage", "bucket", "storage_path")),
    ("llm_extraction_failure", ("llm", "api key", "vision", "confidence", "anthropic", "openai", "gemini")),
    ("auth_js_download", ("download", "timeout", "403", "401", "auth", "js", "http", "dns", "netfunnel")),
    ("source_not_found", ("source", "not found", "no posts")),
)
#: Exact codes; why an agency that needs an adapter is on hold; what is tried again.
FAILURE_CODES = {"unsupported_adapter": "parser_missing", "timeout": "timeout"}
HOLD_REASONS = {
    "legal_hold": "legal_hold",
    "source_not_found": "source_not_found",
    "no_recent_data": "no_recent_data",
    "pdf_vision_hold": "pdf_vision_hold",
    "adapter_hold": "parser_missing",
}
RETRYABLE = ("auth_js_download", "llm_extraction_failure", "storage_failure", "unknown")


def hold_reason(hold: Column) -> Column:
    """What keeps an agency without an adapter waiting; without a known hold its source was not found."""
    return F.coalesce(*[F.when(hold == status, reason) for status, reason in HOLD_REASONS.items()], F.lit("source_not_found"))


def failure_reason(status: Column, code: Column, message: Column, hold: Column) -> Column:
    """Why a run failed; NULL for status 0. Exact codes first, then the first group with a word in the error."""
    text = F.lower(F.concat_ws(" ", F.coalesce(code, F.lit("")), F.coalesce(message, F.lit(""))))
    exact = [F.when(code == c, r) for c, r in FAILURE_CODES.items()]
    words = [F.when(reduce(lambda a, b: a | b, [text.contains(w) for w in ws]), r) for r, ws in FAILURE_WORDS]
    return F.when(status != 0, F.coalesce(F.when(code == "adapter_required", hold_reason(hold)), *exact, *words, F.lit("unknown")))


def should_retry(status: Column, reason: Column) -> Column:
    return status.isin(1, 3) & F.coalesce(reason.isin(*RETRYABLE), F.lit(False))


def missing_ratios(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column the share of NULLs or blanks in percent: one pass, then unpivoted."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(blank(c)).alias(c) for c in columns])
    return one.unpivot(["n"], columns, "column", "missing").select("column", "missing", (F.col("missing") * 100.0 / F.nullif("n", F.lit(0))).alias("ratio"))


def labelled_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL of one count per table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()])


def visit_distribution(agencies: DataFrame, visits: DataFrame) -> DataFrame:
    """How many agencies have no visits, few, many; and the most that one has."""
    per = visits.groupBy("agency_id").agg(F.count(F.lit(1)).alias("n"))
    j = agencies.select(F.col("id").alias("agency_id")).join(per, "agency_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return j.agg(F.count(F.lit(1)).alias("agencies"), F.count_if(F.col("n") == 0).alias("without"), F.count_if(F.col("n").between(1, 9)).alias("few"), F.count_if(F.col("n") >= 10).alias("many"), F.max("n").alias("most"))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column), F.lit("missing")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def status_pivot(df: DataFrame, row: str, status: str, statuses: list[str]) -> DataFrame:
    """Totals and counts per status; the listed statuses make the columns, so no pass is needed to find them."""
    return df.groupBy(row).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == s).alias(s) for s in statuses])


def top_reasons(df: DataFrame, column: str = "reasons", k: int = 30) -> DataFrame:
    each = df.select(F.explode(F.split(column, ";")).alias("reason")).where(F.col("reason") != "")
    return each.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(k)


BINS = 1 << 12


def exact_quantiles(df: DataFrame, column: str, shares: tuple[float, ...]) -> dict[float, float | None]:
    """Quantiles with interpolation between neighbours, NULL and NaN left out; NULL without values.

    Values are counted by value; then bins are refined: each pass counts the values of the bins that hold a wanted rank
    in BINS new bins between the least and the greatest of them, until a bin holds one value. A pass splits what it looks at, since
    least and greatest lie in different bins. Per pass the driver gets BINS rows a rank at most; no task or buffer holds all values.
    """
    value = F.col(column).cast("double")
    counts = df.where(value.isNotNull() & ~F.isnan(value)).groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        total, low, high = counts.agg(F.sum("n"), F.min("v"), F.max("v")).first()
        if not total:
            return dict.fromkeys(shares)
        ranks = sorted({r for p in shares for r in (int(p * (total - 1)), min(int(p * (total - 1)) + 1, total - 1))})
        found: dict[int, float] = {}
        todo = {(0, low, high): ranks}  # (values below, least, greatest) of a bin: the ranks that lie in it
        while todo:
            next_todo: dict[tuple, list[int]] = {}
            for (below, lo, hi), wanted in todo.items():
                if lo == hi:
                    found |= dict.fromkeys(wanted, lo)
                    continue
                # halves keep differences finite; each step is monotone, so bins are in the order of their values
                place = (F.col("v") / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2) * BINS if hi / 2 > lo / 2 else F.when(F.col("v") > lo, BINS).otherwise(0)
                bins = counts.where(F.col("v").between(lo, hi)).groupBy(F.least(F.floor(place), F.lit(BINS - 1)).alias("bin")).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                for b in sorted(bins.collect(), key=lambda b: b["bin"]):
                    inside = [r for r in wanted if below <= r < below + b["n"]]
                    if inside:
                        next_todo[below, b["lo"], b["hi"]] = inside
                    below += b["n"]
            todo = next_todo
    finally:
        counts.unpersist()
    out = {}
    for p in shares:
        k, part = int(p * (total - 1)), p * (total - 1) - int(p * (total - 1))
        a, b = found[k], found[min(k + 1, total - 1)]
        out[p] = a + (b - a) * part
    return out


def confidence_percentiles(df: DataFrame, column: str) -> DataFrame:
    """p10, p90 and mean, in one row."""
    found = exact_quantiles(df, column, (0.1, 0.9))
    value = lambda p: F.lit(found[p]).cast("double")
    return df.agg(F.avg(column).alias("mean")).select(value(0.1).alias("p10"), value(0.9).alias("p90"), "mean")


#: Dollars per million tokens, in and out.
PRICES = {
    "gemini-2.5-flash": ("1.50", "9.00"),
    "gemini-3.5-flash": ("1.50", "9.00"),
    "claude-haiku-4-5": ("0.80", "2.00"),
    "claude-sonnet-4-6": ("3.00", "15.00"),
    "claude-opus-4-7": ("15.00", "75.00"),
    "gpt-5.5": ("3.00", "12.00"),
}


def token_cost(model: Column, tokens_in: Column, tokens_out: Column, thinking: Column, prices: dict[str, tuple[str, str]] = PRICES) -> Column:
    """Cost in dollars; thinking counts as output; an unknown model gives NULL."""

    def rate(k: int) -> Column:
        return F.element_at(F.create_map(*[x for m, p in prices.items() for x in (F.lit(m), F.lit(p[k]).cast("decimal(10,4)"))]), model)

    n = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(18,0)")
    return ((n(tokens_in) * rate(0) + (n(tokens_out) + n(thinking)) * rate(1)) / 1_000_000).cast("decimal(18,6)")


def daily_cost(usage: DataFrame, day) -> DataFrame:
    """What a day has cost; 0 if nothing was used."""
    return usage.where(F.to_date("created_at") == F.lit(day)).agg(F.coalesce(F.sum("cost"), F.lit(0).cast("decimal(28,6)")).alias("spent"))
