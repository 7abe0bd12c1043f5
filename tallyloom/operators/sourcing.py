"""Source registry, agency scopes, run summaries, model-call logs: reports over the collecting side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.text import first_match

#: Verification statuses, and the regions of named scopes.
STATUSES = ("verified_in_code", "pending", "legal_hold", "source_not_found", "no_recent_data", "pdf_vision_hold", "adapter_hold", "invalid_source_pattern")
CAPITAL = {"seoul": ("서울특별시",), "gyeonggi": ("경기도",), "incheon": ("인천광역시",)}
SCOPES = {
    **CAPITAL,
    "capital-area": tuple(r for rs in CAPITAL.values() for r in rs),
    "gyeongsang": ("부산광역시", "대구광역시", "울산광역시", "경상북도", "경상남도"),
    "jeolla": ("광주광역시", "전북특별자치도", "전라남도"),
    "chungcheong": ("대전광역시", "세종특별자치시", "충청북도", "충청남도"),
    "gangwon": ("강원특별자치도",),
    "jeju": ("제주특별자치도",),
}
#: Fields that a source pattern must hold, by adapter.
REQUIRED = {"attachment_board": ("listUrl",), "estimate_list": ("listUrl",), "inline_table": ("listUrl",), "item_disclosure": ("sourceUrl",), "city_portal": ()}


def in_scope(scope: str, regions: dict[str, tuple[str, ...]] = SCOPES) -> Column:
    region = F.col("parent_region")
    if scope == "nationwide":
        return F.lit(True)
    if scope == "non-capital":
        return ~F.coalesce(region.isin(*regions["capital-area"]), F.lit(False))
    if scope not in regions:
        raise ValueError(f"unknown scope: {scope}")
    return F.coalesce(region.isin(*regions[scope]), F.lit(False))


def pattern_error(pattern: Column) -> Column:
    """Why a JSON source pattern is unusable; NULL if it is fine."""
    adapter = F.get_json_object(pattern, "$.adapter")
    missing = [F.when((adapter == a) & (F.coalesce(F.get_json_object(pattern, f"$.{f}"), F.lit("")) == ""), f"missing:{f}") for a, fs in REQUIRED.items() for f in fs]
    return F.coalesce(F.when(adapter.isNull(), "no_adapter"), F.when(~adapter.isin(*REQUIRED, "adapter_required"), "unknown_adapter"), *missing)


def verification_status(pattern: Column) -> Column:
    """Unusable patterns are invalid; those waiting for an adapter keep their hold, else pend; others need evidence."""
    hold = F.get_json_object(pattern, "$.hold")
    evidence = F.get_json_object(pattern, "$.verifiedAt").isNotNull() & F.get_json_object(pattern, "$.verifiedBy").isNotNull()
    waiting = F.get_json_object(pattern, "$.adapter") == "adapter_required"
    return F.when(waiting, F.when(hold.isin(*STATUSES), hold).otherwise("pending")).when(pattern_error(pattern).isNotNull() | ~evidence, "invalid_source_pattern").otherwise("verified_in_code")


def registry_summary(entries: DataFrame, group: str = "expansion_phase") -> DataFrame:
    """Counts per status for each group, and for all ('all'): one aggregate over grouping sets."""
    return entries.rollup(group).agg(F.grouping(group).alias("g"), F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("verification_status") == s).alias(s) for s in STATUSES]).select(
        F.when(F.col("g") == 1, "all").otherwise(F.col(group)).alias("priority_group"), "total", *STATUSES
    )


def assembled(parts: list[DataFrame], holds: DataFrame, expected: int | None = None) -> DataFrame:
    """Parts of a registry put together; holds(id, hold) apply to entries still waiting for an adapter. A wrong total fails."""
    rows = reduce(DataFrame.unionByName, parts).join(holds, "id", "left")
    waiting = F.get_json_object("source_pattern", "$.adapter") == "adapter_required"
    status = F.when(waiting & F.col("hold").isNotNull(), F.col("hold")).otherwise(verification_status(F.col("source_pattern")))
    out = rows.withColumn("verification_status", status).drop("hold")
    if expected is None:
        return out
    total = out.agg(F.count(F.lit(1)).alias("__n"))
    checked = total.select(F.when(F.col("__n") != expected, F.raise_error(F.concat(F.lit(f"expected {expected} entries, found "), F.col("__n").cast("string"))).cast("boolean")).otherwise(True).alias("__ok"))
    return out.crossJoin(checked).where("__ok").drop("__ok")  # one row


COUNTERS = (
    "posts_seen",
    "posts_fetched",
    "raw_parsed_rows",
    "parsed_rows",
    "normalized_visits",
    "places_seen",
    "kakao_matched_places",
    "loaded_sources",
    "loaded_places",
    "loaded_visits",
    "skipped_invalid_places",
)
RESULTS = ("success", "adapter_required", "unsupported", "config_error", "failed")


def run_summary(results: DataFrame) -> DataFrame:
    """One row: runs by result, sums of the counters, reasons of failure as a map, and whether all is well."""
    reasons = results.where(F.col("failure_reason").isNotNull()).groupBy("failure_reason").agg(F.count(F.lit(1)).alias("n"))
    r = reasons.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("failure_reason", "n")))).alias("failure_reasons"))
    one = results.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("result") == x).alias(x) for x in RESULTS], *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])
    return one.withColumn("ok", (F.col("unsupported") + F.col("config_error") + F.col("failed")) == 0).crossJoin(r)  # one row each


def first_good_attempt(attempts: DataFrame, least: float) -> DataFrame:
    """Per task the first provider whose mean confidence suffices; calls after it, and calls beyond the budget, don't count.

    attempts: task_id, seq, provider, ok, retryable, mean_confidence, cost, budget_left.
    """
    w = Window.partitionBy("task_id").orderBy("seq")
    good = F.col("ok") & (F.col("mean_confidence") >= least) & (F.col("cost") <= F.col("budget_left"))
    fatal = ~F.col("ok") & ~F.col("retryable")
    before = F.coalesce(F.max((good | fatal).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    state = F.when(before == 1, "not_called").when(F.col("cost") > F.col("budget_left"), "budget").when(good, "accepted").when(fatal, "stopped").when(F.col("ok"), "low_confidence").otherwise("retried")
    return attempts.withColumn("state", state)


#: Offices that a file name can name, in order of precedence, and the words that units end with.
OFFICES = ("사무국", "부지사", "도지사", "부시장", "시장", "부군수", "군수", "의장단", "부의장", "의장", "위원장", "교섭단체")
UNIT_ENDS = ("담당관", "전문위원", "구청장", "부구청장", "국장", "과", "팀", "국", "동", "소", "센터", "실")


def department_of_file(name: Column, agency: Column) -> Column:
    """Agency and office from a file name: the first known office in it, else the first unit among what stands in
    brackets after the budget's name, in any brackets, or after a month."""
    offices = F.filter(F.array(*map(F.lit, OFFICES)), lambda o: name.contains(o))
    ends = "(?:" + "|".join(UNIT_ENDS) + ")$"
    found = lambda p: F.trim(F.regexp_extract(name, p, 1))
    fragments = F.array(found(r"업무추진비\(([^)]+)\)"), found(r"\(([^)]+)\)"), found(rf"\d{{1,2}}월\s+([가-힣0-9]+{ends[:-1]})"))
    units = F.filter(fragments, lambda u: u.rlike(ends))
    return F.concat_ws(" ", agency, F.get(F.concat(offices, units), F.lit(0)))


def repaired_json(c: Column) -> Column:
    """The object in a model's answer, out of its fence or prose, with the usual slips mended."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    bare = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    body = F.when(fenced != "", fenced).otherwise(bare)
    body = F.regexp_replace(body, r"\}\s*\{", "},{")
    body = F.regexp_replace(body, r",\s*([}\]])", "$1")
    return F.nullif(F.regexp_replace(body, r'(?<=[\]"0-9}])\s*\n\s*"', ',\n"'), F.lit(""))


PAYLOAD = "rows array<struct<confidence string, department_name string, used_at string, place_text string, purpose string, amount string, user_text string, payment_method string, expense_category string, raw_excerpt string>>"


def payload_rows(answers: DataFrame, fallback_department: Column) -> DataFrame:
    """Rows of a model's answer (doc_id, answer) as expense fields; those without date, amount or place drop out."""
    from tallyloom.functions import dates, text

    schema = "struct<" + PAYLOAD.replace("rows ", "rows: ", 1) + ">"
    each = answers.select("doc_id", F.posexplode(F.from_json(repaired_json(F.col("answer")), schema)["rows"]).alias("row_no", "r"))
    blank = lambda f: F.nullif(F.trim(F.col(f"r.{f}")), F.lit(""))
    out = each.select(
        "doc_id",
        "row_no",
        dates.used_at(F.col("r.used_at"), F.lit("")).alias("used_at"),
        F.coalesce(blank("department_name"), fallback_department).alias("department_name"),
        blank("place_text").alias("place_text"),
        blank("purpose").alias("purpose"),
        text.amount(F.col("r.amount")).alias("amount"),
        blank("user_text").alias("user_text"),
        blank("payment_method").alias("payment_method"),
        blank("expense_category").alias("expense_category"),
        F.coalesce(F.col("r.raw_excerpt"), F.lit("")).alias("raw_excerpt"),
        text.confidence(F.col("r.confidence")).alias("confidence"),
    )
    return out.where(F.col("used_at").isNotNull() & (F.col("amount") > 0) & F.col("place_text").isNotNull())


def with_fallback(answered: DataFrame, rows: DataFrame) -> DataFrame:
    """A model's rows where it gave any for a document; else the rows that the rules read from it, with their own confidence."""
    missing = rows.join(answered.select("doc_id").distinct(), "doc_id", "left_anti")
    return answered.unionByName(missing, allowMissingColumns=True)


def paged(posts: DataFrame, order: str, skip: int, most: int) -> DataFrame:
    return posts.orderBy(order).offset(skip).limit(most)


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """References by URL: the last one read wins."""
    value = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*value), order).alias("v")).select(key, "v.*")


def first_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows that repeat the keys: the first stays."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def stable_id(*parts: Column) -> Column:
    """A version-5 style UUID text of the parts: the same for the same agency on every run."""
    h = F.sha1(F.concat_ws("|", *parts))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def lens_colour(share: Column) -> Column:
    """Map colour of a score between 0 and 1; a lightness halfway between two numbers takes the even one."""
    lightness = F.lit(86.0) - F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 50
    return F.format_string("hsl(173,58%%,%d%%)", F.bround(lightness, 0).cast("int"))
