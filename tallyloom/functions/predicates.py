"""Filters shared by marts and serving queries, and the parsing of request parameters."""

from __future__ import annotations

import math
import re
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grades from best to unrated, and the words that requests may use for them.
GRADES = ("★★★", "★★", "★", "✦")
GRADE_ALIASES = {"3": "★★★", "2": "★★", "1": "★", "pick": "✦"}


def visible(prefix: str = "") -> Column:
    """A place that the public may see."""
    c = lambda name: F.col(prefix + name)
    return c("hidden_at").isNull() & c("deleted_at").isNull() & c("valid_place") & c("is_restaurant_like") & ~c("is_large_chain")


def since_months(day: Column | str, as_of: date, months: int) -> Column:
    """On or after as_of less so many months (clamped to a month's end)."""
    return (F.col(day) if isinstance(day, str) else day) >= F.add_months(F.lit(as_of), -months)


def in_box(box: tuple[float, float, float, float], lat: str = "lat", lng: str = "lng") -> Column:
    """box: least lat, least lng, greatest lat, greatest lng; inclusive."""
    a, b, c, d = box
    return F.col(lat).between(a, c) & F.col(lng).between(b, d)


def parse_box(text: str) -> tuple[float, float, float, float]:
    try:
        values = [float(x) for x in text.split(",")]
    except ValueError:
        raise ValueError("bbox must hold four numbers") from None
    if len(values) != 4 or not all(map(math.isfinite, values)):
        raise ValueError("bbox must hold four numbers")
    return tuple(values)  # type: ignore[return-value]


def parse_grades(text: str | None, strict: bool) -> list[str]:
    """Grades of a request, once each; unknown ones are dropped, or refused if strict. in.(a,b) is read as a,b."""
    if not text:
        return ["★★★", "★★", "✦"] if strict else []
    inner = re.fullmatch(r"in\.\((.*)\)", text.strip())
    found: list[str] = []
    for part in (inner[1] if inner else text).split(","):
        part = GRADE_ALIASES.get(part.strip(), part.strip())
        if part in GRADES:
            found += [part] if part not in found else []
        elif strict:
            raise ValueError(f"unknown grade: {part}")
    return found


def clamp_limit(value: str | int | None, default: int, most: int) -> int:
    """Non-numbers give the default, an empty string counts as 0; the result lies between 1 and most."""
    if value is None:
        n = float(default)
    else:
        try:
            n = float(value or 0)
        except ValueError:
            n = float(default)
        if not math.isfinite(n):
            n = float(default)
    return max(1, min(int(n), most))


def search_text(text: str) -> str:
    if len(text.strip()) < 2:
        raise ValueError("a search needs two characters")
    return text.strip()


UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
CODE5, CODE8 = r"^\d{5}$", r"^\d{8}$"


def one_of(column: str, values: list | None) -> Column:
    """An optional filter: no values, no restriction."""
    return F.col(column).isin(values) if values else F.lit(True)


def write_errors(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks (a rule that is NULL counts as broken)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))


def post_rules() -> dict[str, Column]:
    size = lambda c: F.char_length(F.trim(c))
    return {"title": size("title").between(2, 80), "body": size("body").between(1, 4000), "category": F.col("category").isin("free", "review", "question", "tip", "notice")}


def takedown_rules() -> dict[str, Column]:
    size = F.char_length(F.trim("reason"))
    return {"reason": size.between(50, 2000), "email": F.col("email").isNull() | F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")}


def optional(df: DataFrame, use: bool, predicate: Column) -> DataFrame:
    return df.where(predicate) if use else df
