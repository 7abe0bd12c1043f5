"""What keeps time and memory in proportion to the input: the shape of plans, and sizes of portions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.text import keyword_category
from tallyloom.operators import audit
from tallyloom.operators.etl import grids, rows


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_never_broadcast(spark):
    places = spark.range(8).select("id", F.lit("a").alias("name"), F.lit("k").alias("kakao_place_id"), F.lit(37.0).alias("lat"), F.lit(127.0).alias("lng"))
    candidates = places.select(F.col("id").alias("place_id"), F.lit("k").alias("candidate_id"), F.lit("a").alias("candidate_name"), F.lit("FD6").alias("group_code"), "lat", "lng")
    best = audit.candidate_scores(places, candidates)
    assert "BroadcastHashJoin" not in plan_of(best) and best.count() == 8


def test_text_is_lowered_once_for_all_keywords(spark):
    rows = spark.createDataFrame([(1, "한우 국밥 CAFE"), (2, None), (3, "x")], "id int, x string")
    found = rows.select("id", keyword_category(F.col("x"), {"b": ("cafe",), "a": ("국밥", "한우"), "c": ("국밥", "한우")}, "other").alias("food"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [tuple(r) for r in found.orderBy("id").collect()] == [(1, "a"), (2, "other"), (3, "other")]


def test_a_grid_is_shuffled_and_sorted_once(spark):
    cells = [["부서명: 총무과"], ["집행일자", "집행장소", "금액(원)"], ["2024-01-02", "식당", "10,000"]]
    grid = spark.createDataFrame([("a", "m", 0, k, c, None) for k, c in enumerate(cells)], grids.SCHEMA)
    found = rows.expense_rows(grid.repartition(2))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert [(r.row_no, r.department_name, r.place_text, r.amount) for r in found.collect()] == [(2, "총무과", "식당", 10_000)]


def test_headers_are_told_once_a_line():
    """Heads used to be looked up by lambdas, cell by cell, twice for every row that could begin a header."""
    cut = "\u0001"
    line = lambda *cells: cut.join(cells)
    at = lambda found: found and (found[0], {f: k for f, k in zip(rows.FIELDS, found[1:]) if k})
    head = line("집행일자", "집행장소", "집행유형", "집행유형", "금액(원)")
    assert at(rows.header_of(head, line("2024-01-02", "식당", "a", "b", "10"))) == (0, {"used_date": 1, "place_text": 2, "purpose": 3, "payment_method": 4, "amount": 5})
    assert at(rows.header_of(line("사용", "", "집행", "대상"), line("일자", "금액(원)", "집행장소", "인원"))) is None  # the upper line names nothing by itself
    assert at(rows.header_of(line("집행일자", "", "집행목적"), line("", "금액(원)", ""))) == (1, {"used_date": 1, "amount": 2, "purpose": 3})
    assert rows.header_of(line("집행일자", "금액(원)"), None) is None and rows.header_of(line("부서명: 총무과"), head) is None
    assert at(rows.header_of(line("구분", "사용자", "집행일자", "금액(원)"), None))[1]["expense_category"] == 1


def test_a_row_is_read_without_lambdas(spark):
    """Fields, casts and checks used to sit in lambdas, which Spark interprets; a cast that fails raises an error inside."""
    grid = spark.createDataFrame([], grids.SCHEMA)
    plan = rows.expense_rows(grid).select("used_at", "place_text", "amount")._jdf.queryExecution().optimizedPlan().toString()
    steps = [line for line in plan.splitlines() if "Generate" in line]
    assert len(steps) == 1 and "lambda" not in steps[0] and plan.count("ArrowEvalPython") == 1
    # what nobody asks for is not read
    assert "raw_excerpt" not in plan and "user_text" not in plan


def test_places_are_parted_once(spark):
    """The check of a place's name used to be moved before the step that makes it, and to make it again."""
    none = F.lit(None).cast("string")
    made = rows.expense_rows(spark.createDataFrame([], grids.SCHEMA))
    plan = rows.visits(made, {"region": none, "phase": none, "own_names": F.array(F.lit("a"))})._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp_extract" in line]
