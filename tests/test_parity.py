"""Every registered query of the engine's own operators against its SQL, over the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from tallyloom.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    result = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted(str([plain(r[c]) for c in order]) for r in df.collect())
    want = sorted(str([plain(r[columns.index(c)]) for c in order]) for r in result.fetchall())
    assert got == want


def test_marts_and_serving_stay_in_the_jvm(spark):
    for name in ("place_grade", "livability_composite", "places_search_score", "region_counts", "quality_gates", "audit_status"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.queries()["place_grade"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan
    read = [line for line in plan.splitlines() if "ReadSchema" in line and "l_partkey" in line]
    assert read and all("l_tax" not in line.split("ReadSchema")[1] for line in read)
