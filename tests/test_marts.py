import itertools
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import grading, livability, serving

AS_OF = date(2026, 6, 1)
PLACES = "id string, name string, region string, category string, road_address string, lat double, lng double, valid_place boolean, is_restaurant_like boolean, is_large_chain boolean, hidden_at timestamp, deleted_at timestamp, is_closed boolean"


def place(i, region="R", **changes):
    row = {"id": i, "name": i, "region": region, "category": "c", "road_address": "a", "lat": 37.0, "lng": 127.0, "valid_place": True, "is_restaurant_like": True, "is_large_chain": False, "hidden_at": None, "deleted_at": None, "is_closed": False}
    return tuple((row | changes).values())


def visit(p, day=AS_OF, dept="d", agency="a"):
    return (p, agency, dept, day)


@pytest.fixture
def graded(spark):
    def run(places, visits):
        p = spark.createDataFrame(places, PLACES)
        v = spark.createDataFrame(visits, "place_id string, agency_id string, department_name string, visit_date date")
        return {r.place_id: r for r in grading.place_grade(p, v, AS_OF).collect()}, p, v

    return run


def test_scores_by_hand(graded):
    visits = [visit("x") for _ in range(8)] + [visit("y", dept=str(k)) for k in range(5)] + [visit("z", dept=str(k)) for k in range(7)] + [visit("n", dept=None)]
    rows, _, _ = graded([place(i) for i in "xyzn"], visits)
    assert [float(rows[i].score) for i in "xyzn"] == [2.4082, 3.8908, 6.3216, 0.0]


def test_window_borders_and_hidden_places(graded):
    a, b = date(2025, 6, 1), date(2025, 5, 31)
    rows, _, _ = graded([place("in"), place("out"), place("hid", hidden_at=datetime(2026, 1, 1)), place("chain", is_large_chain=True)], [visit("in", a), visit("out", b), visit("hid"), visit("chain")])
    assert set(rows) == {"in"}


def test_new_track_precedes_the_percentile(graded):
    edge = date(2026, 3, 1)
    rows, p, v = graded([place("new"), place("old")], [visit("new", edge), visit("new"), visit("old", edge - timedelta(days=1))])
    assert rows["new"].grade == "✦" and rows["old"].grade is None
    public = {r.id: r for r in grading.places_public(p, grading.place_grade(p, v, AS_OF)).collect()}
    assert public["old"].grade == "✦"  # ungraded shows as new


@pytest.mark.parametrize("n", [29, 30])
def test_small_regions_rank_nationwide(graded, n):
    places = [place(f"s{k}", "S") for k in range(n)] + [place(f"b{k}", None) for k in range(40)]
    visits = [visit(f"s{k}", dept=str(j)) for k in range(n) for j in range(k + 3)] + [visit(f"b{k}", dept=str(j)) for k in range(40) for j in range(60)]
    rows, _, _ = graded(places, visits)
    best = rows[f"s{n - 1}"]
    assert best.pct == (1.0 if n == 30 else pytest.approx((n - 1) / (n + 40 - 1)))
    assert rows["b0"].region is None and rows["b0"].region_places == 40  # NULL regions are one region


def test_nationwide_rank_equals_a_window(spark):
    from pyspark.sql.window import Window

    df = spark.range(500).select((F.col("id") * 7 % 40).alias("v"), "id")
    a = {r.id: r.p for r in grading.percent_rank_over_all(df, "v", "p").collect()}
    b = {r.id: r.p for r in df.withColumn("p", F.percent_rank().over(Window.orderBy("v"))).collect()}
    assert a == pytest.approx(b)
    assert grading.percent_rank_over_all(df.limit(1), "v", "p").first().p == 0.0


REGIONS = "adm_cd string, level string, parent_cd string, name string"


@pytest.fixture
def town(spark):
    regions = spark.createDataFrame([("11", "sido", None, "P"), ("1101", "sigungu", "11", "Q"), *[(f"e{k}", "emd", "1101", f"E{k}") for k in range(3)], ("lone", "emd", "1102", "L")], REGIONS)
    metrics = spark.createDataFrame(
        [("e0", "m", 0, "2023", 99.0), ("e0", "m", 0, "2024", 1.0), ("e1", "m", 0, "2024", 2.0), ("e2", "m", 0, "2024", None), ("e2", "m", 0, "2023", 3.0), ("e1", "m", 1, "2024", 50.0)]
        + [(e, "less", 0, "2024", v) for e, v in (("e0", 5.0), ("e1", 5.0), ("e2", 9.0), ("lone", 7.0))] + [("lone", "m", 0, "2024", 7.0)],
        "adm_cd string, metric_key string, household_size int, ref_period string, value double",
    )
    catalog = spark.createDataFrame([("m", "housing", 1), ("less", "safety", -1)], "metric_key string, category string, direction int")
    weights = spark.createDataFrame([(1, 1, "housing", 3)], "profile_version int, household_size int, category string, weight int")
    return metrics, catalog, regions, weights


def test_livability_rules(town):
    metrics, catalog, regions, weights = town
    latest = {(r.adm_cd, r.metric_key): r.value for r in livability.latest_metrics(metrics).collect()}
    assert latest["e0", "m"] == 1.0 and latest["e2", "m"] == 3.0
    f = {(r.adm_cd, r.category): r for r in livability.field_scores(metrics, catalog, regions).collect()}
    assert [f[e, "housing"].field_score for e in ("e0", "e1", "e2")] == [0.0, 50.0, 100.0]
    assert f["lone", "housing"].field_score == 0.0 and f["lone", "safety"].field_score == 100.0  # a lone region, by direction
    assert [f[e, "safety"].rank_in_sigungu for e in ("e0", "e1", "e2")] == [1, 1, 3]
    c = {r.adm_cd: r for r in livability.composite_scores(metrics, catalog, regions, weights).collect()}
    assert c["e2"].score == 100.0 and c["e2"].field_count == 1  # safety has no weight


def test_claims(spark):
    rows = spark.createDataFrame([(1, 25), (25, 25), (12, 25), (1, 1), (0, 0), (9, 25), (17, 25)], "r int, n int")
    got = [r.c for r in rows.select(livability.claim(F.col("r"), F.col("n")).alias("c")).collect()]
    assert got == ["strength", "weakness", None, "strength", None, "strength", "weakness"]


def test_summary_gate(spark):
    texts = ["Good housing here", "", "x" * 81 + "housing", "the best housing", "nothing named"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.e for r in df.select(livability.summary_errors(F.col("t"), F.array(F.lit("housing")), ["best"]).alias("e")).collect()]
    assert got == [[], ["empty", "no_strength"], ["too_long"], ["banned:best"], ["no_strength"]]


def test_unpivot_drops_non_numbers(spark):
    df = spark.createDataFrame([("a", "1,200", "N/A", ""), ("b", "x", "3.5", None)], "k string, p string, q string, r string")
    assert sorted(map(tuple, livability.unpivoted_metrics(df, "k", ["p", "q", "r"]).collect())) == [("a", "p", 1200.0), ("b", "q", 3.5)]


def test_tree_has_empty_lists(town):
    rows = {r.adm_cd: r.children for r in serving.region_tree(town[2]).collect()}
    assert [c.adm_cd for c in rows["11"]] == ["1101"]


def test_moving_mean_starts_empty(spark):
    df = spark.createDataFrame([(date(2026, 1, d), n) for d, n in ((1, 10), (2, 10), (3, 20))], "day date, n long")
    got = serving.running_mean(df, "day", "n").orderBy("day").collect()
    assert [(r.mean_before, r.alert) for r in got] == [(None, False), (10.0, False), (10.0, True)]


def test_best_summary_prefers_the_household(spark):
    df = spark.createDataFrame([("a", 0, 1, "general", "rule"), ("a", 2, 1, "two", "llm"), ("b", 0, 1, "g", "rule"), ("b", 3, 1, "three", "rule")], "adm_cd string, household_size int, profile_version int, summary string, source string")
    assert {r.adm_cd: r.summary for r in serving.best_summary(df, 2).collect()} == {"a": "two", "b": "g"}


def test_ranks_do_not_go_by_the_order_of_rows(spark, monkeypatch):
    """Two regions of the same fields rank alike, though their rows come in another order."""
    names = ("convenience", "education", "housing")
    values = (100 / 11, 100 / 11 * 2, 100 / 11 * 4)
    rows = [(str(k), "p", *one, 1) for k, order in enumerate(itertools.permutations(zip(names, values))) for one in order]
    fields = spark.createDataFrame(rows, "adm_cd string, parent_cd string, category string, raw double, metric_count long").coalesce(1)
    monkeypatch.setattr(livability, "fields", lambda *_: fields)
    weights = spark.createDataFrame([(1, 1, names[0], 28), (1, 1, names[1], 5), (1, 1, names[2], 15), (1, 2, names[0], 14), (1, 2, names[1], 24), (1, 2, names[2], 16)], "profile_version int, household_size int, category string, weight int")
    got = livability.composite_scores(None, None, None, F.broadcast(weights)).collect()
    assert len(got) == 12 and {r.rank_in_sigungu for r in got} == {1}
