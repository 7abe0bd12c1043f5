"""Names, queries, labels, boxes, highlights, excerpts, reports: small cases by hand."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import geo, text
from tallyloom.operators import audit, serving, sourcing
from tallyloom.sources import tables


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def lit(*values):
    return [F.lit(v).cast("string") if v is None else F.lit(v) for v in values]


def test_urls(spark):
    urls = ["https://a.kr/l?x=1&page=3&y=2#top", "https://a.kr/l", "https://a.kr/l?x=1", "https://a.kr/l?page=1"]
    assert one(spark, *[text.with_page(F.lit(u), F.lit(7)) for u in urls]) == ["https://a.kr/l?x=1&page=7&y=2#top", "https://a.kr/l?page=7", "https://a.kr/l?x=1&page=7", "https://a.kr/l?page=7"]
    assert one(spark, *[text.download_identity(F.lit(u)) for u in ("https://a.kr/d?id=1&token=9&name=b#x", "https://a.kr/d?KEY=1&id=2")]) == ["https://a.kr/d?id=1&name=b", "https://a.kr/d?id=2"]


def test_names_that_are_no_places(spark):
    case = lambda *v: text.strictly_no_place(*[F.lit(v[0]).cast("string"), F.lit(v[1]).cast("string"), F.lit(v[2]).cast("double"), F.lit(v[3]).cast("double"), F.lit(v[4]).cast("string")])
    cases = [("주민 간담회", "k1", 37.0, 127.0, "pass"), ("주민 간담회", None, 37.0, 127.0, "pass"), ("직원 격려 만찬", "k", 0.0, 127.0, None), ("한식당", None, None, None, "fail"), (None, None, None, None, None), ("격려오찬 및 지역 현안을 위한 긴 이름의 자리", "k", 37.0, 127.0, None)]
    assert one(spark, *[case(*c) for c in cases]) == [False, True, True, False, False, True]
    assert one(spark, *[text.holds_non_place_hint(F.lit(n).cast("string")) for n in ("정책 논의", "국밥집", None)]) == [True, False, False]


def test_what_is_asked_of_a_map(spark):
    assert one(spark, text.place_queries(*lit("한식당", "길 1", None, "종로구")))[0] == ["한식당 길 1", "한식당", "한식당 종로구"]
    assert one(spark, text.place_queries(*lit("", None, None, None)))[0] == []
    assert one(spark, text.agency_queries(*lit("종로구청", "종로구", "서울특별시")))[0] == ["종로구청", "서울특별시 종로구청"]
    asked = one(spark, text.agency_queries(*lit("상수도", "", None)))[0]
    assert asked[0] == "상수도" and asked[1] == " 수도사업소" and len(asked) == 6


def test_labels(spark):
    assert one(spark, *[text.confidence(F.lit(c).cast("string")) for c in ("0.65", " High ", "보통", None, "perhaps")]) == [0.65, 0.9, 0.7, 0.8, None]
    assert one(spark, *[text.day_label(F.lit(c).cast("string")) for c in ("2026-05-22T10:00:00", "2026-05-22", "soon", None)]) == ["2026.05.22", "2026.05.22", "soon", None]
    assert one(spark, *[text.grade_label(F.lit(c).cast("string")) for c in ("★★★", "✦", None)]) == ["최다 방문", "신규", "신규"]
    assert one(spark, *[text.short_region(F.lit(c)) for c in ("서울 종로구", "부산 중구", " 경기 성남시")]) == ["종로구", "부산 중구", "성남시"]
    a, b, c = one(spark, *[text.reporter_fingerprint(*lit(*v)) for v in (("1.2.3.4, 9.9.9.9", "8.8.8.8", "x"), (" 1.2.3.4", None, "x"), (None, "1.2.3.4", "x"))])
    assert a == b == c and len(a) == 64


def test_boxes_of_geometries(spark):
    shapes = ['{"type":"MultiPolygon","coordinates":[[[[126.5,37.0],[127.5, 38.0]]],[[[-1e0,36.5]]]]}', '{"type":"Point","coordinates":[127, 37.5]}', '{"type":"Point","coordinates":[]}']
    got = one(spark, *[geo.geometry_box(F.lit(s)) for s in shapes])
    assert tuple(got[0]) == (37.25, 63.25, -1.0, 36.5, 127.5, 38.0)
    assert tuple(got[1]) == (37.5, 127.0, 127.0, 37.5, 127.0, 37.5) and got[2] is None


def test_highlights_and_evidence(spark):
    fields = spark.createDataFrame([("a", c, r, 6) for c, r in (("housing", 2), ("education", 1), ("convenience", 4), ("safety", 6))], "adm_cd string, category string, rank_in_sigungu int, sigungu_count int")
    counts = spark.createDataFrame([("a", "s", "pip", 3), ("a", "p", "pip", 0), ("a", "s", "near", 9), ("a", "c", "pip", 2)], "adm_cd string, poi_type string, distance_basis string, count long")
    types = spark.createDataFrame([("s", "education", "Schools", 1), ("p", "housing", "Parks", 2), ("c", "convenience", "Shops", 3)], "poi_type string, category string, display_name string, sort_order int")
    r = serving.highlights(fields, serving.poi_evidence(counts, types)).first()
    assert (r.strengths, r.weaknesses, r.evidence) == (["education", "housing"], ["safety", "convenience"], ["Schools 3"])
    assert one(spark, serving.top_percent(F.lit(1), F.lit(8)))[0] == 13
    with pytest.raises(ValueError):
        serving.boundary(counts, "123")


def test_client_list_finds_food_categories(spark):
    public = spark.createDataFrame([(1, "스시집", None, "서울", "일식", 37.0, 127.0, False, "★"), (2, "김밥나라", None, "서울", "분식", 0.0, 127.0, False, "★"), (3, "스시집", None, "서울", "일식", 37.0, 127.0, True, "★")], "id int, name string, road_address string, region string, category string, lat double, lng double, is_closed boolean, grade string")
    assert [(r.id, r.on_map) for r in serving.client_list(public, "SUSHI").collect()] == [(1, True)]
    assert [(r.id, r.on_map) for r in serving.client_list(public, "김밥").collect()] == [(2, False)]


def test_agencies_sort_as_korean_text(spark):
    rows = [("나", None), ("가", ""), ("B", "x"), ("a", "x")]
    df = spark.createDataFrame([(n, t, "b", "p", "r", "s") for n, t in rows], "short_name string, gov_tier string, branch string, expansion_phase string, parent_region string, sub_region string")
    assert [r.short_name for r in df.orderBy(*serving.agency_order()).collect()] == ["가", "나", "a", "B"]


def test_excerpts_of_anomalies(spark):
    places = spark.createDataFrame([(1, "부산 중구", "부산 1")], "id int, road_address string, jibun_address string").withColumns({"hidden_at": F.lit(None).cast("timestamp"), "deleted_at": F.lit(None).cast("timestamp")})
    agencies = spark.createDataFrame([(7, "서울특별시", "A"), (8, "부산", "B"), (9, "서울특별시", "C")], "id int, parent_region string, name string")
    visits = spark.createDataFrame([(k, 1, a, e) for k, a, e in ((1, 7, "e1"), (2, 7, None), (3, 9, "e3"), (4, 8, "no"), (5, 7, "e5"), (6, 7, "e6"), (7, 7, "e7"))], "visit_id long, place_id int, agency_id int, excerpt string")
    short = F.when(F.col("parent_region") == "서울특별시", "서울").otherwise(F.col("parent_region"))
    r = audit.anomaly_groups(visits, agencies, places, short, "excerpt").first()
    assert (r.visits, r.agencies, r.names, r.excerpts) == (6, 2, ["A", "C"], ["e1", "e3", "e5"])
    assert "excerpts" not in audit.anomaly_groups(visits, agencies, places, short).columns


def test_rules_stand_in_for_missing_answers(spark):
    answered = spark.createDataFrame([("a", "x", 0.9)], "doc_id string, place_text string, confidence double")
    rows = spark.createDataFrame([("a", "y", 0.82), ("b", "z", 0.82)], "doc_id string, place_text string, confidence double")
    assert sorted((r.doc_id, r.place_text) for r in sourcing.with_fallback(answered, rows).collect()) == [("a", "x"), ("b", "z")]


def test_markdown_report(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "name string, n int")
    tables.write_markdown(spark, f"{tmp_path}/r", "Audit", {"Names": df})
    assert "".join(r.value for r in spark.read.option("lineSep", "\x00").text(f"{tmp_path}/r").collect()) == "# Audit\n\n## Names\n\n| name | n |\n| --- | --- |\n| a\\|b | 1 |\n|  | 2 |\n"
    with pytest.raises(ValueError):
        tables.markdown_report("x", {"s": spark.range(5)}, most_rows=4)


def test_region_names_are_shortened_and_the_third_address_part_is_read(spark):
    from tallyloom.operators import audit

    agencies = spark.createDataFrame([(1, "충청남도", "a"), (2, "한밭_시", "b"), (3, "부산광역시", "c"), (4, None, "d")], "id int, parent_region string, name string")
    places = spark.createDataFrame(
        [(1, "충남 들군 1", "x", None), (2, "충북 산시 1", "충북 산시 2", None), (3, "한밭X시 1", "한밭X시 2", None), (4, None, None, "부산광역시 해구"), (5, "대구 1", "대구 2", "y z")],
        "id int, road_address string, jibun_address string, road_address_part string",
    ).selectExpr("*", "CAST(NULL AS TIMESTAMP) AS hidden_at", "CAST(NULL AS TIMESTAMP) AS deleted_at")
    visits = spark.createDataFrame([(10 * a + p, p, a) for a in (1, 2, 3, 4) for p in (1, 2, 3, 4, 5)], "visit_id int, place_id int, agency_id int")
    got = {r.visit_id: (r.short, r.first_token) for r in audit.geo_anomalies(visits, agencies, places).collect()}
    assert set(got) == {12, 13, 15, 21, 22, 25, 31, 32, 33, 35}  # a wildcard in a name still is one; unknown addresses are no anomaly
    assert got[12] == ("충남", "충북") and got[31] == ("부산광역시", "충남")
    assert audit.geo_anomalies(visits, agencies.withColumn("parent_region", F.lit("대구")), places.where("id = 5")).count() == 0


def test_parallel_arrays(spark):
    from tallyloom.operators import merge

    df = spark.createDataFrame([(1, [1, 2, 3], ["a"]), (2, None, ["b"]), (3, [], []), (4, [4], None)], "k int, xs array<int>, ys array<string>")
    got = merge.unnested(df, x="xs", y="ys")
    assert got.columns == ["k", "x", "y"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1, "a"), (1, 2, None), (1, 3, None), (2, None, "b"), (4, 4, None)], key=str)
