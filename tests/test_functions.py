import datetime
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import dates, geo, predicates, text
from tallyloom.functions import vocabulary as V


def apply(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.o for r in df.select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


def test_amounts_and_parties(spark):
    assert apply(spark, ["1,234,567", "1 234", "N/A", None, "-1,000", "12.5"], text.amount) == [1234567, 1234, None, None, 1000, 125]
    assert apply(spark, ["12명", "0", "", None], text.positive_digits) == [12, None, None, None]
    assert apply(spark, ["홍길동 외 5명", "직원 7명", "0명", "외 0명", "없음", "외3인"], text.party_size) == [6, 7, None, 1, None, 4]


def test_dates(spark):
    cases = {
        ("26.04.30", None): datetime.datetime(2026, 4, 30),
        ("70.01.01", None): datetime.datetime(1970, 1, 1),
        ("2026-05-22 11:53", None): datetime.datetime(2026, 5, 22, 11, 53),
        ("2026년 5월 2일", "09:07"): datetime.datetime(2026, 5, 2, 9, 7),
        ("2026.13.01", None): None,
        ("17", None): None,
        ("17일", "10:00"): None,
        ("soon", None): None,
        (None, "10:00"): None,
    }
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, d string, t string")
    got = [r.o for r in df.select("k", dates.used_at(F.col("d"), F.col("t")).alias("o")).orderBy("k").collect()]
    assert got == list(cases.values())
    assert apply(spark, ["on 2024/2/29 x", "2023-02-29", "2024년 1월 5일"], dates.day_of) == [datetime.date(2024, 2, 29), None, datetime.date(2024, 1, 5)]


def test_names_and_brands(spark):
    assert apply(spark, ["(주) 회센터 본점", "A·B.C-D"], text.name_key) == ["센터본점", "abcd"]
    assert apply(spark, ["정보 없음", "N.A", "-", None, "김밥집"], text.is_place_name) == [False, False, False, False, True]
    names = ["Starbucks 강남점", "메가MGC커피", "McDonald's", "BBQ치킨 종로", "동네식당", "스타벅스 투썸", None]
    assert apply(spark, names, text.chain_brand) == ["스타벅스", "메가커피", "맥도날드", "BBQ", None, "스타벅스", None]


def test_regions_and_places(spark):
    assert apply(spark, ["서울특별시 강남구 1", "경기도 성남시 분당구", "인천광역시 연수구", "부산 중구", None], text.region_part) == ["서울 강남구", "경기 성남시", "인천 연수구", None, None]
    got = apply(spark, ["식당 (서울 종로구)", "식당(본점) 2층", "  그냥  식당 "], text.place_parts)
    assert [(r.name, r.address_hint) for r in got] == [("식당", "서울 종로구"), ("식당(본점) 2층", None), ("그냥 식당", None)]
    df = spark.createDataFrame([("n", "a", None, "p (x)"), ("n", None, "h", "p"), (None, None, None, "p"), ("n", None, None, None), (None, "a", None, None)], "n string, a string, h string, e string")
    assert [r.o for r in df.select(text.place_text(*map(F.col, "nahe")).alias("o")).collect()] == ["p (x)", "n(h)", "p", "n", None]


def test_masking_matches_python(spark):
    pattern = re.compile(V.name_before_rank(V.RANKS))
    cases = ["홍길동 과장 외 3명", "총무과장", "감사담당관", "홍길동담당관", "의사입법담당관 회의", "김철수부시장, 이영희 팀장", "abc홍길동과장", "과장님"]
    want = [pattern.sub(lambda m: f"○○{m[2]}{m[3]}", c).strip() for c in cases]
    assert apply(spark, cases, text.masked_names) == want
    assert apply(spark, ["감사담당관", "홍길동담당관", "홍길동 담당관", "의회 김철수 과장", None], text.names_in_department) == [False, True, True, True, False]


def test_user_text(spark):
    cases = [
        ("홍길동 시장 외 5명", "비서실", "서울특별시", "p1"),
        ("홍길동 과장 외 2명", "총무과", "서울특별시", "p1"),
        ("직원 7명", "총무과", "서울특별시", "p1"),
        ("종로구청 구청장 등 3명", "종로구 구청장", "서울특별시", "p1"),
        ("홍길동 시장", "본부", "서울특별시", "p2"),
        (None, "", "서울특별시", "p1"),
    ]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, u string, d string, r string, p string")
    out = text.with_user_text(df, "u", "d", F.col("r"), F.col("p"), F.array(F.lit("종로구"))).orderBy("k").collect()
    assert [(r.representative, r.rank_label, r.party_size, r.department) for r in out] == [
        ("홍길동", "시장", 6, "비서실"),
        (None, "과장", 3, "총무과"),
        (None, "5급 이하", 7, "총무과 외"),
        (None, "구청장", 3, "종로구"),
        (None, "5급 이하", None, "본부 외"),
        (None, "5급 이하", None, "서울시본청 외"),
    ]


def test_food_categories(spark):
    f = lambda c: text.keyword_category(c, V.FOOD, V.DEFAULT_FOOD)
    assert apply(spark, ["마라탕 훠궈", "삼겹살 초밥", "이름 없는 집", "Tonkatsu Cutlet house"], f) == ["malatang", "sushi", V.DEFAULT_FOOD, "donkatsu"]


def test_query_names_and_hangul(spark):
    assert apply(spark, ["주식회사 가나 다라 마바 본점", "하나", "(㈜)"], text.query_names) == [["가나 다라 마바 본점", "마바 본점", "다라 마바 본점"], ["하나"], []]
    df = spark.createDataFrame([("가나다", "가나"), ("가나다", "라가"), ("가", "가"), ("abc", "가"), ("가가", "가")], "a string, b string")
    assert [r.o for r in df.select(text.common_hangul(F.col("a"), F.col("b")).alias("o")).collect()] == [True, False, True, True, True]


def plain_geohash(lat, lng, n=7):
    a, b, out, bits, even = [-90.0, 90.0], [-180.0, 180.0], "", [], True
    while len(out) < n:
        box, v = (b, lng) if even else (a, lat)
        mid = sum(box) / 2
        bits.append(v >= mid)
        box[0 if v >= mid else 1] = mid
        even = not even
        if len(bits) == 5:
            out += geo.BASE32[sum(x << (4 - k) for k, x in enumerate(bits))]
            bits = []
    return out


def test_geohash_and_distance(spark):
    points = [(37.5665, 126.978), (0.0, 0.0), (90.0, 180.0), (-90.0, -180.0), (33.1, 131.9)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k int, lat double, lng double")
    got = [r.g for r in df.select("k", geo.geohash(F.col("lat"), F.col("lng")).alias("g")).orderBy("k").collect()]
    assert got == [plain_geohash(*p) for p in points]
    d = spark.range(1).select(geo.haversine(F.lit(37.5665), F.lit(126.978), F.lit(35.1796), F.lit(129.0756))).first()[0]
    assert d == pytest.approx(325_000, rel=0.01)


def test_polygons(spark):
    holed = '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]]}}'
    multi = '{"type":"MultiPolygon","coordinates":[[[[3,3],[6,3],[6,6],[3,6],[3,3]]],[[[10,10],[11,10],[11,11],[10,11],[10,10]]]]}'
    polygons = spark.createDataFrame([("H", 0, holed), ("M", 1, multi)], "code string, order int, g string").select("code", "order", geo.polygon_rings(F.col("g")).alias("rings"))
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 3.5, 3.5), (4, 5.0, 5.0), (5, 10.5, 10.5), (6, 7.0, 7.0)], "id int, lng double, lat double")
    assert {r.id: r.code for r in geo.points_in_polygons(points, polygons).collect()} == {1: "H", 3: "H", 4: "M", 5: "M"}


def test_projection_of_the_origin(spark):
    r = spark.range(1).select(geo.grid_to_degrees(F.lit(1_000_000.0), F.lit(2_000_000.0)).alias("o"), geo.grid_to_degrees(F.lit(1_100_000.0), F.lit(1_900_000.0)).alias("p")).first()
    assert (r.o.lat, r.o.lng) == (38.0, 127.5)
    assert r.p.lat == pytest.approx(37.096, abs=0.01) and r.p.lng == pytest.approx(127.5 + math.degrees(100_000 / 0.9996 / 6_378_137 / math.cos(math.radians(37.1))), abs=0.01)


def bessel_position(lat, lng):
    """The way back, in plain numbers: degrees of today's datum to the older grid."""
    p, q = math.radians(lat), math.radians(lng)
    f = 1 / 298.257223563
    n = 6_378_137.0 / math.sqrt(1 - f * (2 - f) * math.sin(p) ** 2)
    here = np.array([n * math.cos(p) * math.cos(q), n * math.cos(p) * math.sin(q), n * (1 - f) ** 2 * math.sin(p)])
    rx, ry, rz = (math.radians(t / 3600) for t in (1.16, -2.31, -1.63))
    turn = (1 + 6.43e-6) * np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]])
    u, v, w = np.linalg.solve(turn, here - np.array([-115.80, 474.99, 674.11]))
    a, f = 6_377_397.155, 1 / 299.1528128
    e2 = f * (2 - f)
    p = math.atan2(w, math.hypot(u, v) * (1 - e2))
    for _ in range(20):
        p = math.atan2(w + e2 * a / math.sqrt(1 - e2 * math.sin(p) ** 2) * math.sin(p), math.hypot(u, v))
    far = math.atan2(v, u) - math.radians(127.0028902777778)
    # the arc of a meridian summed up in small steps, and the forward series
    steps = np.linspace(math.radians(38), p, 20_001)
    density = a * (1 - e2) / (1 - e2 * np.sin(steps) ** 2) ** 1.5
    arc = float(((density[1:] + density[:-1]) / 2 * np.diff(steps)).sum())
    n, t, c = a / math.sqrt(1 - e2 * math.sin(p) ** 2), math.tan(p) ** 2, e2 / (1 - e2) * math.cos(p) ** 2
    k = far * math.cos(p)
    x = n * (k + (1 - t + c) * k**3 / 6 + (5 - 18 * t + t * t + 72 * c) * k**5 / 120)
    y = arc + n * math.tan(p) * (k**2 / 2 + (5 - t + 9 * c + 4 * c * c) * k**4 / 24 + (61 - 58 * t + t * t) * k**6 / 720)
    return 200_000 + x, 500_000 + y


def test_projection_of_the_older_grid(spark):
    places = [(37.5665, 126.978), (35.1796, 129.0756), (33.4996, 126.5312), (38.2, 127.0)]
    df = spark.createDataFrame([(*p, *bessel_position(*p)) for p in places] + [(0.0, 0.0, None, 1.0)], "lat double, lng double, x double, y double")
    for r in df.select("*", geo.bessel_to_degrees(F.col("x"), F.col("y")).alias("p"), geo.grid_to_degrees(F.col("x"), F.col("y"), geo.BESSEL_GRID).alias("old")).collect():
        if r.x is None:
            assert (r.p.lat, r.p.lng) == (None, None)
        else:
            assert (r.p.lat, r.p.lng) == pytest.approx((r.lat, r.lng), abs=2e-7)
            assert 200 < 111_320 * math.hypot(r.p.lat - r.old.lat, (r.p.lng - r.old.lng) * math.cos(math.radians(r.lat))) < 600


def test_request_parameters():
    assert predicates.parse_box("33,124,39,132") == (33.0, 124.0, 39.0, 132.0)
    for bad in ("1,2,3", "a,b,c,d", "1,2,3,nan"):
        with pytest.raises(ValueError):
            predicates.parse_box(bad)
    assert predicates.parse_grades("in.(3,pick,3,odd)", strict=False) == ["★★★", "✦"]
    assert predicates.parse_grades(None, strict=True) == ["★★★", "★★", "✦"]
    with pytest.raises(ValueError):
        predicates.parse_grades("odd", strict=True)
    assert [predicates.clamp_limit(x, 100, 1000) for x in (None, "", "abc", "5000", -3, "7.9")] == [100, 1, 100, 1000, 1, 7]
    with pytest.raises(ValueError):
        predicates.search_text(" a ")


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=20))
def test_limits_are_always_in_range(value):
    assert 1 <= predicates.clamp_limit(value, 50, 100) <= 100


def test_write_rules(spark):
    df = spark.createDataFrame([("t", "b", "free"), ("title", "body", "free"), ("title", None, "odd")], "title string, body string, category string")
    assert [r.e for r in df.select(predicates.write_errors(predicates.post_rules()).alias("e")).collect()] == [["title"], [], ["body", "category"]]
