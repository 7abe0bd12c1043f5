import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.etl import grammar, grids, resolve, rows


def xlsx(cells):
    out = io.BytesIO()
    body = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(cells))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="urn:x"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/styles.xml", "<broken")
    return out.getvalue()


HEAD = ["집행일자", "집행장소", "집행목적", "인원", "금액(원)"]
ROW = ["2026-05-22", "한식당 (서울 종로구)", "업무 협의", "4명", "77,400"]


def test_grids_from_bytes():
    page = '<table><tr><th colspan=2>제목</th></tr><tr><td rowspan="2">a</td><td>b&nbsp;<br>c</td></tr><tr><td>d</table>'
    assert grids.html_grids(page) == [[["제목", "제목"], ["a", "b c"], ["a", "d"]]]
    assert grids.xlsx_grids(xlsx([["a", None, "c"], []])) == [[["a", "", "c"], []]]
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("z.html", "<table><tr><td>h</table>")
        z.writestr("b.xlsx", xlsx([["x"]]))
        z.writestr("notes.txt", "no")
    assert [(m, g) for m, _, g in grids.grids("all.zip", box.getvalue())] == [("b.xlsx", [["x"]]), ("z.html", [["h"]])]
    assert list(grids.grids("old.xls", b"  <html><table><tr><td>1</table>"))[0][2] == [["1"]]
    with pytest.raises(ValueError):
        list(grids.grids("a.pdf", b"%PDF"))


def test_documents_to_visits(spark):
    content = xlsx([["부서명: 총무과"], HEAD, ROW, ["2026-05-23", "합계", "", "", "1"], ["2026-05-24", "꽃집", "축의금", "", "50,000"], ["미상", "x", "y", "", "3"]])
    docs = spark.createDataFrame([("d1", "a.xlsx", bytearray(content)), ("d2", "b.hwp", bytearray(b"\xd0\xcf")), ("d3", None, None)], "doc_id string, name string, content binary")
    g = grids.document_rows(docs)
    assert {r.doc_id for r in g.where("error IS NOT NULL").collect()} == {"d2", "d3"}
    r = rows.expense_rows(g)
    out = r.collect()
    assert len(out) == 3 and {x.department_name for x in out} == {"총무과"}
    agency = {"region": F.lit("서울특별시"), "phase": F.lit("p1"), "own_names": F.array().cast("array<string>")}
    v = rows.visits(r, agency).collect()
    assert [(x.visit_date, x.place_name, x.address_hint, x.amount, x.held) for x in v] == [(datetime.date(2026, 5, 22), "한식당", "서울 종로구", 77400, [])]


def test_thousands_header_and_key_value(spark):
    schema = grids.SCHEMA
    g = spark.createDataFrame([("d", "m", 0, 0, ["(단위: 천원)"], None), ("d", "m", 0, 1, HEAD, None), ("d", "m", 0, 2, ["26.5.2", "집", "x", "", "77"], None)], schema)
    assert [(r.amount, r.used_at) for r in rows.expense_rows(g).collect()] == [(77000, datetime.datetime(2026, 5, 2))]
    kv = spark.createDataFrame([("d", "m", 0, 0, ["부서명", "총무과", "집행금액", "1,000"], None), ("d", "m", 0, 1, ["장소", "집"], None)], schema)
    r = rows.key_value_rows(kv).first()
    assert (r.department_name, r.amount, r.place_text) == ("총무과", "1,000", "집")


def test_header_forms(spark):
    """Headers of two rows, kinds beside users, spending kinds, days completed by the sheet's month."""
    def sheet(n, *cells):
        return [("d", "m", n, k, list(c), None) for k, c in enumerate(cells)]

    g = spark.createDataFrame(
        sheet(0, ["2026년 5월 업무추진비"], ["부서명 : 총무과"], ["사용", "", "장소", "사용", "금액"], ["월", "일", "", "내역", ""], ["5", "22", "한식당", "회의", "12,000"])
        + sheet(1, ["2026. 4월"], ["구분", "일자", "집행유형", "사용자", "집행유형", "금액"], ["시책", "3", "간담회 식사", "과장", "카드", "9,000"])
        + sheet(2, ["집행목적(상세)", "집행장소 및 주소", "일자", "금액"], ["협의", "분식집", "2026-01-02", "7,000"])
        + sheet(3, ["일자", "", "금액"], ["집행", "목적", "액"], ["2026-01-02", "협의", "7,000"])
        + sheet(5, ["2026년 1월"], ["일자", "", "사용처", "금액"], ["2", "14", "국밥집", "8,000"], ["15", "", "국밥집", "8,500"])
        + sheet(4, ["일자", "내용", "비고"], ["2026-01-02", "협의", "7,000"]),
        grids.SCHEMA,
    )
    out = rows.expense_rows(g).collect()
    got = {r.sheet: r for r in out}
    assert sorted(got) == [0, 1, 2, 5]
    assert sorted(r.used_at.date().isoformat() for r in out if r.sheet == 5) == ["2026-01-15", "2026-02-14"]
    assert (got[0].used_at, got[0].place_text, got[0].purpose, got[0].department_name) == (datetime.datetime(2026, 5, 22), "한식당", "회의", "총무과")
    assert (got[1].used_at, got[1].place_text, got[1].payment_method, got[1].user_text, got[1].expense_category) == (datetime.datetime(2026, 4, 3), "간담회 식사", "카드", "과장", "시책")
    assert (got[2].place_text, got[2].purpose, got[2].amount) == ("분식집", "협의", 7000)


def test_workbooks_are_read_up_to_the_sheet_limit():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(1, 24):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="urn:x"><sheetData><row><c t="inlineStr"><is><t>{k}</t></is></c></row></sheetData></worksheet>')
    assert [g[0][0] for _, _, g in grids.grids("a.xlsx", out.getvalue())] == [str(k) for k in range(1, 21)]


def test_islands(spark):
    df = spark.createDataFrame([("d", k, v) for k, v in enumerate(["head", "1", "a", "b", "2", "c"])], "doc string, k int, v string")
    got = rows.islands(df, F.col("v").rlike("^[0-9]$"), "doc", "k", "v").orderBy("island").collect()
    assert [r.cells for r in got] == [["1", "a", "b"], ["2", "c"]]


def test_grammars_in_order(spark):
    texts = [
        ("lines", "2026.05.22 12:30 분식집 업무 협의 4명 48,000\n머리말\n2026-05-23 국밥집(종로) 12,000 회의"),
        ("whole", "일시: 2026.05.22\n장소: 국밥집\n금액: 12,000원\n일시: 2026.05.23\n장소: 분식집\n금액: 9,000원"),
        ("none", "아무것도 아님"),
    ]
    more = {"lines": (*grammar.FORMS, *grammar.MORE_LINES), "whole": grammar.MORE_WHOLE}
    got = grammar.parse_texts(spark.createDataFrame(texts, "doc_id string, text string"), **more).orderBy("doc_id", "line_no").collect()
    assert [(r.doc_id, r.grammar, r.place, r.amount) for r in got] == [
        ("lines", "day_clock_place_purpose_party_amount", "분식집", "48,000"),
        ("lines", "day_place_amount_purpose", "국밥집(종로)", "12,000"),
        ("whole", "labelled_block", "국밥집", "12,000"),
        ("whole", "labelled_block", "분식집", "9,000"),
    ]


PLACES = "place_key string, name string, address_hint string, source_lat double, source_lng double, agency_lat double, agency_lng double, agency_tier string, parent_region string"
CANDIDATES = "place_key string, query_no int, rank int, c_id string, c_name string, c_group_code string, c_category string, c_road_address string, c_jibun_address string, c_lat double, c_lng double"


def test_resolution(spark):
    p = spark.createDataFrame(
        [
            ("food", "한식당", None, None, None, 37.5, 127.0, "local", "서울특별시"),
            ("far", "한식당", None, None, None, 37.5, 127.0, "regional", "서울특별시"),
            ("nation", "한식당", None, None, None, 37.5, 127.0, "national", "대한민국"),
            ("unlike", "가나다", "서울 종로구 길 1", None, None, None, None, "local", "서울특별시"),
            ("source", "한식당", "서울 종로구", 37.5, 127.0, None, None, "local", "서울특별시"),
        ],
        PLACES,
    )
    c = lambda key, rank, code, lat, road="서울 종로구 길 1", name="한식당 본점": (key, 0, rank, f"{key}{rank}", name, code, "음식점 > 한식", road, None, lat, 127.0)
    cand = spark.createDataFrame([c("food", 1, "CE7", 37.5), c("food", 2, "FD6", 37.51), c("far", 1, "FD6", 38.2), c("nation", 1, "FD6", 35.0, "부산 중구 길 1"), c("unlike", 1, "FD6", 37.5, name="라마바"), c("source", 1, "FD6", 37.504)], CANDIDATES)
    got = {r.place_key: r for r in resolve.resolved(p, cand).collect()}
    assert {k: r.kakao_place_id for k, r in got.items()} == {"food": "food2", "far": None, "nation": "nation1", "unlike": None, "source": None}
    assert (got["far"].lat, got["far"].matched) == (37.5, False)  # the agency's place
    assert got["source"].lat == 37.5 and got["food"].region == "서울 종로구"


def test_natural_keys(spark):
    df = spark.createDataFrame([("(주)가나 식당", "서울 종로구 1-2", None, None), ("가나식당", "서울종로구12", None, None), ("가나식당", "x", 37.5665, 126.978)], "n string, a string, lat double, lng double")
    keys = [r.k for r in df.select(resolve.natural_key(F.col("n"), F.col("a"), F.col("lat"), F.col("lng")).alias("k")).collect()]
    assert keys[0] != keys[2] and len(keys[0]) == 40


def test_cache_of_answers(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "query_key string")
    cache = spark.createDataFrame([("a", "1", datetime.datetime(2026, 5, 30)), ("b", "2", datetime.datetime(2026, 5, 1))], "query_key string, answer string, created_at timestamp")
    hit, ask = resolve.cached_answers(q, cache, F.lit(datetime.datetime(2026, 6, 1)))
    assert [r.query_key for r in hit.collect()] == ["a"] and sorted(r.query_key for r in ask.collect()) == ["b", "c"]


def test_departments_of_files(spark):
    from tallyloom.operators import sourcing

    names = ["2026년 부시장 업무추진비.xlsx", "시장 업무추진비.pdf", "업무추진비(총무과).xls", "5월 (26.05) 문화체육과 내역", "알림.pdf", "3월 총무과 내역", "제1부의장(의회사무국)"]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string")
    got = [r.d for r in df.select("k", sourcing.department_of_file(F.col("n"), F.lit("시")).alias("d")).orderBy("k").collect()]
    assert got == ["시 부시장", "시 시장", "시 총무과", "시", "시", "시 총무과", "시 사무국"]


def test_answers_of_models(spark):
    from tallyloom.operators import sourcing

    answer = 'Here:\n```json\n{"rows": [{"used_at": "2026-05-22", "place_text": "식당", "amount": "12,000",} {"used_at": "x", "place_text": "b", "amount": "1"}],}\n```'
    df = spark.createDataFrame([("d", answer), ("e", "nothing"), ("f", None)], "doc_id string, answer string")
    got = sourcing.payload_rows(df, F.lit("총무과")).collect()
    assert [(r.doc_id, r.amount, r.department_name) for r in got] == [("d", 12000, "총무과")]


def test_registry_totals_are_checked(spark):
    from tallyloom.operators import sourcing

    part = spark.createDataFrame([(1, '{"adapter":"adapter_required"}'), (2, '{"adapter":"city_portal","verifiedAt":"a","verifiedBy":"b"}')], "id int, source_pattern string")
    holds = spark.createDataFrame([(1, "legal_hold"), (2, "legal_hold")], "id int, hold string")
    assert {r.id: r.verification_status for r in sourcing.assembled([part], holds, 2).collect()} == {1: "legal_hold", 2: "verified_in_code"}
    with pytest.raises(Exception, match="expected 3 entries"):
        sourcing.assembled([part], holds, 3).collect()
    ids = {r.u for r in part.select(sourcing.stable_id(F.col("id").cast("string")).alias("u")).collect()}
    assert len(ids) == 2 and all(len(u) == 36 and u[14] == "5" for u in ids)
