"""Binary workbooks and word-processor files: cells and items equal what the writers put in; broken files are told apart."""

from __future__ import annotations

import datetime
import io
import random
import struct
import zipfile

import pytest

from tallyloom.operators.etl import compound, grids, records, rows
from tests import binary_files as make
from tests.test_etl import xlsx

HEAD = ["집행일자", "집행장소", "집행목적", "인원", "금액(원)"]


def test_streams_of_all_sizes():
    r = random.Random(1)
    streams = {f"box/s{n}": r.randbytes(n) for n in (0, 1, 63, 64, 65, 4095, 4096, 4097, 70_000)} | {"top": b"short"}
    box = compound.CompoundFile(make.compound(streams))
    assert {n: box.read(n) for n in box.streams} == streams


def test_broken_chains_are_errors():
    whole = bytearray(make.compound({"a": b"x" * 5000}))
    table = (struct.unpack_from("<I", whole, 76)[0] + 1) * 512
    struct.pack_into("<I", whole, table, 0)  # the first sector links to itself
    with pytest.raises(ValueError, match="broken_chain"):
        compound.CompoundFile(bytes(whole)).read("a")
    with pytest.raises(ValueError):
        compound.CompoundFile(bytes(make.compound({"a": b"x" * 5000}))[:1500]).read("a")
    for content in (b"", compound.MAGIC, compound.MAGIC + bytes(600)):
        with pytest.raises(ValueError):
            compound.CompoundFile(content)


@pytest.mark.parametrize("shared", [True, False])
@pytest.mark.parametrize("cut", [15, 41, 8000])
def test_workbook_cells(shared, cut):
    cells = [["제목 é", None, "plain"], [], [12, 12.5, -3], [True, ("rk", 7 << 2 | 2), ("rk", 1234 << 2 | 3)], [("mulrk", [1 << 2 | 2, 2 << 2 | 2]), None, "끝" * 30], [("formula", 8.25), ("formula", "식"), ("day", 46164)]]
    want = [["제목 é", "", "plain"], [], ["12", "12.5", "-3"], ["1", "7", "12.34"], ["1", "2", "끝" * 30], ["8.25", "식", "2026-05-22 00:00:00"]]
    assert compound.xls_grids(make.xls([cells, [["둘"]], []], shared, cut)) == [want, [["둘"]], []]


def test_numbers_of_days():
    assert compound.number_text(46164.5, day=True) == "2026-05-22 12:00:00"
    assert compound.number_text(0.520833333, day=True) == "12:30:00"
    assert compound.number_text(59, day=True) == "1900-02-28 00:00:00" and compound.number_text(61, day=True) == "1900-03-01 00:00:00"
    assert compound.number_text(0.0, day=True, from_1904=True) == "00:00:00" and compound.number_text(1.0, day=True, from_1904=True) == "1904-01-02 00:00:00"
    assert compound.number_text(1e20) == "100000000000000000000" and compound.number_text(-0.5) == "-0.5"
    assert [compound.shows_day(c) for c in ("yyyy/m/d", '0.00"day"', "#,##0_);[Red](#,##0)", "h:mm", "General", "@", "[$-412]aaa d")] == [True, False, False, True, False, False, True]


def test_same_grid_as_the_zipped_twin():
    """A day is a number with a style in both."""
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("xl/styles.xml", '<styleSheet xmlns="urn:x"><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="urn:x"><sheetData><row r="1"><c r="A1" s="1"><v>46164</v></c><c r="B1"><v>77400.0</v></c><c r="C1" t="inlineStr"><is><t>한식당</t></is></c></row></sheetData></worksheet>')
    assert grids.xlsx_grids(box.getvalue()) == compound.xls_grids(make.xls([[[("day", 46164), 77400, "한식당"]]])) == [[["2026-05-22 00:00:00", "77400", "한식당"]]]


def test_paragraphs():
    long = "긴 문단 " * 900
    for packed in (True, False):
        assert compound.hwp_texts(make.hwp([["표\x0b 안", "", "a\x09b", long], ["둘째"]], packed)) == ["표 안", "a b", long.strip(), "둘째"]
    assert compound.hwp_texts(make.hwp([[]], preview="<연번><사용자>\r\n<1>< 시장 >")) == ["연번", "사용자", "1", "시장"]
    many = [[f"절 {k}"] for k in range(12)]  # Section10 comes after Section9
    assert compound.hwp_texts(make.hwp(many)) == [f"절 {k}" for k in range(12)]


ITEMS = ["군수 업무추진비 ('25. 11월)", "연번", "사용자", "사용일자", "사용장소", "금액(원)", "1", "군수", "11", "3", "주식회사", "들풀상회", "방문객 다과 구입", "41,300", "카드", "기관", "09:40", "2", "부군수", "2025-11-05", "바다식당", "어업 현안", "협의 오찬", "3인 기준", "63,000", "과장 등 7명", "제로페이", "시책", "12:20", "3", "군수", "13", "40", "없는날", "회의", "9,000", "카드", "4", "군수", "11", "9", "물품점", "현수막", "15,000"]


def test_items_to_rows(spark):
    docs = [
        ("w", "a.hwp", bytearray(make.hwp([ITEMS[:20], ITEMS[20:]]))),
        ("again", "b.hwp", bytearray(make.hwp([ITEMS + ITEMS[6:17]]))),
        ("none", "c.hwp", bytearray(make.hwp([["안내문", "1", "2"]]))),
        ("broken", "d.hwp", bytearray(b"\xd0\xcf\x11\xe0")),
        ("book", "e.xls", bytearray(make.xls([[HEAD, [("day", 46164), "한식당", "업무 협의", 4, 77400]]]))),
    ]
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        for _, name, content in docs:
            z.writestr(name, bytes(content))
        z.writestr("0.xlsx", xlsx([HEAD, ["2026-05-23", "국밥집", "회의", "3명", "30,000"]]))
    grid = grids.document_rows(spark.createDataFrame([*docs, ("zip", "all.zip", bytearray(box.getvalue()))], "doc_id string, name string, content binary")).persist()
    assert [(r.doc_id, r.error) for r in grid.where("error IS NOT NULL").collect()] == [("broken", "not_a_compound_file")]
    got = records.expense_rows(records.items(grid)).collect()
    fields = lambda r: (r.used_at, r.place_text, r.purpose, r.amount, r.user_text, r.party_cells, r.payment_method, r.expense_category)
    day = lambda d, h, m: datetime.datetime(2025, 11, d, h, m)
    want = [
        (day(3, 9, 40), "주식회사 들풀상회", "방문객 다과 구입", 41300, "군수", None, "카드", "기관"),
        (day(5, 12, 20), "바다식당", "어업 현안 협의 오찬 3인 기준", 63000, "부군수", 7, "제로페이", "시책"),
        (day(9, 0, 0), "물품점", "현수막", 15000, "군수", None, None, None),
    ]
    for doc in ("w", "again"):
        assert sorted(fields(r) for r in got if r.doc_id == doc) == want
    assert not [r for r in got if r.doc_id == "none"]
    assert {r.member for r in got if r.doc_id == "zip"} == {"a.hwp"}  # b.hwp's rows repeat them
    sheets = rows.expense_rows(grid).collect()
    assert sorted((r.doc_id, r.member, r.place_text, r.amount, r.used_at) for r in sheets) == [
        ("book", "e.xls", "한식당", 77400, datetime.datetime(2026, 5, 22)),
        ("zip", "0.xlsx", "국밥집", 30000, datetime.datetime(2026, 5, 23)),
        ("zip", "e.xls", "한식당", 77400, datetime.datetime(2026, 5, 22)),
    ]
    grid.unpersist()


def test_a_row_needs_a_year_for_month_and_day(spark):
    untitled = ITEMS[1:17]
    df = spark.createDataFrame([("d", "m", untitled, None), ("e", "m", untitled, "2025년 11월 내역")], "doc_id string, member string, items array<string>, title string")
    assert [r.doc_id for r in records.expense_rows(df, title="title").collect()] == ["e"]
    assert records.expense_rows(df.where("false")).collect() == []
