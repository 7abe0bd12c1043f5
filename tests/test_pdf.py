"""The text layer of PDF files written here: runs, lines, gaps, guards, and rows of a printed table."""

from __future__ import annotations

import io
import zipfile
import zlib

import pytest

from tallyloom.operators.etl import grammar, grids, pdf

HEAD = "%PDF-1.5\n"


def written(objects: dict[int, bytes | tuple[str, bytes]], boxed: tuple[int, ...] = (), packed: bool = True) -> bytes:
    """Objects by number; streams are (entries, data); boxed ones go into an object stream."""
    out = HEAD.encode()

    def put(number: int, body: bytes | tuple[str, bytes]) -> None:
        nonlocal out
        if isinstance(body, tuple):
            data = zlib.compress(body[1]) if packed else body[1]
            body = f"<< {body[0]} /Length {len(data)} {'/Filter /FlateDecode' if packed else ''} >>\nstream\n".encode() + data + b"\nendstream"
        out += f"{number} 0 obj\n".encode() + body + b"\nendobj\n"

    for number, body in objects.items():
        if number not in boxed:
            put(number, body)
    if boxed:
        heads, bodies = "", b""
        for number in boxed:
            heads += f"{number} {len(bodies)} "
            bodies += objects[number] + b" "
        put(90, (f"/Type /ObjStm /N {len(boxed)} /First {len(heads)}", heads.encode() + bodies))
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def paper(pages: list[bytes], boxed: tuple[int, ...] = (), packed: bool = True, letters: str = "") -> bytes:
    """/F1: two-byte codes that a map turns into letters (each 1000 wide); /F2: plain letters, 500 wide."""
    codes = "".join(f"<{k + 1:04X}> <{c.encode('utf-16be').hex()}>\n" for k, c in enumerate(letters))
    cmap = f"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange {len(letters)} beginbfchar\n{codes}endbfchar 1 beginbfrange <0400> <0402> <0041> endbfrange endcmap"
    objects: dict = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: f"<< /Type /Pages /Kids [{' '.join(f'{10 + 2 * k} 0 R' for k in range(len(pages)))}] /Count {len(pages)} /Resources << /Font << /F1 3 0 R /F2 6 0 R >> >> >>".encode(),
        3: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>",
        4: b"<< /Type /Font /Subtype /CIDFontType2 /DW 1000 /W [1024 [600 600] 1026 1026 700] >>",
        5: ("", cmap.encode()),
        6: b"<< /Type /Font /Subtype /Type1 /BaseFont /Plain /FirstChar 32 /Widths [" + b" 500" * 200 + b"] >>",
    }
    for k, content in enumerate(pages):
        objects |= {10 + 2 * k: f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R >>".encode(), 11 + 2 * k: ("", content)}
    return written(objects, boxed, packed)


def coded(text: str, letters: str) -> str:
    return "<" + "".join(f"{letters.index(c) + 1:04X}" for c in text) + ">"


def table(rows: list[list[tuple[float, str]]], letters: str, size: int = 10) -> bytes:
    """Cells at places of their line; Hangul in /F1, the rest in /F2, one run each."""
    out = ["BT"]
    for k, cells in enumerate(rows):
        for x, text in cells:
            hangul = any(ord(c) > 255 for c in text)
            body = coded(text, letters) if hangul else "(" + text.replace("(", "\\(").replace(")", "\\)") + ")"
            out.append(f"/{'F1' if hangul else 'F2'} {size} Tf 1 0 0 1 {x} {800 - 14 * k} Tm {body} Tj")
    return "\n".join([*out, "ET"]).encode()


def read(content: bytes) -> list[list[tuple]]:
    file = pdf.File(content)
    return [list(pdf.page_runs(file, p, r)) for p, r in file.pages()]


@pytest.mark.parametrize("boxed", [(), (1, 2, 3, 4, 6)])
@pytest.mark.parametrize("packed", [True, False])
def test_runs(boxed, packed):
    letters = "가나 다"
    page = f"q 2 0 0 2 5 5 cm BT /F1 10 Tf 10 20 Td [{coded('가나', letters)} -500 {coded('다', letters)}] TJ ET Q BT /F2 8 Tf 12 TL 100 300 Td (a\\(b\\)\\101\\\nz) Tj T* (next) Tj 5 0 (last) \" ET BT /F1 6 Tf <040004010402> Tj ET".encode()
    first, second = read(paper([page, b"BT /F2 5 Tf (two) ' ET"], boxed, packed, letters))
    assert [(*(round(v, 9) for v in r[:4]), r[4]) for r in first] == [
        (25.0, 45.0, 40.0, 20.0, "가나"),
        (75.0, 45.0, 20.0, 20.0, "다"),
        (100.0, 300.0, 24.0, 8.0, "a(b)Az"),
        (100.0, 288.0, 16.0, 8.0, "next"),
        (100.0, 276.0, 16.0, 8.0, "last"),
        (0.0, 0.0, 11.4, 6.0, "ABC"),
    ]
    assert [r[4] for r in second] == ["two"]


def test_broken_files():
    for content, error in ((b"", "not_a_pdf"), (b"%PDF-1.4 /Encrypt 5 0 R", "encrypted"), (paper([b"BT Td ET"]), "broken_content"), (paper([b"BT (open Tj"]), "broken_string")):
        with pytest.raises(ValueError, match=error):
            read(content)
    assert read(b"%PDF-1.4 nothing") == []


LETTERS = "".join(dict.fromkeys("무릉군 업무추진비 집행내역 사용일자집행장소목적금액대상인원결제방법월별합계건수총카드현금봄나물식당산불예방홍보논의들꽃다방귀농인정착간담회지출 0"))
ROWS = [
    [(200, "무릉군 업무추진비 집행내역")],
    [(40, "2023-04-05"), (120, "12:30"), (170, "봄나물식당"), (260, "산불 예방 홍보 논의"), (400, "8"), (440, "91,000"), (500, "카드")],
    [(40, "2023-04-19"), (120, "18:05"), (170, "들꽃다방"), (260, "귀농인 정착 간담회"), (400, "11"), (440, "34,500"), (500, "현금")],
]


def test_lines_and_rows(spark):
    shuffled = [sorted(r, key=lambda c: c[1]) for r in ROWS[::-1]]
    upside = table(shuffled, LETTERS).replace(b"800 Tm", b"000 Tm")
    sums = [[(40, "업무추진비"), (120, "월별 합계"), (200, "금액")], [(40, "3"), (120, "12"), (200, "1,204,000")]]
    docs = [
        ("table", paper([table(ROWS[:2], LETTERS), table(ROWS[2:], LETTERS)], letters=LETTERS)),
        ("order", paper([upside], letters=LETTERS)),
        ("sums", paper([table(sums, LETTERS)], letters=LETTERS)),
        ("places", paper([table([[(40, "사용일자"), (120, "집행목적"), (220, "금액")], [(40, "2023")]], LETTERS)], letters=LETTERS)),
        ("none", paper([table([[(40, "총 0건")]], LETTERS)], letters=LETTERS)),
        ("scan", paper([b"q 600 0 0 800 0 0 cm /Im1 Do Q"])),
        ("bad", b"PK"),
        ("null", None),
    ]
    runs = pdf.document_runs(spark.createDataFrame([(i, c and bytearray(c)) for i, c in docs], "doc_id string, content binary")).persist()
    assert {r.doc_id: r.error for r in runs.where("error IS NOT NULL").collect()} == {"scan": "no_text", "bad": "not_a_pdf", "null": "not_a_pdf"}
    read = pdf.texts(runs).persist()
    text = {r.doc_id: r.text for r in read.collect()}
    gaps = lambda *cells: "".join(" " * n + c for n, c in cells)
    first = gaps((0, "2023-04-05"), (6, "12:30"), (5, "봄나물식당"), (8, "산불 예방 홍보 논의"), (6, "8"), (7, "91,000"), (6, "카드"))
    assert text["table"].splitlines()[:2] == [" " * 32 + "무릉군 업무추진비 집행내역", first]
    parsed = grammar.parse_texts(read)
    got = sorted((r.doc_id, r.day, r.clock, r.place, r.purpose, r.amount, r.party, r.method) for r in parsed.collect())
    want = [("2023-04-05", "12:30", "봄나물식당", "산불 예방 홍보 논의", "91,000", "8", "카드"), ("2023-04-19", "18:05", "들꽃다방", "귀농인 정착 간담회", "34,500", "11", "현금")]
    assert [g[1:] for g in got if g[0] == "table"] == want
    assert sorted(g[3] for g in got if g[0] == "order") == ["들꽃다방", "봄나물식당"]
    assert {r.doc_id: r.outcome for r in pdf.outcomes(read, parsed).collect()} == {"table": "rows", "order": "rows", "sums": "sums_only", "places": "no_places", "none": "none_spent"}
    runs.unpersist(), read.unpersist()


def test_members_of_archives(spark):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("b/report.PDF", paper([b"BT /F2 5 Tf (in a box) Tj ET"]))
        z.writestr("notes.txt", "no")
    docs = spark.createDataFrame([("z", "all.zip", bytearray(box.getvalue())), ("p", "one.pdf", bytearray(b"%PDF-")), ("x", "bad.zip", bytearray(b"PK"))], "doc_id string, name string, content binary")
    members = grids.members(docs)
    assert [(r.doc_id, r.member, r.error) for r in members.orderBy("doc_id").collect()] == [("x", "bad.zip", "File is not a zip file"), ("z", "b/report.PDF", None)]
    assert [r.text for r in pdf.texts(pdf.document_runs(members.where("error IS NULL"))).collect()] == ["in a box"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id string, content binary")
    assert pdf.texts(pdf.document_runs(empty)).collect() == []
