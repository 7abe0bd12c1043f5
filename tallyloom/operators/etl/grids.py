"""Documents to grids: HTML tables, XLSX, XLS, HWPX and ZIP archives, one row per (document, sheet, row); HWP to items.

Parsing bytes is the one step that needs Python; it runs per document in mapInArrow, whatever follows
is column expressions. Documents beyond a limit, and those that cannot be read, come back as rows
with an error instead of cells.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.etl.compound import DAY_FORMATS, MAGIC, hwp_texts, number_text, shows_day, xls_grids
from tallyloom.sources.tables import LIMITS

SCHEMA = "doc_id string, member string, sheet int, row_no int, cells array<string>, error string"
Grid = list[list[str]]


class _Tables(HTMLParser):
    """All tables of a page as grids; spans repeat their cell; a nested table is its own grid."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.grids: list[Grid] = []
        self._open: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self._open.append({"grid": [], "row": None, "cell": None, "span": 1, "down": {}})
        elif self._open:
            t = self._open[-1]
            if tag == "tr":
                self._end_row(t)
                t["row"] = []
            elif tag in ("td", "th"):
                self._end_cell(t)
                if t["row"] is None:
                    t["row"] = []
                a = dict(attrs)
                number = lambda k: max(1, int(a[k])) if str(a.get(k) or "").isdigit() else 1
                t["cell"], t["span"], t["rows"] = [], number("colspan"), number("rowspan")
            elif tag == "br" and t["cell"] is not None:
                t["cell"].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if not self._open:
            return
        t = self._open[-1]
        if tag in ("td", "th"):
            self._end_cell(t)
        elif tag == "tr":
            self._end_row(t)
        elif tag == "table":
            self._end_row(t)
            self._open.pop()
            self.grids.append(t["grid"])

    def handle_data(self, data: str) -> None:
        if self._open and self._open[-1]["cell"] is not None:
            self._open[-1]["cell"].append(data)

    def _end_cell(self, t: dict) -> None:
        if t["cell"] is None:
            return
        self._carried(t)
        text = " ".join("".join(t["cell"]).split())
        for _ in range(t["span"]):
            if t["rows"] > 1:
                t["down"][len(t["row"])] = (t["rows"] - 1, text)
            t["row"].append(text)
        t["cell"] = None

    def _carried(self, t: dict) -> None:
        """Cells that an earlier row lets reach down."""
        while (k := len(t["row"])) in t["down"]:
            left, text = t["down"].pop(k)
            if left > 1:
                t.setdefault("next", {})[k] = (left - 1, text)
            t["row"].append(text)

    def _end_row(self, t: dict) -> None:
        self._end_cell(t)
        if t["row"] is not None:
            self._carried(t)
            t["grid"].append(t["row"])
            t["down"] |= t.pop("next", {})
        t["row"] = None


def html_grids(source: str) -> list[Grid]:
    parser = _Tables()
    parser.feed(source)
    parser.close()
    for t in parser._open:
        parser._end_row(t)
        parser.grids.append(t["grid"])
    return parser.grids


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _day_styles(z: zipfile.ZipFile) -> set[int]:
    """The cell styles whose format shows a day or a time; none if the styles cannot be read."""
    try:
        root = ElementTree.fromstring(z.read("xl/styles.xml"))
    except (KeyError, ElementTree.ParseError):
        return set()
    codes = {int(e.get("numFmtId", 0)): shows_day(e.get("formatCode", "")) for e in root.iter() if _local(e.tag) == "numFmt"}
    styles = [e for group in root if _local(group.tag) == "cellXfs" for e in group]
    numbers = [int(e.get("numFmtId", 0)) for e in styles]
    return {k for k, n in enumerate(numbers) if codes.get(n, n in DAY_FORMATS)}


def _from_1904(z: zipfile.ZipFile) -> bool:
    try:
        root = ElementTree.fromstring(z.read("xl/workbook.xml"))
    except (KeyError, ElementTree.ParseError):
        return False
    return any(e.get("date1904") in ("1", "true") for e in root.iter() if _local(e.tag) == "workbookPr")


def xlsx_grids(content: bytes) -> list[Grid]:
    """Values of all sheets. Of the styles only the kinds of numbers are read, so broken ones lose days but no cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(e.text or "" for e in item.iter() if _local(e.tag) == "t"))
        day_styles, from_1904 = _day_styles(z), _from_1904(z)
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        out = []
        for name in sheets:
            grid: Grid = []
            for row in (e for e in ElementTree.fromstring(z.read(name)).iter() if _local(e.tag) == "row"):
                cells: list[str] = []
                for c in (e for e in row if _local(e.tag) == "c"):
                    at = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells))
                    value = next((e.text or "" for e in c if _local(e.tag) == "v"), "")
                    if c.get("t") == "s" and value:
                        value = shared[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = "".join(e.text or "" for e in c.iter() if _local(e.tag) == "t")
                    elif value and c.get("t", "n") == "n":
                        value = number_text(float(value), int(c.get("s", 0)) in day_styles, from_1904)
                    cells.append(value)
                grid.append(cells)
            out.append(grid)
        return out


def hwpx_grids(content: bytes) -> list[Grid]:
    """Tables of a zipped XML word-processor document; column spans repeat their cell."""
    out: list[Grid] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)):
            for table in (e for e in ElementTree.fromstring(z.read(name)).iter() if _local(e.tag) == "tbl"):
                grid: Grid = []
                for row in (e for e in table if _local(e.tag) == "tr"):
                    cells: list[str] = []
                    for cell in (e for e in row if _local(e.tag) == "tc"):
                        text = " ".join("".join(e.text or "" for e in cell.iter() if _local(e.tag) == "t").split())
                        span = next((int(e.get("colSpan", 1)) for e in cell.iter() if _local(e.tag) == "cellSpan"), 1)
                        cells += [text] * max(1, span)
                    grid.append(cells)
                out.append(grid)
    return out


#: What reading broken bytes raises.
READ_ERRORS = (ValueError, IndexError, KeyError, struct.error, zipfile.BadZipFile, ElementTree.ParseError)

#: Members of an archive are read in this order of kind, then by name.
ARCHIVE_ORDER = ("xlsx", "xls", "hwpx", "hwp", "html", "htm")


def kind_of(name: str, content: bytes) -> str:
    """By extension, but a workbook that holds HTML is HTML."""
    kind = name.lower().rsplit(".", 1)[-1] if "." in name else ""
    head = content[:512].lstrip().lower()
    if kind in ("xls", "xlsx", "html", "htm", "") and head[:1] == b"<":
        return "html"
    return kind


def grids(name: str, content: bytes) -> Iterator[tuple[str, int, Grid]]:
    """(member, sheet, grid); ValueError for what cannot be read."""
    if len(content) > LIMITS["bytes"]:
        raise ValueError("too_large")
    kind = kind_of(name, content)
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            members = [i for i in z.infolist() if not i.is_dir() and i.filename.lower().rsplit(".", 1)[-1] in ARCHIVE_ORDER]
            members.sort(key=lambda i: (ARCHIVE_ORDER.index(i.filename.lower().rsplit(".", 1)[-1]), i.filename))
            found, first_error = False, None
            for i in members:
                try:
                    if i.file_size > LIMITS["bytes"]:
                        raise ValueError("too_large")
                    for _, sheet, grid in grids(i.filename, z.read(i)):
                        found = True
                        yield i.filename, sheet, grid
                except READ_ERRORS as e:
                    first_error = first_error or e
            if first_error and not found:  # an error counts only if nothing could be read
                raise ValueError(str(first_error))
        return
    if kind == "hwp":  # no grid but a stream of items, one to a row (see records.py)
        yield name, -1, [[item] for item in hwp_texts(content)]
        return
    if kind in ("html", "htm"):
        made = html_grids(content.decode("utf-8", "replace"))
    elif kind in ("xlsx", "xls"):
        made = xls_grids(content) if content.startswith(MAGIC) else xlsx_grids(content)
    elif kind == "hwpx":
        made = hwpx_grids(content)
    else:
        raise ValueError(f"unsupported:{kind or 'unknown'}")
    for sheet, grid in enumerate(made if kind in ("html", "htm") else made[: LIMITS["sheets"]]):  # of a workbook the first sheets are read
        if len(grid) > LIMITS["rows"] or any(len(r) > LIMITS["columns"] for r in grid) or sum(map(len, grid)) > LIMITS["cells"]:
            raise ValueError("too_many_cells")
        yield name, sheet, grid


def document_rows(documents: DataFrame, id_col: str = "doc_id", name_col: str = "name", content_col: str = "content") -> DataFrame:
    """See SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, name, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                try:
                    for member, sheet, grid in grids(name or "", content or b""):
                        rows += [(i, member, sheet, n, cells, None) for n, cells in enumerate(grid)]
                except READ_ERRORS as e:
                    rows.append((i, name, None, None, None, str(e)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "member", "sheet", "row_no", "cells", "error"])

    return documents.selectExpr(f"cast({id_col} as string)", f"cast({name_col} as string)", f"cast({content_col} as binary)").mapInArrow(run, SCHEMA)


def members(documents: DataFrame, kind: str = "pdf", id_col: str = "doc_id", name_col: str = "name", content_col: str = "content") -> DataFrame:
    """(doc_id, member, content, error): the members of archives whose names end in a kind, such as files that other readers take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows: list[tuple] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        for m in sorted((m for m in z.infolist() if m.filename.lower().endswith("." + kind)), key=lambda m: m.filename):
                            big = m.file_size > LIMITS["bytes"]
                            rows.append((i, m.filename, None if big else z.read(m), "too_large" if big else None))
                except READ_ERRORS as e:
                    rows = [(i, name, None, str(e))]
                for row in rows:  # one at a time, as members can be large
                    yield pa.record_batch([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.string(), pa.binary(), pa.string()))], names=["doc_id", "member", "content", "error"])

    archives = documents.where(F.lower(F.col(name_col)).endswith(".zip"))
    return archives.selectExpr(f"cast({id_col} as string)", f"cast({name_col} as string)", f"cast({content_col} as binary)").mapInArrow(run, "doc_id string, member string, content binary, error string")
