"""The text layer of PDF files: positioned runs of text from bytes, then lines, gaps and guards in column expressions.

Reading bytes gives, per page, runs of text with their place and width; that is all that needs Python. Runs whose
baselines meet form a line; a gap between two runs becomes one blank, or as many as it is wide, so that the columns
of a printed table stay apart. Scanned pages have no text layer: their documents come back as such, for OCR outside.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.tables import LIMITS

RUNS = "doc_id string, page int, no int, x double, y double, width double, size double, text string, error string"
_SPACE = b" \t\r\n\f\0"
_TOKEN = re.compile(rb"[ \t\r\n\f\0]*(?:%[^\r\n]*[ \t\r\n\f\0]*)*(<<|>>|\[|\]|\(|<|/[^ \t\r\n\f\0()<>\[\]{}/%]*|[^ \t\r\n\f\0()<>\[\]{}/%]+|[{})>])")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_END = object()


class Ref(int):
    """The number of another object."""


class Tokens:
    """Values and operators of a piece of PDF syntax: names begin with a slash, strings are bytes, operators str."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _string(self) -> bytes:
        out, depth, data, k = bytearray(), 1, self.data, self.at
        while k < len(data):
            c = data[k : k + 1]
            if c == b"\\":
                k += 1
                octal = re.match(rb"[0-7]{1,3}", data[k : k + 3])
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    k += len(octal[0])
                    continue
                c = data[k : k + 1]
                if c not in (b"\r", b"\n"):
                    out += _ESCAPES.get(c, c)
                elif data[k : k + 2] == b"\r\n":
                    k += 1
            elif c == b"(":
                depth += 1
                out += c
            elif c == b")":
                depth -= 1
                if not depth:
                    self.at = k + 1
                    return bytes(out)
                out += c
            else:
                out += c
            k += 1
        raise ValueError("broken_string")

    def next(self):
        m = _TOKEN.match(self.data, self.at)
        if not m:
            return _END
        token, self.at = m[1], m.end()
        if token == b"(":
            return self._string()
        if token == b"<":
            end = self.data.find(b">", self.at)
            if end < 0:
                raise ValueError("broken_string")
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if token == b"[":
            out = []
            while (v := self.next()) is not _END and v != "]":
                if v == "R" and len(out) > 1:
                    out[-2:] = [Ref(out[-2])]
                else:
                    out.append(v)
            return out
        if token == b"<<":
            flat = []
            while (v := self.next()) is not _END and v != ">>":
                if v == "R" and len(flat) > 1:
                    flat[-2:] = [Ref(flat[-2])]
                else:
                    flat.append(v)
            return dict(zip(flat[::2], flat[1::2]))
        text = token.decode("latin-1")
        if re.fullmatch(r"[+-]?\d+", text):
            return int(text)
        return float(text) if re.fullmatch(r"[+-]?\d*\.\d*", text) and len(text) > 1 else text


class File:
    """Objects by number, wherever they stand; the last of a number counts."""

    def __init__(self, content: bytes):
        if b"%PDF-" not in content[:1024]:
            raise ValueError("not_a_pdf")
        if re.search(rb"/Encrypt\b", content):
            raise ValueError("encrypted")
        self._content = content
        self._at = {int(m[1]): m.end() for m in re.finditer(rb"(?<![0-9])(\d{1,10})\s+\d{1,5}\s+obj\b", content)}
        self._known: dict[int, object] = {}
        for n in [n for n, at in self._at.items() if b"/ObjStm" in content[at : at + 400]]:
            box = self.get(Ref(n))
            if isinstance(box, tuple) and box[0].get("/Type") == "/ObjStm":
                raw = self.stream(box)
                head = Tokens(raw)
                pairs = [(head.next(), head.next()) for _ in range(int(self.get(box[0]["/N"])))]
                for number, offset in pairs:
                    if number not in self._at:
                        self._known[number] = Tokens(raw, int(self.get(box[0]["/First"])) + offset).next()

    def get(self, value):
        """A value, or what it refers to; streams are (dictionary, bytes)."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self._known[value] if value in self._known else self._read(int(value))
        raise ValueError("broken_reference")

    def _read(self, number: int):
        if number not in self._at:
            return None
        tokens = Tokens(self._content, self._at[number])
        value = tokens.next()
        follows = re.compile(rb"\s*stream\r?\n").match(self._content, tokens.at)
        if isinstance(value, dict) and follows:
            size = self.get(value.get("/Length"))
            raw = self._content[follows.end() : follows.end() + size] if isinstance(size, int) else b""
            if not re.compile(rb"\s*endstream").match(self._content, follows.end() + len(raw)):
                raw = self._content[follows.end() : max(follows.end(), self._content.find(b"endstream", follows.end()))]
            value = (value, raw)
        self._known[number] = value
        return value

    def stream(self, value) -> bytes:
        found = self.get(value)
        if not isinstance(found, tuple):
            return b""
        filters = self.get(found[0].get("/Filter")) or []
        raw = found[1]
        for f in filters if isinstance(filters, list) else [filters]:
            if f not in ("/FlateDecode", "/Fl"):
                raise ValueError(f"filter:{f}")
            raw = zlib.decompressobj().decompress(raw, LIMITS["bytes"])
        return raw

    def pages(self) -> Iterator[tuple[dict, dict]]:
        """(page, its resources), in order."""
        root = next((o for n in self._at | self._known if isinstance(o := self.get(Ref(n)), dict) and o.get("/Type") == "/Catalog"), None)
        todo, seen = [(root.get("/Pages"), {})] if root else [], set()
        while todo:
            ref, above = todo.pop()
            if isinstance(ref, Ref):
                if ref in seen:
                    raise ValueError("broken_pages")
                seen.add(ref)
            node = self.get(ref)
            if not isinstance(node, dict):
                continue
            own = self.get(node.get("/Resources")) or above
            if "/Kids" in node:
                todo += [(k, own) for k in reversed(self.get(node["/Kids"]) or [])]
            else:
                yield node, own


class Font:
    """Codes to text and widths (in thousandths)."""

    def __init__(self, file: File, font: dict):
        self.double = font.get("/Subtype") == "/Type0"
        self.text: dict[int, str] = {}
        self.readable = not self.double
        self.widths: dict[int, float] = {}
        self.width = 500.0
        if "/ToUnicode" in font:
            self.readable = True
            self._mapped(file.stream(font["/ToUnicode"]))
        if self.double:
            inner = file.get((file.get(font.get("/DescendantFonts")) or [{}])[0]) or {}
            self.width = float(file.get(inner.get("/DW", 1000)))
            wide = list(file.get(inner.get("/W")) or [])
            while len(wide) >= 2:
                first, second = wide.pop(0), file.get(wide.pop(0))
                if isinstance(second, list):
                    self.widths |= {first + k: file.get(w) for k, w in enumerate(second)}
                elif wide:
                    w = file.get(wide.pop(0))
                    self.widths |= {c: w for c in range(first, min(second, first + 65_535) + 1)}
        else:
            first = file.get(font.get("/FirstChar", 0))
            self.widths = {first + k: file.get(w) for k, w in enumerate(file.get(font.get("/Widths")) or [])}

    def _mapped(self, cmap: bytes) -> None:
        tokens, held = Tokens(cmap), []
        plain = lambda b: b.decode("utf-16be", "replace")
        number = lambda b: int.from_bytes(b, "big")
        while (v := tokens.next()) is not _END:
            if v == "endbfchar":
                self.text |= {number(a): plain(b) for a, b in zip(held[::2], held[1::2])}
            elif v == "endbfrange":
                for a, b, to in zip(held[::3], held[1::3], held[2::3]):
                    for k, code in enumerate(range(number(a), min(number(b), number(a) + 65_535) + 1)):
                        self.text[code] = plain(to[k]) if isinstance(to, list) else plain((number(to) + k).to_bytes(len(to), "big"))
            if isinstance(v, (bytes, list)):
                held.append(v)
            else:
                held = []

    def decoded(self, raw: bytes) -> tuple[str, float, int, int]:
        """Text, width of all codes, number of codes, and of blanks among them."""
        codes = [int.from_bytes(raw[k : k + 2], "big") for k in range(0, len(raw) - 1, 2)] if self.double else list(raw)
        text = "".join(self.text.get(c, "" if self.double else bytes([c]).decode("cp1252", "replace")) for c in codes)
        return text, sum(self.widths.get(c, self.width) for c in codes), len(codes), codes.count(32)


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def page_runs(file: File, page: dict, resources: dict) -> Iterator[tuple[float, float, float, float, str]]:
    """(x, y, width, size, text) in the order of the page's operators."""
    contents = file.get(page.get("/Contents")) or []
    data = b"\n".join(file.stream(c) for c in (contents if isinstance(contents, list) else [page["/Contents"]]))
    fonts = {name: Font(file, file.get(f)) for name, f in (file.get(resources.get("/Font")) or {}).items() if isinstance(file.get(f), dict)}
    one = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    ctm, kept, tm, line, font = one, [], one, one, None
    size, leading, spacing, word, scale, rise = 1.0, 0.0, 0.0, 0.0, 1.0, 0.0
    tokens, held = Tokens(data), []

    def show(raw: bytes):
        nonlocal tm
        text, units, codes, blanks = font.decoded(raw)
        advance = (units / 1000 * size + codes * spacing + blanks * word) * scale
        at = _times((1, 0, 0, 1, 0, rise), _times(tm, ctm))
        end = _times((1, 0, 0, 1, advance, rise), _times(tm, ctm))
        tm = _times((1, 0, 0, 1, advance, 0), tm)
        height = size * (at[2] ** 2 + at[3] ** 2) ** 0.5
        if text.strip() and font.readable:
            yield at[4], at[5], max(0.0, end[4] - at[4]), height, text

    while (v := tokens.next()) is not _END:
        if not isinstance(v, str) or v.startswith("/"):
            held.append(v)
            continue
        n, held = held, []
        try:
            if v == "q":
                kept.append(ctm)
            elif v == "Q" and kept:
                ctm = kept.pop()
            elif v == "cm":
                ctm = _times(tuple(n[-6:]), ctm)
            elif v == "BT":
                tm = line = one
            elif v == "Tf":
                font, size = fonts.get(n[-2]), n[-1]
            elif v in ("Td", "TD"):
                leading = -n[-1] if v == "TD" else leading
                tm = line = _times((1, 0, 0, 1, n[-2], n[-1]), line)
            elif v == "Tm":
                tm = line = tuple(n[-6:])
            elif v in ("TL", "Tc", "Tw", "Tz", "Ts"):
                leading, spacing, word, scale, rise = (n[-1] if v == "TL" else leading, n[-1] if v == "Tc" else spacing, n[-1] if v == "Tw" else word, n[-1] / 100 if v == "Tz" else scale, n[-1] if v == "Ts" else rise)
            elif v in ("T*", "'", '"'):
                if v == '"':
                    word, spacing = n[-3], n[-2]
                tm = line = _times((1, 0, 0, 1, 0, -leading), line)
            if v in ("Tj", "'", '"') and font:
                yield from show(n[-1])
            elif v == "TJ" and font:
                for piece in n[-1]:
                    if isinstance(piece, bytes):
                        yield from show(piece)
                    else:
                        tm = _times((1, 0, 0, 1, -piece / 1000 * size * scale, 0), tm)
            elif v == "BI":  # an inline picture
                tokens.at = max(tokens.at, data.find(b"EI", tokens.at) + 2)
        except (IndexError, TypeError) as e:  # an operator without its operands
            raise ValueError("broken_content") from e


def document_runs(documents: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """See RUNS; a document that cannot be read is one row with an error, one without text on its pages a row "no_text"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RUNS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.string(), pa.string()]
        for batch in batches:
            for i, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, error = [], None
                try:
                    if len(content or b"") > LIMITS["bytes"]:
                        raise ValueError("too_large")
                    file = File(content or b"")
                    for k, (page, resources) in enumerate(file.pages()):
                        rows += [(i, k, no, *r, None) for no, r in enumerate(page_runs(file, page, resources))]
                    error = None if rows else "no_text"
                except (ValueError, KeyError, IndexError, TypeError, AttributeError, zlib.error, RecursionError) as e:
                    error = str(e) if isinstance(e, ValueError) else "broken"
                if error:
                    rows = [(i, *[None] * 7, error)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return documents.selectExpr(f"cast({id_col} as string)", f"cast({content_col} as binary)").mapInArrow(run, RUNS)


def texts(runs: DataFrame) -> DataFrame:
    """(doc_id, text): pages in order, lines from top to bottom, gaps as blanks of half a letter's height."""
    by_page = Window.partitionBy("doc_id", "page").orderBy(F.desc("y"), "x", "no")
    sound = runs.where(F.col("error").isNull())
    falls = F.coalesce(F.lag("y").over(by_page) - F.col("y") > 0.4 * F.col("size"), F.lit(True))
    lined = sound.withColumn("falls", falls).withColumn("line", F.sum(F.col("falls").cast("int")).over(by_page.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.min("x").over(Window.partitionBy("doc_id"))
    lined = lined.withColumn("left", left)
    run = F.struct("x", "no", "width", "size", "text", "left")
    lines = lined.groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(run)).alias("runs"))

    def put(acc: Column, r: Column) -> Column:
        gap = r["x"] - acc["upto"]
        wide = F.greatest(F.round(gap / (r["size"] / 2)), F.lit(2))
        blanks = F.when(acc["text"] == "", F.round((r["x"] - r["left"]) / (r["size"] / 2))).when(gap > r["size"], wide).when(gap > 0.15 * r["size"], 1).otherwise(0)
        return F.struct(F.concat(acc["text"], F.repeat(F.lit(" "), blanks.cast("int")), r["text"]).alias("text"), (r["x"] + r["width"]).alias("upto"))

    text = F.aggregate("runs", F.struct(F.lit("").alias("text"), F.lit(0.0).alias("upto")), put, lambda acc: acc["text"])
    whole = lines.select("doc_id", "page", "line", text.alias("text")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "line", "text"))).alias("lines"))
    return whole.select("doc_id", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))


# ---- what a text is good for ----------------------------------------------------------------------

#: Heads that tell what a table of expenses has.
PURPOSE_HEADS = ("집행목적", "사용목적", "집행내용", "사용내역")
AMOUNT_HEADS = ("집행금액", "사용금액", "금액", "지출액")
PLACE_HEADS = ("집행장소", "사용장소", "가맹점", "상호", "집행처", "사용처", "장소")
SUM_PLACE_HEADS = ("집행장소", "사용장소", "가맹점", "상호", "집행처", "장소")
SUM_AMOUNTS = ("금액", "집행액", "사용액")
SUM_CONTEXT = ("업무추진비", "기관장", "이사장")
SUM_AXES = ("월별", "구분별", "유형별", "분기별", "건수", "합계", "총계", "집행내역")
NO_EXPENSES = "총 0건"


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike("|".join(words))


def lacks_place_column(text: Column) -> Column:
    """A table of expenses that names purposes and amounts, but no places."""
    c = F.regexp_replace(text, r"\s+", "")
    return F.coalesce(_any(c, PURPOSE_HEADS) & _any(c, AMOUNT_HEADS) & ~_any(c, PLACE_HEADS), F.lit(False))


def aggregate_only(text: Column) -> Column:
    """Sums by month, kind or quarter, without places."""
    c = F.regexp_replace(text, r"\s+", "")
    return F.coalesce(~_any(c, SUM_PLACE_HEADS) & _any(c, SUM_CONTEXT) & _any(c, SUM_AMOUNTS) & _any(c, SUM_AXES), F.lit(False))


def outcomes(read: DataFrame, parsed: DataFrame) -> DataFrame:
    """(doc_id, outcome) of texts and their parsed rows: rows, none_spent, sums_only, no_places, or ocr where the text layer says too little."""
    with_rows = parsed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    t = F.col("text")
    told = F.when(F.col("n") > 0, "rows").when(t.contains(NO_EXPENSES), "none_spent").when(aggregate_only(t), "sums_only").when(lacks_place_column(t), "no_places").otherwise("ocr")
    return read.join(with_rows, "doc_id", "left").select("doc_id", told.alias("outcome"))
