"""Binary office files, read inside a task: compound files, the workbook streams of XLS and the text records of HWP.

A compound file is a small file system of 512-byte (or larger) sectors linked by an allocation table; short streams lie in
64-byte sectors inside the root's own stream. A chain that leaves the file, or meets a sector twice, is an error.
"""

from __future__ import annotations

import datetime
import re
import struct
import zlib

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_FREE = 0xFFFFFFFA  # numbers from here on are marks, not sectors


class CompoundFile:
    """Streams by path, parts joined by slashes."""

    def __init__(self, content: bytes):
        if not content.startswith(MAGIC) or len(content) < 512:
            raise ValueError("not_a_compound_file")
        self._content = content
        shift, self._small_shift = struct.unpack_from("<HH", content, 30)
        first_directory, _, cutoff, first_small, _, first_more = struct.unpack_from("<6I", content, 48)
        if not 7 <= shift <= 20 or not 2 <= self._small_shift <= shift:
            raise ValueError("broken_header")
        self._size, self._cutoff = 1 << shift, cutoff
        sectors = list(struct.unpack_from("<109I", content, 76))
        seen: set[int] = set()
        while first_more < _FREE:  # further numbers of allocation sectors, the last one links on
            if first_more in seen:
                raise ValueError("broken_chain")
            seen.add(first_more)
            *more, first_more = self._numbers(self._sector(first_more))
            sectors += more
        self._table = [n for s in sectors if s < _FREE for n in self._numbers(self._sector(s))]
        directory = self._chain(first_directory)
        small_table = [n for n in self._numbers(self._chain(first_small))] if first_small < _FREE else []
        entries = [directory[k : k + 128] for k in range(0, len(directory) - 127, 128)]
        if not entries:
            raise ValueError("no_directory")
        self._small_table = small_table
        self._small = self._chain(struct.unpack_from("<I", entries[0], 116)[0])
        self.streams: dict[str, tuple[int, int]] = {}
        todo, met = [(struct.unpack_from("<I", entries[0], 76)[0], "")], set()
        while todo:
            k, above = todo.pop()
            if k >= len(entries):
                continue
            if k in met:
                raise ValueError("broken_directory")
            met.add(k)
            e = entries[k]
            name = e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16le", "replace")
            left, right, child = struct.unpack_from("<3I", e, 68)
            start, size = struct.unpack_from("<IQ", e, 116)
            if e[66] == 2:
                self.streams[above + name] = (start, size & 0xFFFFFFFF if shift == 9 else size)
            todo += [(left, above), (right, above), (child, above + name + "/")]

    @staticmethod
    def _numbers(raw: bytes) -> tuple[int, ...]:
        return struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])

    def _sector(self, n: int) -> bytes:
        raw = self._content[(n + 1) * self._size : (n + 2) * self._size]
        if not raw:
            raise ValueError("broken_chain")
        return raw

    def _chain(self, start: int, small: bool = False) -> bytes:
        table, size = (self._small_table, 1 << self._small_shift) if small else (self._table, self._size)
        out, seen = [], set()
        while start < _FREE:
            if start in seen or start >= len(table):
                raise ValueError("broken_chain")
            seen.add(start)
            out.append(self._small[start * size : (start + 1) * size] if small else self._sector(start))
            start = table[start]
        return b"".join(out)

    def read(self, path: str) -> bytes:
        start, size = self.streams[path]
        raw = self._chain(start, small=size < self._cutoff) if size else b""
        if len(raw) < size:
            raise ValueError("broken_chain")
        return raw[:size]


# ---- text records of a word processor -------------------------------------------------------------

PARAGRAPH_TEXT = 67
#: Control characters that take eight code units, with their data; fixed values.
WIDE_CONTROLS = frozenset([*range(1, 10), 11, 12, *range(14, 24)])


def records(raw: bytes):
    """(tag, payload): ten bits of tag, ten of level, twelve of size (all ones: the size follows). A cut-off record ends them."""
    at = 0
    while at + 4 <= len(raw):
        head = struct.unpack_from("<I", raw, at)[0]
        at, size = at + 4, head >> 20
        if size == 0xFFF:
            if at + 4 > len(raw):
                return
            size, at = struct.unpack_from("<I", raw, at)[0], at + 4
        if at + size > len(raw):
            return
        yield head & 0x3FF, raw[at : at + size]
        at += size


def paragraph(payload: bytes) -> str:
    """A paragraph's text: controls are blanks, with the data that they carry."""
    units, out, at = struct.unpack(f"<{len(payload) // 2}H", payload[: len(payload) // 2 * 2]), [], 0
    while at < len(units):
        if units[at] < 32:
            out.append(32)
            at += 8 if units[at] in WIDE_CONTROLS else 1
        else:
            out.append(units[at])
            at += 1
    text = struct.pack(f"<{len(out)}H", *out).decode("utf-16le", "ignore")
    return " ".join("".join(c if c.isprintable() else " " for c in text).split())


def hwp_texts(content: bytes) -> list[str]:
    """The paragraphs that hold text, sections in order; without any, the cells of the preview."""
    box = CompoundFile(content)
    head = box.read("FileHeader") if "FileHeader" in box.streams else b""
    if not head.startswith(b"HWP Document File"):
        raise ValueError("not_a_word_processor_file")
    packed = len(head) >= 40 and struct.unpack_from("<I", head, 36)[0] & 1
    names = [n for n in box.streams if re.fullmatch(r"BodyText/Section\d+", n)]
    out = []
    for name in sorted(names, key=lambda n: int(n[16:])):
        raw = box.read(name)
        if packed:
            try:
                raw = zlib.decompressobj(-15).decompress(raw)
            except zlib.error as e:
                raise ValueError("broken_section") from e
        out += [t for tag, payload in records(raw) if tag == PARAGRAPH_TEXT if (t := paragraph(payload))]
    if not out and "PrvText" in box.streams:
        out = [t for cell in re.findall(r"<([^<>]{1,300})>", box.read("PrvText").decode("utf-16le", "ignore")) if (t := " ".join(cell.split()))]
    return out


# ---- workbooks ------------------------------------------------------------------------------------

#: Numbers of built-in formats that show a day or a time; fixed values.
DAY_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def shows_day(code: str) -> bool:
    """Whether a number format shows a day or a time: its letters outside of quotes, brackets and escapes tell."""
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", code).lower()
    return bare != "general" and bool(re.search(r"[ymdhs]", bare))


def number_text(value: float, day: bool = False, from_1904: bool = False) -> str:
    """A cell's number as text: whole ones without a point; days in ISO form, a mere part of a day as a time."""
    if day and 0 <= value < 2_958_466:
        begin = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30 if value >= 60 else 31)
        at = begin + datetime.timedelta(seconds=round(value * 86_400))
        return at.time().isoformat() if value < 1 else at.isoformat(sep=" ")
    return str(int(value)) if float(value).is_integer() else repr(float(value))


def _rk(raw: int) -> float:
    value = (raw - (1 << 32) if raw >> 31 else raw) >> 2 if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


class _Strings:
    """Reads strings that may run on in the next record, where a flag tells anew how wide characters are."""

    def __init__(self, parts: list[bytes]):
        self._parts, self._k, self._at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if self._at >= len(self._parts[self._k]):
                self._k, self._at = self._k + 1, 0
                if self._k >= len(self._parts):
                    raise ValueError("broken_strings")
            piece = self._parts[self._k][self._at : self._at + n]
            self._at, n, out = self._at + len(piece), n - len(piece), out + piece
        return out

    def string(self, head: str = "<H") -> str:
        left = struct.unpack(head, self.take(struct.calcsize(head)))[0]
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        more = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = []
        while left:
            here = len(self._parts[self._k]) - self._at
            if not here:
                if self._k + 1 >= len(self._parts):
                    raise ValueError("broken_strings")
                self._k, self._at = self._k + 1, 0
                flags = flags & ~1 | self.take(1)[0] & 1
                continue
            n = min(left, here >> (flags & 1)) or left
            out.append(self.take(n << (flags & 1)).decode("utf-16le" if flags & 1 else "latin-1", "replace"))
            left -= n
        self.take(4 * runs + more)
        return "".join(out)


def xls_grids(content: bytes) -> list[list[list[str]]]:
    """The values of all sheets; a row ends with its last cell that holds something, a sheet with its last such row."""
    box = CompoundFile(content)
    name = next((n for n in box.streams if n.lower() == "workbook"), None)
    if name is None:
        raise ValueError("not_a_workbook")
    raw = box.read(name)
    found, at = [], 0  # (offset, record, payloads: its own and what continues it)
    while at + 4 <= len(raw):
        record, size = struct.unpack_from("<HH", raw, at)
        payload = raw[at + 4 : at + 4 + size]
        if record == 0x3C and found:
            found[-1][2].append(payload)
        else:
            found.append((at, record, [payload]))
        at += 4 + size
    shared: list[str] = []
    formats: dict[int, str] = {}
    of_style: list[int] = []
    sheets: list[int] = []
    from_1904 = False
    for _, record, parts in found:
        body = parts[0]
        if record == 0xFC:
            reader = _Strings(parts)
            shared = [reader.string() for _ in range(struct.unpack("<II", reader.take(8))[1])]
        elif record == 0x41E:
            formats[struct.unpack_from("<H", body)[0]] = _Strings([body[2:], *parts[1:]]).string()
        elif record == 0xE0:
            of_style.append(struct.unpack_from("<H", body, 2)[0])
        elif record == 0x85 and body[5] == 0:  # a sheet, not a chart
            sheets.append(struct.unpack_from("<I", body)[0])
        elif record == 0x22:
            from_1904 = struct.unpack_from("<H", body)[0] == 1
        elif record == 0x2F:
            raise ValueError("encrypted")
    day = [shows_day(formats[f]) if f in formats else f in DAY_FORMATS for f in of_style]
    text = lambda value, style: number_text(value, style < len(day) and day[style], from_1904)
    index = {offset: k for k, (offset, _, _) in enumerate(found)}
    out = []
    for start in sheets:
        cells: dict[tuple[int, int], str] = {}
        asked = None  # the formula cell whose text follows
        for _, record, parts in found[index.get(start, len(found)) + 1 :]:
            body = parts[0]
            if record == 0x0A:
                break
            if record == 0x207 and asked:
                cells[asked] = _Strings(parts).string()
            if record not in (0xFD, 0x204, 0xD6, 0x27E, 0xBD, 0x203, 0x06, 0x205):
                continue
            row, column, style = struct.unpack_from("<HHH", body)
            if record == 0xFD:
                cells[row, column] = shared[struct.unpack_from("<I", body, 6)[0]]
            elif record in (0x204, 0xD6):
                cells[row, column] = _Strings([body[6:], *parts[1:]]).string()
            elif record == 0x27E:
                cells[row, column] = text(_rk(struct.unpack_from("<I", body, 6)[0]), style)
            elif record == 0xBD:
                for k in range((len(body) - 6) // 6):
                    style, value = struct.unpack_from("<HI", body, 4 + 6 * k)
                    cells[row, column + k] = text(_rk(value), style)
            elif record == 0x205:
                cells[row, column] = str(body[6])
            elif record == 0x06 and body[12:14] == b"\xff\xff":  # no number: text follows, or a truth value
                asked = (row, column) if body[6] == 0 else None
                if body[6] == 1:
                    cells[row, column] = str(body[8])
            else:
                cells[row, column] = text(struct.unpack_from("<d", body, 6)[0], style)
        full = {k: v for k, v in cells.items() if v != ""}
        grid: list[list[str]] = [[] for _ in range(1 + max((r for r, _ in full), default=-1))]
        for (r, c), v in sorted(full.items()):
            grid[r] += [""] * (c - len(grid[r])) + [v]
        out.append(grid)
    return out
