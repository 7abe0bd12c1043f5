"""Writers of small binary office files for the tests: compound files, workbooks, word-processor files."""

from __future__ import annotations

import struct
import zlib

END, FREE, NONE = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFF


def compound(streams: dict[str, bytes]) -> bytes:
    """Streams of 4096 bytes and more in sectors, shorter ones in the root's small stream; paths have one slash at most."""
    small, small_table, large, table = b"", [], [], []

    def put(data: bytes) -> int:
        first = len(large)
        pieces = [data[k : k + 512].ljust(512, b"\0") for k in range(0, len(data), 512)]
        large.extend(pieces)
        table.extend([*range(first + 1, first + len(pieces)), END] if pieces else [])
        return first if pieces else END

    entries = [["Root Entry", 5, NONE, NONE, NONE, 0, 0]]  # name, kind, left, right, child, start, size
    folders: dict[str, int] = {"": 0}
    for path, data in streams.items():
        folder, _, name = path.rpartition("/")
        if folder not in folders:
            folders[folder] = len(entries)
            entries.append([folder, 1, NONE, entries[0][4], NONE, 0, 0])
            entries[0][4] = folders[folder]
        if len(data) < 4096:
            start = len(small_table) if data else END
            n = -(-len(data) // 64)
            small_table += [*range(start + 1, start + n), END] if n else []
            small += data.ljust(64 * n, b"\0")
        else:
            start = put(data)
        above = folders[folder]
        entries.append([name, 2, NONE, entries[above][4], NONE, start, len(data)])
        entries[above][4] = len(entries) - 1
    entries[0][5], entries[0][6] = put(small), len(small)
    first_small = put(struct.pack(f"<{len(small_table)}I", *small_table)) if small_table else END
    if small_table:
        pad = -len(small_table) % 128
        large[-1] = large[-1][: 512 - 4 * pad] + b"\xff" * (4 * pad)
    raw = b""
    for name, kind, left, right, child, start, size in entries:
        label = name.encode("utf-16le") + b"\0\0"
        raw += label.ljust(64, b"\0") + struct.pack("<HBB3I", len(label), kind, 1, left, right, child) + bytes(36) + struct.pack("<IQ", start, size)
    first_directory = put(raw)
    n_table = 1
    while len(table) + n_table > 128 * n_table:
        n_table += 1
    at = list(range(len(large), len(large) + n_table))
    table += [0xFFFFFFFD] * n_table
    allocation = struct.pack(f"<{len(table)}I", *table).ljust(512 * n_table, b"\xff")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10)
    head += struct.pack("<6I", n_table, first_directory, 0, 4096, first_small, 1)[:0]
    head += struct.pack("<I", n_table) + struct.pack("<6I", first_directory, 0, 4096, first_small, 1, END) + struct.pack("<I", 0)
    head += struct.pack("<109I", *(at + [FREE] * (109 - n_table)))
    return head + b"".join(large) + allocation


def _record(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def _string(text: str, head: str = "<H") -> bytes:
    wide = any(ord(c) > 255 for c in text)
    return struct.pack(head, len(text)) + bytes([wide]) + (text.encode("utf-16le") if wide else text.encode("latin-1"))


def xls(sheets: list[list[list]], shared: bool = True, cut: int = 60, date_code: str = "yyyy\\-mm\\-dd") -> bytes:
    """Cells: None, text, numbers, ("day", serial), ("rk", 32 bits), ("mulrk", [32 bits...]), ("formula", number or text).

    Shared strings are cut into records of ``cut`` bytes, inside characters' runs as well.
    """
    texts = [c for s in sheets for r in s for c in r if isinstance(c, str)]
    strings = list(dict.fromkeys(texts))
    parts, body = [], struct.pack("<II", len(texts), len(strings))
    for t in strings:
        wide = any(ord(c) > 255 for c in t)
        if len(body) + 3 > cut:
            parts, body = [*parts, body], b""
        body += struct.pack("<HB", len(t), wide)
        for c in t:
            one = c.encode("utf-16le") if wide else c.encode("latin-1")
            if len(body) + len(one) > cut:
                parts, body = [*parts, body], bytes([wide])
            body += one
    parts.append(body)
    table = _record(0xFC, parts[0]) + b"".join(_record(0x3C, p) for p in parts[1:])
    bof = lambda kind: _record(0x809, struct.pack("<HHHHII", 0x600, kind, 0, 0, 0, 0))
    xf = lambda fmt: _record(0xE0, struct.pack("<HH", 0, fmt) + bytes(16))
    head = bof(5) + _record(0x22, b"\0\0") + _record(0x41E, struct.pack("<H", 170) + _string(date_code)) + xf(0) + xf(170) + xf(14)
    bodies = []
    for grid in sheets:
        out = bof(16)
        for r, row in enumerate(grid):
            for c, v in enumerate(row):
                at = struct.pack("<HHH", r, c, 0)
                if v is None:
                    continue
                if isinstance(v, str):
                    out += _record(0xFD, at + struct.pack("<I", strings.index(v))) if shared else _record(0x204, at + _string(v))
                elif isinstance(v, bool):
                    out += _record(0x205, at + bytes([v, 0]))
                elif isinstance(v, tuple) and v[0] == "day":
                    out += _record(0x203, struct.pack("<HHHd", r, c, 1 + (c % 2), v[1]))
                elif isinstance(v, tuple) and v[0] == "rk":
                    out += _record(0x27E, at + struct.pack("<I", v[1]))
                elif isinstance(v, tuple) and v[0] == "mulrk":
                    out += _record(0xBD, struct.pack("<HH", r, c) + b"".join(struct.pack("<HI", 0, x) for x in v[1]) + struct.pack("<H", c + len(v[1]) - 1))
                elif isinstance(v, tuple) and isinstance(v[1], str):
                    out += _record(0x06, at + b"\0\0\0\0\0\0\xff\xff" + bytes(6)) + _record(0x207, _string(v[1]))
                elif isinstance(v, tuple):
                    out += _record(0x06, at + struct.pack("<d", v[1]) + bytes(6))
                else:
                    out += _record(0x203, at + struct.pack("<d", v))
        bodies.append(out + _record(0x0A, b""))
    names = [_record(0x85, struct.pack("<IBB", 0, 0, 0) + _string(f"s{k}", "<B")) for k in range(len(sheets))]
    offset = len(head) + sum(map(len, names)) + len(table) + 4
    bounds = b""
    for k, b in enumerate(bodies):
        bounds += _record(0x85, struct.pack("<IBB", offset, 0, 0) + _string(f"s{k}", "<B"))
        offset += len(b)
    book = head + bounds + table + _record(0x0A, b"") + b"".join(bodies)
    return compound({"Workbook": book.ljust(4096, b"\0"), "\x05SummaryInformation": b"x" * 100})


def hwp(sections: list[list[str]], packed: bool = True, preview: str = "") -> bytes:
    """Paragraphs; "\\x0b" in one stands for a table's control with its data, "\\x09" for a tab with its."""
    streams = {"FileHeader": b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 0x05000300, int(packed)) + bytes(216)}
    for k, paragraphs in enumerate(sections):
        raw = b""
        for p in paragraphs:
            units = "".join(c + "lbt \0\0" + c if c in "\x0b\x09" else c for c in p) + "\r"
            body = units.encode("utf-16le")
            raw += struct.pack("<I", 66 | 22 << 20) + bytes(22)  # a paragraph's head
            raw += struct.pack("<I", 67 | 1 << 10 | (len(body) if len(body) < 0xFFF else 0xFFF) << 20)
            raw += (struct.pack("<I", len(body)) if len(body) >= 0xFFF else b"") + body
        squeeze = zlib.compressobj(9, zlib.DEFLATED, -15)
        streams[f"BodyText/Section{k}"] = squeeze.compress(raw) + squeeze.flush() if packed else raw
    if preview:
        streams["PrvText"] = preview.encode("utf-16le")
    return compound(streams)
