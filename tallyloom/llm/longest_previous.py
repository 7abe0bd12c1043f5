"""Substring dedup on bytes by longest-previous-factor arrays: the first copy of a passage stays, later ones go.

A byte goes if a string of ``width`` bytes covers it that also starts in a document with a smaller id. In the suffix
order of all texts, the nearest suffix before and the nearest one after that belong to a document with a smaller id
(previous and next smaller value) share the longest prefix with a suffix that any such document has: the longer of
the two is the suffix's longest previous factor, and from ``width`` bytes on it is removed.

Distribution. Texts are read once, into blocks. Consecutive windows of ``width`` bytes with the same minimiser (see
substrings.py; hot minimisers hand over to longer ones, then to the window) travel as one packed string to the
minimiser's partition, so all suffixes that share ``width`` bytes meet in one portion of it, where they are put in
suffix order, up to the ends of their strings. Suffixes that share less need no common order, as no match that counts
crosses it. A block sends a string once, for the least of its documents that hold it; in the block's other documents
the string is settled on the spot, by that one. What returns to a block are spans; texts are not shuffled but read
again, as blocks.

Defined cases: null text is empty; texts shorter than ``width`` bytes stay whole; matches in documents of the same id,
or inside one document, don't count, so rows that repeat an id are judged alike; a null id comes after all others, and
null ids don't precede each other; a cut may fall inside a character, so what stays is binary; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import substrings
from tallyloom.llm.common import Bytes, planes, steps, text_or_empty, unplaned, written
from tallyloom.llm.substrings import hot_minimisers, merged

WIDTH = 50
LEVELS = (8, 32)  # run lengths of the minimisers; after them the window decides
BLOCK_BYTES = 2 << 20
PART_BYTES = 64 << 20  # of packed strings in one partition, before compression
SENT_BYTES = 16 << 20  # strings that a map task holds back, to send them in few rows
SUBS = 16  # a partition's strings are sorted in so many portions
LONE_BYTES = 8 << 20  # of packed strings that share a minimiser: they all lie in one portion, which is held in memory
STRING_BYTES = 3.3  # of packed strings per byte of text, about
LONGEST = 64  # windows of a string
STOP = 0xFF  # ends a string; no UTF-8 text holds it
_C = np.uint64(0xD6E8FEB86659FD93)


# ---- blocks of texts ------------------------------------------------------------------------------


class Block(substrings.Block):
    """Documents as bytes, with their ids."""

    levels = LEVELS

    def __init__(self, at: int, ids: np.ndarray, none: np.ndarray, texts: list[bytes], width: int = WIDTH):
        self.at, self.ids, self.none, self.texts = at, ids, none, texts
        super().__init__(None, texts, width, Bytes)

    def order(self) -> np.ndarray:
        """Per document its place in the order of ids, the same for equal ids."""
        return places(self.none, self.ids)

    def strings(self, deal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, count = super().strings(deal)
        cuts = -(-count // LONGEST)
        nth = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        return np.repeat(begin, cuts) + nth * LONGEST, np.minimum(np.repeat(count, cuts) - nth * LONGEST, LONGEST)


def places(none: np.ndarray, ids: np.ndarray) -> np.ndarray:
    order = np.lexsort((np.where(none, 0, ids), none))
    new = np.zeros(len(order), bool)
    new[1:] = (none[order][1:] != none[order][:-1]) | (~none[order][1:] & (ids[order][1:] != ids[order][:-1]))
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def blob_of(ids: list[int | None], texts: list[bytes]) -> bytes:
    none = np.array([i is None for i in ids], bool)
    head = planes(np.array([i or 0 for i in ids], np.int64).view(np.uint64), none, np.array([len(t) for t in texts]))
    return zstandard.ZstdCompressor(level=3).compress(len(head).to_bytes(8, "little") + head + b"".join(texts))


def documents(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    upto = 8 + int.from_bytes(raw[:8], "little")
    ids, none, lengths = unplaned(raw[8:upto])
    ends = (np.cumsum(lengths) + upto).tolist()
    return ids, none.astype(bool), [raw[a:b] for a, b in zip([upto, *ends], ends)]


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to blocks: (block, blob, size), size in bytes of text."""
    at = TaskContext.get().partitionId() << 24
    ids, texts, size = [], [], 0

    def block() -> pa.RecordBatch:
        return pa.record_batch([pa.array([at]), pa.array([blob_of(ids, texts)], pa.binary()), pa.array([size])], names=["block", "blob", "size"])

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(i)
            texts.append(t.as_py().encode())
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield block()
                at, ids, texts, size = at + 1, [], [], 0
    if texts:
        yield block()


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Block]:
    for batch in batches:
        for at, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield Block(at, *documents(blob.as_py()), width)


# ---- strings on their way -------------------------------------------------------------------------


def sections(block: Block, parts: int, hot: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(partition, section): a block's distinct strings for a partition, with their places in the least document.

    Partition -1: spans (document, from, to) that the block settles itself.
    """
    if not block.valid.any():
        return
    deal = block.dealt(hot)
    begin, count = block.strings(deal)
    a, b = block.bytes_of(begin, count)
    line = block.words.line.tobytes()
    seen: dict[bytes, int] = {}
    which = np.fromiter((seen.setdefault(line[x:y], len(seen)) for x, y in zip(a.tolist(), b.tolist())), np.int64, len(a))
    doc = np.searchsorted(block.words.first + block.words.lengths, begin, side="right")
    at = begin - block.words.first[doc]
    order = block.order()[doc]
    least = np.full(len(seen), len(block.ids))
    np.minimum.at(least, which, order)
    later = order > least[which]
    if later.any():
        keys, n, lo, hi = merged(np.stack([doc[later], np.zeros(later.sum(), np.int64)], axis=1), at[later], (at + count + block.width - 1)[later])
        yield -1, planes(np.repeat(keys[:, 0], n), lo, hi)
    held = np.flatnonzero(~later)
    held = held[np.argsort(which[held], kind="stable")]  # places by string, ascending
    times = np.bincount(which[held], minlength=len(seen))
    first = np.cumsum(times) - times
    one = held[first]  # a place of each string
    h = substrings.mixed_bits(deal[begin[one]] * _C)
    part, sub = ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64), (h % np.uint64(SUBS)).astype(np.int64)
    texts, sizes = list(seen), (b - a)[one] + 1
    by_part = np.lexsort((begin[one], sub, part))
    for mine in np.split(by_part, np.flatnonzero(np.diff(part[by_part])) + 1):
        n = times[mine]
        where = begin[held[np.repeat(first[mine], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]]
        again = where[np.flatnonzero(np.arange(len(where)) != np.repeat(np.cumsum(n) - n, n))]  # further places of strings that have some
        used = np.unique(np.searchsorted(block.words.first + block.words.lengths, where, side="right"))
        portion = np.bincount(sub[mine], sizes[mine], SUBS).astype(np.int64)
        at = steps(begin[one[mine]] + sub[mine] * len(block.words))  # ascending over all portions
        head = planes([block.at, len(block.words)], steps(used), block.ids[used].view(np.uint64), block.none[used], steps(block.words.first[used]), portion, np.bincount(sub[mine], minlength=SUBS), n, at, again)
        yield int(part[mine[0]]), len(head).to_bytes(8, "little") + head + b"\xff".join([texts[k] for k in mine.tolist()]) + b"\xff"


def sent(batches: Iterator[pa.RecordBatch], parts: int, hot: list[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """(part, block, pack): sections of several blocks for a partition; with a block, what it settled itself."""
    squeeze = zstandard.ZstdCompressor(level=3)

    def row(part: int, block: int | None, pack: bytes) -> pa.RecordBatch:
        return pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([squeeze.compress(pack)], pa.binary())], names=["part", "block", "pack"])

    held: dict[int, list[bytes]] = {}
    size = 0
    for block in blocks(batches, width):
        for part, section in sections(block, parts, hot):
            if part < 0:
                yield row(block.at % parts, block.at, section)
                continue
            held.setdefault(part, []).extend((len(section).to_bytes(8, "little"), section))
            size += len(section)
        if size >= SENT_BYTES:
            for part, pieces in held.items():
                yield row(part, None, b"".join(pieces))
            held, size = {}, 0
    for part, pieces in held.items():
        yield row(part, None, b"".join(pieces))


# ---- suffix order and longest previous factors ----------------------------------------------------


def equal_bytes(x: np.ndarray) -> np.ndarray:
    """Of two words' xor: how many leading bytes agree."""
    out = np.zeros(len(x), np.int64)
    for k in range(1, 9):
        out += x < np.uint64(1 << (64 - 8 * k)) if k < 8 else x == 0
    return out


def nearest_smaller(order: np.ndarray, shared: np.ndarray, width: int) -> np.ndarray:
    """shared: what each suffix shares with the one before. Per suffix, what it shares with the nearest one before that has
    a smaller order; less than ``width`` if there is none that shares as much."""
    before, shared = np.arange(len(order)) - 1, shared.copy()
    bad = np.arange(len(order))
    while True:
        bad = bad[(shared[bad] >= width) & (order[before[bad]] >= order[bad])]
        if not len(bad):
            return shared
        step = before[bad]  # all from there to its own ``before`` have a greater order still
        shared[bad], before[bad] = np.minimum(shared[bad], shared[step]), before[step]


def previous_factors(raw: bytes, order: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, from, to) of the longest previous factors of ``width`` bytes or more; raw: strings, each ended by STOP;
    order: of the strings' documents."""
    size = len(raw)
    line = np.frombuffer(raw + bytes(16), np.uint8)
    ends = np.flatnonzero(line[:size] == STOP)
    begins = np.append(0, ends[:-1] + 1)
    windows = np.maximum(ends - begins - width + 1, 0)
    string = np.repeat(np.arange(len(ends), dtype=np.int32), windows)
    at = np.repeat(begins - np.cumsum(windows) + windows, windows) + np.arange(len(string))
    nothing = (np.zeros(0, np.int64),) * 3
    if not len(at):
        return nothing
    # windows that no document with another id shares are out at once: sorted by their hash, with their numbers in its low bits
    bits = np.uint64(len(at).bit_length())
    value = Bytes([raw]).spans(at, at + width) >> bits << bits
    value |= np.arange(len(at), dtype=np.uint64)
    value.sort()
    by, value = (value & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), value >> bits
    same = value[1:] == value[:-1]
    many = np.append(same, False) | np.append(False, same)
    by, value = by[many], value[many]
    if not len(by):
        return nothing
    opens = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    whose = order[string[by]]
    many = np.minimum.reduceat(whose, opens) < np.maximum.reduceat(whose, opens)
    sizes = np.diff(np.append(opens, len(by)))
    keep = np.repeat(many, sizes)
    by, whose, group = by[keep], whose[keep], np.repeat(np.arange(int(many.sum())), sizes[many])
    if not len(by):
        return nothing
    by = by[np.lexsort((whose, group))]  # equal suffixes stay in order of their documents
    at, string = at[by], string[by]
    left = ends[string] - at  # bytes up to the string's end
    words = np.ndarray(size + 8, ">u8", line.tobytes(), strides=(1,))
    offsets = [*range(0, width - 7, 8), width - 8]
    same = group[1:] == group[:-1]
    alike = np.ones(len(same), bool)
    for k in offsets:
        w = words[at + k]
        alike &= w[1:] == w[:-1]
    if (same & ~alike).any():  # different windows with the same hash: put all in order of their bytes
        keys = [words[at + k].astype(np.uint64) for k in offsets]
        by = np.lexsort((order[string], *keys[::-1]))
        at, string, left, keys = at[by], string[by], left[by], [x[by] for x in keys]
        same = np.logical_and.reduce([x[1:] == x[:-1] for x in keys])
    # suffix order: ties are put in order of the next eight bytes, until they differ or end
    number = np.arange(len(at))
    tied = np.append(same, False)  # with the next
    shared = np.zeros(len(at), np.int64)  # with the one before
    depth = width
    while True:
        some = tied.copy()
        some[1:] |= tied[:-1]
        some = np.flatnonzero(some & (left[number] >= depth))
        if not len(some):
            break
        run = np.cumsum(np.append(True, ~tied[:-1]))[some]
        key = words[at[number[some]] + depth].astype(np.uint64)
        pair = run[1:] == run[:-1]
        differ = pair & (key[1:] != key[:-1])
        if differ.any():  # runs that all go on alike are in order as they stand
            mixed = np.zeros(int(run[-1]) + 1, bool)
            mixed[run[1:][differ]] = True
            mine = np.flatnonzero(mixed[run])
            to = mine[np.lexsort((key[mine], run[mine]))]
            number[some[mine]], key[mine] = number[some[to]], key[to]
            differ = pair & (key[1:] != key[:-1])
        shared[some[1:][differ]] = depth + equal_bytes((key[1:] ^ key[:-1])[differ])
        tied[some[:-1][differ]] = False
        depth += 8
    at, string, left = at[number], string[number], left[number]
    shared[1:][tied[:-1]] = left[1:][tied[:-1]]
    shared[1:] = np.minimum(shared[1:], np.minimum(left[1:], left[:-1]))
    whose = order[string]
    back = np.append(0, shared[1:][::-1])
    longest = np.maximum(nearest_smaller(whose, shared, width), nearest_smaller(whose[::-1], back, width)[::-1])
    found = np.flatnonzero(longest >= width)
    of = string[found].astype(np.int64)
    lo = at[found] - begins[of]
    return of, lo, lo + longest[found]


def found_spans(packs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, document) keys, spans of each, and the spans, from all sections of a partition."""
    heads, portions = [], []
    for pack in packs:
        raw = zstandard.ZstdDecompressor().decompress(pack)
        at = 0
        while at < len(raw):
            end = at + 8 + int.from_bytes(raw[at : at + 8], "little")
            upto = at + 16 + int.from_bytes(raw[at + 8 : at + 16], "little")
            head = unplaned(raw[at + 16 : upto])
            cuts = (upto + np.cumsum(head[5])).tolist()
            heads.append(head)
            portions.append([raw[x:y] for x, y in zip([upto, *cuts], cuts)])
            at = end
    nowhere = (np.zeros((0, 2), np.int64), *(np.zeros(0, np.int64),) * 3)
    if not heads:
        return nowhere
    docs = np.cumsum([0] + [len(h[1]) for h in heads])
    owner = np.stack([np.repeat([h[0][0] for h in heads], np.diff(docs)), np.concatenate([np.cumsum(h[1]) for h in heads])], axis=1)
    order = places(np.concatenate([h[3] for h in heads]).astype(bool), np.concatenate([h[2] for h in heads]))
    keys, los, his = [], [], []
    for s in range(SUBS):
        raw = b"".join([p[s] for p in portions])
        if not raw:
            continue
        times, doc, at = map(np.concatenate, zip(*[spots(h, s, base) for h, base in zip(heads, docs.tolist())]))
        first = np.cumsum(times) - times
        of, lo, hi = previous_factors(raw, order[doc[first]], width)
        if not len(of):
            continue
        key, n, lo, hi = merged(np.stack([of, np.zeros_like(of)], axis=1), lo, hi)
        of = np.repeat(key[:, 0], n)
        each = times[of]  # a span of a string stands at all its places
        spot = np.repeat(first[of], each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        keys.append(owner[doc[spot]])
        los.append(np.repeat(lo, each) + at[spot])
        his.append(np.repeat(hi, each) + at[spot])
    return merged(np.concatenate(keys), np.concatenate(los), np.concatenate(his)) if keys else nowhere


def spots(head: list[np.ndarray], sub: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a section's portion: how many places each string has, and of each place the document (numbered from base) and the byte in it."""
    (_, length), _, _, _, first, _, strings, times, at, again = head
    a, b = int(strings[:sub].sum()), int(strings[: sub + 1].sum())
    more = int((times[:a] - 1).sum())
    n = times[a:b]
    where = np.empty(int(n.sum()), np.int64)
    ones = np.cumsum(n) - n
    rest = np.ones(len(where), bool)
    rest[ones] = False
    where[ones] = np.cumsum(at)[a:b] - sub * length
    where[rest] = again[more : more + int(rest.sum())]
    first = np.cumsum(first)
    doc = np.searchsorted(first, where, side="right") - 1
    return n, doc + base, where - first[doc]


# ---- the job --------------------------------------------------------------------------------------


def spans_row(block: int, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    flat = np.stack([doc, lo, hi], axis=1).ravel().astype(np.int32)
    return pa.record_batch([pa.array([block]), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))], names=["block", "spans"])


def share_of_hot(size: int, parts: int) -> float:
    """The share of all strings from which a minimiser is hot, for texts of so many bytes: a partition can take it, and a portion
    holds it in memory, however large the input is."""
    return min(1 / (4 * parts), LONE_BYTES / (STRING_BYTES * max(size, 1)))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, parts: int | None = None, hot_share: float | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary), one row per row of docs."""
    if width < LEVELS[-1]:
        raise ValueError(f"width must be {LEVELS[-1]} bytes or more")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    sized = written(rows.mapInArrow(read, "block long, blob binary, size long"), "byte-blocks")
    texts = sized.select("block", "blob")
    least_parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = hot_share or share_of_hot(sized.agg(F.sum("size")).first()[0] or 0, least_parts)
    hot, size = hot_minimisers(texts, share, width, blocks, LEVELS)
    parts = parts or max(least_parts, -(-size // PART_BYTES))  # by data, if the session's number is too small for it

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = []
        for batch in batches:
            for block, pack in zip(batch.column(1).to_pylist(), batch.column(2)):
                if block is None:
                    packs.append(pack.as_py())
                else:
                    yield spans_row(block, *unplaned(zstandard.ZstdDecompressor().decompress(pack.as_py())))
        key, n, lo, hi = found_spans(packs, width)
        owner = np.repeat(key, n, axis=0)
        cuts = np.flatnonzero(np.diff(owner[:, 0])) + 1
        for mine in np.split(np.arange(len(owner)), cuts) if len(owner) else []:
            yield spans_row(int(owner[mine[0], 0]), owner[mine, 1], lo[mine], hi[mine])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, spans in zip(batch.column(0), batch.column(1)):
                ids, none, whole = documents(blob.as_py())
                flat = spans.values.to_numpy().astype(np.int64) if spans.is_valid else np.zeros(0, np.int64)
                doc, lo, hi = flat.reshape(-1, 3).T
                keys, n, lo, hi = merged(np.stack([doc, np.zeros_like(doc)], axis=1), lo, hi)
                n_spans, gone = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                n_spans[keys[:, 0]] = n
                np.add.at(gone, np.repeat(keys[:, 0], n), hi - lo)
                kept, end = list(whole), np.cumsum(n)
                for d, a, b in zip(keys[:, 0].tolist(), (end - n).tolist(), end.tolist()):
                    edges = [0, *np.stack([lo[a:b], hi[a:b]], axis=1).ravel().tolist(), len(whole[d])]
                    kept[d] = b"".join([whole[d][x:y] for x, y in zip(edges[::2], edges[1::2])])
                lengths = pa.array(np.array([len(t) for t in whole], np.int64))
                yield pa.record_batch([pa.array(ids, mask=none), lengths, pa.array(gone), pa.array(n_spans), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    packs = texts.mapInArrow(lambda batches: sent(batches, parts, hot, width), "part int, block long, pack binary").repartitionById(parts, "part")
    spans = packs.mapInArrow(find, "block long, spans array<int>").groupBy("block").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    found = texts.join(spans, "block", "left").select("blob", "spans")
    return found.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


#: All windows of all texts, in pieces of 500 bytes; bytes are two hex digits.
KEEP_FIRST_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM {docs}),
q AS (SELECT r, doc_id, regexp_extract_all(x, '.{1,1000}') AS pieces FROM t),
c AS (SELECT r, doc_id, k.k, pieces[k.k] AS piece, pieces[k.k] || coalesce(substr(pieces[k.k + 1], 1, 98), '') AS more
  FROM q, LATERAL (SELECT unnest(generate_series(1, len(pieces))) AS k) k),
b AS (SELECT r, doc_id, 500 * (k - 1) + i.i AS pos, substr(piece, 2 * i.i + 1, 2) AS byte, substr(more, 2 * i.i + 1, 100) AS w
  FROM c, LATERAL (SELECT unnest(generate_series(0, length(piece) // 2 - 1)) AS i) i),
m AS (SELECT w, min(doc_id) AS least, max(doc_id) AS most FROM b WHERE length(w) = 100 GROUP BY w HAVING least < most),
f AS (SELECT b.r, b.pos, b.byte, CASE WHEN m.least < b.doc_id THEN b.pos END AS hit FROM b LEFT JOIN m ON b.w = m.w),
g AS (SELECT r, pos, byte, coalesce(max(hit) OVER (PARTITION BY r ORDER BY pos) > pos - 50, false) AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY pos), false) AS opens FROM g),
s AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
  string_agg(byte, '' ORDER BY pos) FILTER (NOT gone) AS kept FROM e GROUP BY r)
SELECT t.doc_id, length(t.x) // 2 AS n_bytes, coalesce(s.n_removed, 0) AS n_removed, coalesce(s.n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(s.kept, ''))) AS kept_sha256 FROM t LEFT JOIN s ON t.r = s.r
"""
