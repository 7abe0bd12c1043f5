"""Substring dedup by super-k-mer partitioning.

A window is ``width`` consecutive words of one document. Its minimiser is the least hash among its
runs of ``LEVELS[0]`` words; consecutive windows with the same minimiser travel together as one packed
string to the minimiser's bucket, so a window's words are sent about three times, not 35. Equal windows
have equal minimisers and meet in one bucket, which sorts all its windows and counts them exactly:
windows of equal hash are compared byte for byte.

Skew. A minimiser with a share of all strings that a bucket can't take is *hot*: its windows are dealt by
their minimiser of the next, longer run length instead, still as packed strings of consecutive windows, and
so on until the window itself decides. A map task combines equal strings of a block first: a string
that occurs twice there is known to repeat, so its places are settled on the spot and one witness travels
on, without places. A passage that a third of all rows hold thus sends one string per block.

What returns are spans of words per text, keyed by the text's two 64-bit hashes: equal texts share their
spans, whatever their number, and a bucket merges a text's spans into one row before it leaves.

Defined cases: null text has no words; texts shorter than a window keep all words; a window that repeats
inside one document counts as elsewhere; repeated rows are copies of each other, whatever their ids;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Words, drop_written, mixed_bits, text_or_empty, written

WIDTH = 35
LEVELS = (3, 12, 24)  # run lengths of the minimisers; after them the window decides
BLOCK_BYTES = 4 << 20
PART_BYTES = 64 << 20  # of packed strings in one partition, before compression
SUBS = 16  # a partition's strings are sorted in so many portions
_C = np.uint64(0xD6E8FEB86659FD93)


class Block:
    """Some texts, their words (or other units), and the windows' minimisers at each level."""

    levels = LEVELS

    def __init__(self, keys: np.ndarray, texts: list[bytes], width: int = WIDTH, units: type[Words] = Words):
        self.keys, self.width = keys, width
        self.words = w = units(texts)
        count = len(w) - width + 1
        self.valid = np.zeros(max(count, 0), bool)
        if count > 0:
            edge = np.zeros(count + 1, np.int64)
            has = w.lengths >= width
            np.add.at(edge, w.first[has], 1)
            np.add.at(edge, (w.first + w.lengths - width + 1)[has], -1)
            self.valid = np.cumsum(edge[:count]) > 0

    def least(self, level: int) -> np.ndarray:
        """The minimiser of each window; beyond the last level the window's own hash."""
        m = self.levels[level] if level < len(self.levels) else self.width
        run = self.words.runs(m)
        span, step = self.width - m + 1, 1
        while step * 2 <= span:
            run = np.minimum(run[:-step], run[step:])
            step *= 2
        if span > step:
            run = np.minimum(run[: -(span - step)], run[span - step :])
        return run

    def strings(self, deal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each super-k-mer: consecutive windows dealt alike."""
        v = self.valid
        first = v.copy()
        first[1:] &= ~v[:-1] | (deal[1:] != deal[:-1])
        begin = np.flatnonzero(first)
        covered = np.concatenate(([0], np.cumsum(v)))
        return begin, covered[np.append(begin[1:], len(v))] - covered[begin]

    def dealt(self, hot: list[np.ndarray]) -> np.ndarray:
        """What decides each window's bucket, given the hot minimisers of each level."""
        deal = self.least(0)
        todo = np.ones(len(deal), bool)
        for level, values in enumerate(hot):
            if not len(values):
                break
            at = np.minimum(np.searchsorted(values, deal), len(values) - 1)
            todo &= values[at] == deal
            if not todo.any():
                break
            deal = np.where(todo, self.least(level + 1) + np.uint64(level + 1), deal)
        return deal

    def bytes_of(self, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.words.at[begin], self.words.end[begin + count + self.width - 2]


def blocks(batches: Iterator[pa.RecordBatch], width: int = WIDTH) -> Iterator[Block]:
    """batches of (h1, h2, text)."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for a, b, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            keys.append((a, b))
            texts.append(t.as_py().encode())
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield Block(np.array(keys, np.int64), texts, width)
                keys, texts, size = [], [], 0
    if texts:
        yield Block(np.array(keys, np.int64), texts, width)


def merged(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans [lo, hi) of texts (keys: n x 2): overlapping or touching ones of a text are joined.

    Returns the texts, how many spans each has, and the spans in order of text and place.
    """
    if not len(keys):
        return keys, lo, lo, hi
    order = np.lexsort((lo, keys[:, 1], keys[:, 0]))
    keys, lo, hi = keys[order], lo[order], hi[order]
    other = np.ones(len(keys), bool)
    other[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    text = np.cumsum(other) - 1
    far = (hi.max(initial=0) + 1) * text  # keeps the texts apart on one line
    reach = np.maximum.accumulate(hi + far)
    opens = other.copy()
    opens[1:] |= lo[1:] + far[1:] > reach[:-1]
    begin = np.flatnonzero(opens)
    last = np.append(begin[1:], len(keys)) - 1
    return keys[other], np.bincount(text[begin], minlength=int(other.sum())), lo[begin], (reach - far)[last]


def packs(block: Block, parts: int, hot: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """(partition, kind, pack): 0, the block's distinct strings for a partition; 1, spans settled here."""
    if not block.valid.any():
        return
    deal = block.dealt(hot)
    begin, count = block.strings(deal)
    a, b = block.bytes_of(begin, count)
    line = block.words.line.tobytes()
    seen: dict[bytes, int] = {}
    which = np.fromiter((seen.setdefault(line[x:y], len(seen)) for x, y in zip(a.tolist(), b.tolist())), np.int64, len(a))
    times = np.bincount(which)
    rep = np.empty(len(seen), np.int64)  # a place of each string
    rep[which[::-1]] = np.arange(len(which))[::-1]
    doc = np.searchsorted(block.words.first + block.words.lengths, begin, side="right")
    at = begin - block.words.first[doc]
    squeeze = zstandard.ZstdCompressor(level=1)
    twice = times[which] > 1
    if twice.any():
        keys, n, lo, hi = merged(block.keys[doc[twice]], at[twice], (at + count + block.width - 1)[twice])
        to = (keys[:, 0].view(np.uint64) % np.uint64(parts)).astype(np.int64)
        for p in np.unique(to).tolist():
            mine = to == p
            spans = np.repeat(mine, n)
            yield p, 1, squeeze.compress(b"".join(x.tobytes() for x in (np.array([mine.sum()]), keys[mine], n[mine], lo[spans], hi[spans])))
    h = mixed_bits(deal[begin[rep]] * _C)
    part, sub = ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64), (h % np.uint64(SUBS)).astype(np.int64)
    order = np.lexsort((sub, part))
    texts = list(seen)
    for mine in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        r = rep[mine]
        lone = times[mine] == 1
        used, local = np.unique(doc[r[lone]], return_inverse=True)
        place = np.full((2, len(mine)), -1, np.int32)  # text and first word; -1: known to repeat
        place[0, lone], place[1, lone] = local, at[r[lone]]
        portions = [b"\n".join([texts[i] for i in part_of.tolist()]) for part_of in np.split(mine, np.searchsorted(sub[mine], np.arange(1, SUBS)))]
        head = np.array([len(used), *map(len, portions)], np.int64)
        yield int(part[mine[0]]), 0, squeeze.compress(head.tobytes() + block.keys[used].tobytes() + b"".join(portions) + place.tobytes())


def unpacked(raw: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Texts' keys, the strings of each portion, and places (text, first word) of all strings."""
    head = np.frombuffer(raw, np.int64, SUBS + 1)
    at = 8 * len(head)
    keys = np.frombuffer(raw, np.int64, 2 * int(head[0]), at).reshape(-1, 2)
    at += keys.nbytes
    portions = []
    for n in head[1:].tolist():
        portions.append(raw[at : at + n])
        at += n
    return keys, portions, np.frombuffer(raw, np.int32, offset=at).reshape(2, -1)


def repeated_windows(line: bytes, a: np.ndarray, b: np.ndarray, hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which windows (bytes a to b of line) are known to repeat or equal another one, byte for byte."""
    order = np.argsort(hashes)
    h = hashes[order]
    same = np.zeros(len(h) + 1, bool)  # with the one before
    alike = np.flatnonzero(h[1:] == h[:-1])
    i, j = order[alike], order[alike + 1]
    differ = [line[p:q] != line[r:s] for p, q, r, s in zip(a[i].tolist(), b[i].tolist(), a[j].tolist(), b[j].tolist())]
    same[alike + 1] = True
    if any(differ):  # windows of other words share a hash: put those of such hashes in order of their words
        for value in np.unique(h[alike[np.array(differ)]]).tolist():
            lo, hi = np.searchsorted(h, np.uint64(value), "left"), np.searchsorted(h, np.uint64(value), "right")
            order[lo:hi] = members = sorted(order[lo:hi].tolist(), key=lambda k: line[a[k] : b[k]])
            same[lo + 1 : hi] = [line[a[x] : b[x]] == line[a[y] : b[y]] for x, y in zip(members, members[1:])]
    out = np.zeros(len(h), bool)
    out[order] = same[:-1] | same[1:]
    # one known to repeat settles all that equal it
    group = np.cumsum(~same[:-1])
    settled = np.bincount(group, known[order], minlength=len(h) + 1) > 0
    out[order] |= settled[group]
    return out


def covered(held: list[bytes], settled: list[bytes], width: int) -> pa.RecordBatch:
    """Spans of words covered by repeated windows, one row per text, from all packs of one partition."""
    squeeze = zstandard.ZstdDecompressor()
    keys, los, his = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for pack in settled:
        x = np.frombuffer(squeeze.decompress(pack), np.int64)
        n = int(x[0])
        each = x[1 + 2 * n : 1 + 3 * n]
        lo, hi = x[1 + 3 * n :].reshape(2, -1)
        keys.append(np.repeat(x[1 : 1 + 2 * n].reshape(-1, 2), each, axis=0))
        los.append(lo)
        his.append(hi)
    opened = [unpacked(squeeze.decompress(p)) for p in held]
    base = np.cumsum([0] + [len(k) for k, _, _ in opened])
    texts = np.concatenate([np.zeros((0, 2), np.int64)] + [k for k, _, _ in opened])
    done = [0] * len(opened)
    for s in range(SUBS):
        portions = [p[s] for _, p, _ in opened]
        words = Words([p for p in portions if p], lines=True)
        if not len(words):
            continue
        place = []
        for i, (p, (_, _, where)) in enumerate(zip(portions, opened)):
            n = p.count(b"\n") + 1 if p else 0
            mine = where[:, done[i] : done[i] + n].astype(np.int64)
            place.append(np.where(mine >= 0, mine + np.array([[base[i]], [0]]), -1))
            done[i] += n
        of, at = np.concatenate(place, axis=1)
        first = np.flatnonzero(np.diff(words.string[: len(words) - width + 1], prepend=-1))  # first word of each string
        inside = np.flatnonzero(words.string[: len(words) - width + 1] == words.string[width - 1 :])
        owner = words.string[inside]
        offset = inside - first[owner]
        flag = repeated_windows(words.line.tobytes(), words.at[inside], words.end[inside + width - 1], words.runs(width)[inside], of[owner] < 0)
        flag &= of[owner] >= 0
        same = np.zeros(len(flag) + 1, bool)
        same[1:-1] = owner[1:] == owner[:-1]
        begin = np.flatnonzero(flag & ~(np.append(False, flag[:-1]) & same[:-1]))
        last = np.flatnonzero(flag & ~(np.append(flag[1:], False) & same[1:]))
        o = owner[begin]
        keys.append(texts[of[o]])
        los.append(at[o] + offset[begin])
        his.append(at[o] + offset[last] + width)
    key, n, lo, hi = merged(np.concatenate(keys), np.concatenate(los), np.concatenate(his))
    flat = np.stack([lo, hi], axis=1).ravel()
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(2 * n))), pa.int32()), pa.array(flat, pa.int64()))
    return pa.record_batch([pa.array(key[:, 0]), pa.array(key[:, 1]), spans], names=["h1", "h2", "spans"])


def hot_minimisers(rows: DataFrame, share: float, width: int, read: Callable[[Iterator[pa.RecordBatch], int], Iterator[Block]] = blocks, levels: tuple[int, ...] = LEVELS) -> tuple[list[np.ndarray], int]:
    """rows, which ``read`` turns into blocks. Per level, the minimisers with this share of all strings or more, ascending (at most 1 / share), and the bytes of all strings.

    A value with such a share has it in some block too. Each block names the values with a quarter of the share, so
    a hot one loses less than a quarter of its count. Only windows of a minimiser that their block names go on to the next
    level, as no other minimiser hands over.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in read(batches, width):
            if not block.valid.any():
                continue
            strings = 0
            for level in range(len(levels)):
                least = block.least(level)
                begin, n = block.strings(least)
                strings = strings or len(begin)
                a, b = block.bytes_of(begin, n)
                value, text = least[begin], block.words.spans(a, b)
                order = np.lexsort((text, value))
                value, text = value[order], text[order]
                once = np.append(True, (value[1:] != value[:-1]) | (text[1:] != text[:-1]))  # equal strings travel once per block
                value, times = np.unique(value[once], return_counts=True)
                often = times * 4 >= share * strings
                named = value[often]
                value, times = np.append(named, np.uint64(0)), np.append(times[often], 0)
                total = np.append(np.zeros(len(times) - 1, np.int64), len(begin))
                size = np.append(np.zeros(len(times) - 1, np.int64), int((b - a).sum()) if level == 0 else 0)
                yield pa.record_batch([pa.array(np.full(len(times), level)), pa.array((value + np.uint64(level)).view(np.int64)), pa.array(times), pa.array(total), pa.array(size)], names=["level", "value", "n", "total", "bytes"])
                if not len(named):
                    break
                mine = np.isin(least[begin], named)
                edge = np.zeros(len(block.valid) + 1, np.int64)
                edge[begin[mine]] += 1
                np.add.at(edge, (begin + n)[mine], -1)
                block.valid &= np.cumsum(edge[:-1]) > 0

    counts = rows.mapInArrow(count, "level long, value long, n long, total long, bytes long").groupBy("level", "value").agg(*[F.sum(c).alias(c) for c in ("n", "total", "bytes")])
    counts = written(counts, "minimisers")  # read twice, made by going through all texts
    total, size = counts.where("level = 0").agg(F.sum("total"), F.sum("bytes")).first()
    found = counts.where(F.col("n") >= max(64, 0.75 * share * (total or 0))).select("level", "value").collect()
    drop_written(counts)
    return [np.sort(np.array([r["value"] for r in found if r["level"] == k], np.int64).view(np.uint64)) for k in range(len(levels))], size or 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, parts: int | None = None, hot_share: float | None = None) -> DataFrame:
    """(id, text, spans): spans are the covered word ranges [a, b) of each text, as a, b, a, b, ...; null if none."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    least_parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.select("h1", "h2", "text")
    hot, size = hot_minimisers(texts, hot_share or 1 / (4 * least_parts), width)
    parts = parts or max(least_parts, -(-size // PART_BYTES))  # by data, if the session's number is too small for it

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, width):
            for p, kind, pack in packs(block, parts, hot):
                yield pa.record_batch([pa.array([p], pa.int32()), pa.array([kind], pa.int32()), pa.array([pack], pa.binary())], names=["part", "kind", "pack"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[bytes], list[bytes]] = ([], [])
        for batch in batches:
            for kind, pack in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held[kind].append(pack)
        if held[0] or held[1]:
            yield covered(*held, width)

    sent = texts.mapInArrow(send, "part int, kind int, pack binary").repartitionById(parts, "part")
    found = sent.mapInArrow(count, "h1 long, h2 long, spans array<long>").groupBy("h1", "h2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    # written, so that the join's two sides come straight from their shuffles and the runtime optimiser can split a hot text
    return rows.join(written(found, "spans"), ["h1", "h2"], "left").select("id", "text", "spans")


def kept_words(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    edge = np.zeros(len(words) + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, texts = [], [], []
            for t, spans in zip(batch.column(1), batch.column(2)):
                words = t.as_py().encode().split()
                found = spans.as_py()
                kept = kept_words(words, list(zip(found[::2], found[1::2]))) if found else words
                total.append(len(words))
                gone.append(len(words) - len(kept))
                texts.append(b" ".join(kept).decode())
            yield pa.record_batch([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return remove_repeats(docs, id_col, text_col, width).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
