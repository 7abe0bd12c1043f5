"""Document fingerprints: improbable-feature digests (after Roussev's similarity digests).

Features are the 16-byte windows of a text, of whatever length: an edit leaves some of them even in short texts.
Each window's entropy falls into one of 1001 classes, and classes are ranked by how rare they are among all
windows of all documents (a table of at most 1001 counts reaches the driver). Every run of as many window starts as
a window has bytes elects its rarest window, and
windows that a quarter of the possible runs elect are selected. A selected window sets 5 bits of a 2048-bit Bloom filter;
after 160 features the next filter of the chain begins. Likeness is the bit overlap beyond chance over
the overlap that was possible, for each filter of the shorter chain against its best counterpart.

The entropy of all windows of a block of texts comes from 15 shifted comparisons of the block with itself:
they count how often the byte that leaves or enters a window occurs in it.

Neighbours in doc_id order: ids are cut into ranges at quantiles; every range gets its rows and,
as a guest, the first row of the next non-empty range, so the text travels once.

Defined cases: null text is empty; an empty text has an empty fingerprint, like only another empty one;
a text without a selected window contributes the first window of its rarest class, one shorter than a window itself,
zero-padded; null ids come first;
repeated ids are ordered by text; a single document is its own neighbour.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import text_or_empty

WINDOW, CLASSES = 16, 1001
FILTER_BITS, FEATURES, HASHES = 2048, 160, 5
#: Classes below this share of the scale are runs of almost one byte and name no text.
LEAST_CLASS = 100
BLOCK_BYTES = 1 << 19

_F = np.round(np.arange(WINDOW + 1) * np.log2(np.maximum(np.arange(WINDOW + 1), 1)) * 65536).astype(np.int64)
_STEP = np.concatenate(([0], np.diff(_F)))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def blocked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One array of all texts, zeros around each; starts and lengths of the texts."""
    pad = bytes(WINDOW)
    x = np.frombuffer(pad + b"".join(t + pad for t in texts) + pad, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = WINDOW + np.concatenate(([0], np.cumsum(lengths + WINDOW)[:-1])).astype(np.int64)
    return x, starts, lengths


def entropy_classes(x: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The entropy class of the window at each start."""
    n = len(x)
    ahead, back = np.ones(n, np.uint8), np.ones(n, np.uint8)
    same = np.empty(n, bool)
    for k in range(1, window):
        eq = np.equal(x[k:], x[:-k], out=same[: n - k]).view(np.uint8)
        ahead[: n - k] += eq
        back[k:] += eq
    first = _F[np.bincount(x[:window], minlength=256)].sum()
    change = _STEP[back[window:]] - _STEP[ahead[: n - window]]
    s = np.concatenate(([first], first + np.cumsum(change)))
    full = int(_F[window])  # of a window of one byte: its entropy is 0
    return (full - s) * (CLASSES - 1) // full


def valid_starts(n: int, starts: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which starts hold a window inside one text."""
    edge = np.zeros(n + 1, np.int64)
    inside = lengths >= window
    np.add.at(edge, starts[inside], 1)
    np.add.at(edge, (starts + lengths - window + 1)[inside], -1)
    return np.cumsum(edge[:n]) > 0


def class_counts(texts: list[bytes]) -> np.ndarray:
    """Windows by class."""
    x, starts, lengths = blocked(texts)
    c = entropy_classes(x)
    return np.bincount(c[valid_starts(len(c), starts, lengths)], minlength=CLASSES)


def class_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank 0 for the rarest class that occurs; CLASSES for those that are never selected."""
    rank = np.full(CLASSES, CLASSES, np.int64)
    used = np.flatnonzero((counts > 0) & (np.arange(CLASSES) >= LEAST_CLASS))
    rank[used[np.lexsort((used, counts[used]))]] = np.arange(len(used))
    return rank


def every_rank(counts: np.ndarray) -> np.ndarray:
    """Ranks of all classes, for texts without a selected window; runs of one byte come last."""
    rank = np.empty(CLASSES, np.int64)
    rank[np.lexsort((np.arange(CLASSES), counts, np.arange(CLASSES) == 0))] = np.arange(CLASSES)
    return rank


def selected(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ranks: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the selected windows and the text of each."""
    c = entropy_classes(x, window)
    n = len(c)
    rank = np.where(valid_starts(n, starts, lengths, window), ranks[c], CLASSES)
    bits = int(n).bit_length()
    kind = np.uint32 if bits + 10 <= 32 else np.uint64
    least = (rank.astype(kind) << kind(bits)) | np.arange(n, dtype=kind)
    k = 1
    while k < window:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    at = least & kind((1 << bits) - 1)
    votes = np.bincount(at[(least >> kind(bits)) < CLASSES].astype(np.int64), minlength=n)
    chosen = np.flatnonzero(votes * 4 >= window)
    return chosen, np.searchsorted(starts, chosen, side="right") - 1


def window_codes(x: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of each window's bytes."""
    words = np.ascontiguousarray(x[starts[:, None] + np.arange(window)]).view(np.uint64)
    h = ((words ^ (words >> np.uint64(29))) * _MIX[: window // 8]).sum(axis=1, dtype=np.uint64) + np.uint64(window)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(mul)
    return h


def rarest_window(text: np.ndarray, every: np.ndarray) -> int:
    """Start of the first window of a text's rarest class; 0 for a text shorter than a window."""
    return int(every[entropy_classes(text)].argmin()) if len(text) >= WINDOW else 0


def digests(texts: list[bytes], ranks: np.ndarray, every: np.ndarray | None = None) -> list[np.ndarray]:
    """The Bloom chain of each text: filters x 256 bytes. every: ranks of all classes, for texts without a selected window."""
    every = np.arange(CLASSES) if every is None else every
    x, starts, lengths = blocked(texts)
    chosen, owner = selected(x, starts, lengths, ranks, WINDOW)
    codes = window_codes(x, chosen, WINDOW)
    bare = np.flatnonzero((np.bincount(owner, minlength=len(texts)) == 0) & (lengths > 0))
    if len(bare):  # their rarest window
        own = np.array([starts[b] + rarest_window(x[starts[b] : starts[b] + lengths[b]], every) for b in bare.tolist()])
        codes, owner = np.concatenate((codes, window_codes(x, own, WINDOW))), np.concatenate((owner, bare))
    order = np.argsort(owner, kind="stable")
    codes, owner = codes[order], owner[order]
    per = np.bincount(owner, minlength=len(texts))
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    filters = -(-per // FEATURES)
    base = np.cumsum(filters) - filters
    of_filter = base[owner] + nth // FEATURES
    table = np.zeros((int(filters.sum()), FILTER_BITS), bool)
    for k in range(HASHES):
        table[of_filter, (codes >> np.uint64(11 * k)).astype(np.int64) & (FILTER_BITS - 1)] = True
    packed = np.packbits(table, axis=1)
    return [packed[b : b + f] for b, f in zip(base, filters)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised bit overlap of two chains, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    na, nb = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    if (len(a), na.sum()) > (len(b), nb.sum()):
        a, b, na, nb = b, a, nb, na
    total = 0.0
    for row, n in zip(a, na):
        both = np.bitwise_count(row & b).sum(axis=1, dtype=np.int64)
        chance = n * nb / FILTER_BITS
        total += n * max(0.0, float(((both - chance) / np.maximum(np.minimum(n, nb) - chance, 1e-9)).max()))
    return min(1.0, total / float(na.sum()))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most key, as a balanced choice."""

    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]).cast("long"), node(lo, mid)).otherwise(node(mid + 1, hi))

    return node(0, len(bounds))


def with_neighbour(rows: DataFrame, ranges: int) -> DataFrame:
    """(part, guest, key, id, text) sorted so that each row's neighbour follows it; rows: (key, id, text)."""
    fractions = [i / ranges for i in range(1, ranges)]
    bounds = rows.select(F.percentile_approx("key", fractions, 10_000)).first()[0] if fractions else []
    bounds = sorted(set(bounds or []))
    part = _range_of(F.col("key"), bounds)
    firsts = rows.select(part.alias("part"), "key").groupBy("part").agg(F.min("key").alias("key")).orderBy("part").collect()  # a row per range
    own = F.struct(part.alias("part"), F.lit(False).alias("guest"))
    places = own
    if firsts:
        host = {r["key"]: firsts[i - 1]["part"] for i, r in enumerate(firsts)}
        table = F.create_map(*[F.lit(v) for k, p in host.items() for v in (k, p)]).cast("map<bigint,int>")
        guest = F.when(F.col("key").isin(list(host)), F.struct(table[F.col("key")].alias("part"), F.lit(True).alias("guest")))
        places = F.explode(F.array_compact(F.array(own, guest)))
    else:
        places = F.explode(F.array(own))
    spread = rows.select(places.alias("place"), "key", "id", "text").select("place.part", "place.guest", "key", "id", "text")
    return spread.repartition("part").sortWithinPartitions("part", "guest", "key", "text")


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row."""
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("key"), F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        block: list[bytes] = []
        size = 0
        for batch in batches:
            for t in batch.column(0):
                block.append(t.as_py().encode())
                size += len(block[-1])
                if size >= BLOCK_BYTES:
                    total += class_counts(block)
                    block, size = [], 0
        if block:
            total += class_counts(block)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["class", "n"])

    counts = np.zeros(CLASSES, np.int64)
    for r in rows.select("text").mapInArrow(count, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():  # at most CLASSES rows
        counts[r["class"]] = r["n"]
    ranks, every = class_ranks(counts), every_rank(counts)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # (id, text) rows whose neighbour is the next of the list
        size, now = 0, None

        def done() -> pa.RecordBatch:
            texts = [t for _, t in waiting]
            halves = [len(t) // 2 for t in texts[:-1]]
            edited = [(t[: len(t) - h] + after[:h]).encode() for t, h, after in zip(texts, halves, texts[1:])]
            raw = [t.encode() for t in texts]
            made = digests(raw + edited, ranks, every)
            own, other = made[: len(raw)], made[len(raw) :]
            out = [
                [i for i, _ in waiting[:-1]],
                [len(t) for t in texts[:-1]],
                [hashlib.sha256(e).hexdigest() for e in edited],
                [base64.b64encode(f.tobytes()).decode() for f in own[:-1]],
                [base64.b64encode(f.tobytes()).decode() for f in other],
                [likeness(a, b) for a, b in zip(own, other)],
                [likeness(a, b) for a, b in zip(own, own[1:])],
            ]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

        for batch in batches:
            for part, guest, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                if part != now:
                    waiting, size, now = [], 0, part
                if guest and not waiting:
                    continue  # a further row of the guest's id
                waiting.append((i, text.as_py()))
                size += len(waiting[-1][1])
                if guest:
                    yield done()
                    waiting = []
                elif size >= BLOCK_BYTES // 2 and len(waiting) > 1:
                    yield done()
                    waiting = waiting[-1:]
                    size = len(waiting[0][1])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_neighbour(rows, ranges).mapInArrow(run, schema)
