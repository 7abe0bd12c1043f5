"""SimHash near-dedup over an inverted index of byte positions.

Fingerprint: 64 majority bits over the XXH64 hashes of all word shingles, repeats included.

Search: fingerprints at most ``radius`` bits apart agree in at least 8 - radius of their 8 bytes.
Posting lists are keyed by ``key_bytes`` byte positions with their values; the position sets are
chosen so that any 8 - radius positions contain one of them (a Turan covering), so each linked
pair meets in a list. Within a list the bytes shared per pair are tallied over all eight positions, pairs with
the guaranteed minimum are retained, and the retained ones verified by their differing bits. Lists longer than
``long_list`` are split, without loss, by one position more.

Hot lists: only distinct fingerprints enter the index, so exact copies cost one row. A list is
searched breadth-first against what it has not reached yet, and only the links of a spanning
forest leave it: rows grow linearly with a group of near copies, never with its pairs.
Classes are then joined by connected components (see components.py).

Defined cases: null text is empty; no words give fingerprint 0, linked like any other; fewer words
than a shingle are one shingle; a null id takes part but names no class; repeated rows share a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import text_or_empty, written
from tallyloom.llm.components import components


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), seed)]
    else:
        line = b" ".join(words)
        # shingle i is a slice of the joined words
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
        hashes = [xxh64_intdigest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bit j is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):  # big-endian: bit 0 of the row is the highest
        part = hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fps)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def position_sets(radius: int, key_bytes: int) -> list[tuple[int, ...]]:
    """Byte-position sets, key_bytes each, such that any 8 - radius positions contain one.

    Triples for any four positions follow Turan's construction: the positions are dealt into three
    parts on a ring, and a triple is taken if it lies in one part or has two in a part and one in the next
    (20 of 56). Other cases take all sets.
    """
    every = list(combinations(range(8), key_bytes))
    if key_bytes != 3 or radius != 4:
        return every if key_bytes <= 8 - radius else list(combinations(range(8), 8 - radius))
    part = [0, 0, 0, 1, 1, 1, 2, 2]
    chosen = []
    for t in every:
        n = [sum(part[p] == k for p in t) for k in range(3)]
        if max(n) == 3 or any(n[k] == 2 and n[(k + 1) % 3] == 1 for k in range(3)):
            chosen.append(t)
    return chosen


_LOW, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many byte positions two fingerprints share, from their exclusive or: its zero bytes."""
    return 8 - np.bitwise_count((((x & _LOW) + _LOW) | x) & _HIGH).astype(np.int64)


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Count filter, then verification of what it retains: at least 8 - radius shared bytes, at most radius differing bits."""
    x = a ^ b
    retained = shared_bytes(x) >= 8 - radius
    retained[retained] = np.bitwise_count(x[retained]) <= radius
    return retained


def list_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of one posting list of distinct fingerprints (uint64)."""
    todo = fps.copy()
    out: list[tuple[int, int]] = []
    while len(todo):
        front, todo = [todo[0]], todo[1:]
        while front and len(todo):
            node = front.pop()
            hit = _near(todo, node, radius)
            if hit.any():
                found = todo[hit]
                out += [(int(node), int(f)) for f in found]
                front += list(found)
                todo = todo[~hit]
    return out


def postings_links(keys: np.ndarray, fps: np.ndarray, radius: int, small: int = 32) -> np.ndarray:
    """Links (k x 2, uint64) of posting lists given as parallel arrays, sorted by key."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    found = [np.zeros((0, 2), np.uint64)]
    in_small = np.repeat(sizes <= small, sizes)
    k, f = keys[in_small], fps[in_small]
    for d in range(1, small):
        same = np.flatnonzero(k[d:] == k[:-d]) if len(k) > d else np.zeros(0, np.int64)
        if not len(same):
            break
        a, b = f[same], f[same + d]
        ok = _near(a, b, radius)
        found.append(np.stack([a[ok], b[ok]], axis=1))
    for s, n in zip(starts[sizes > small], sizes[sizes > small]):
        links = list_links(fps[s : s + n], radius)
        if links:
            found.append(np.array(links, np.uint64))
    return np.concatenate(found)


def _byte(p: int) -> Column:
    return F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(F.lit(255))


def _keys(sets: list[tuple[int, ...]], first: int) -> list[Column]:
    """A key per position set: its number, then the bytes."""
    out = []
    for number, positions in enumerate(sets, first):
        key = F.lit(number).cast("long")
        for p in positions:
            key = key * 256 + _byte(p)
        out.append(key)
    return out


def postings(distinct: DataFrame, radius: int = 4, key_bytes: int = 3, long_list: int = 50_000) -> DataFrame:
    """(key, fp): each fingerprint in the list of every position set.

    Pairs share one byte position more than a key names (if 8 - radius allows), so a list longer than ``long_list`` is
    replaced, without loss, by the lists of its key and each further position.
    """
    sets = position_sets(radius, key_bytes)
    posted = distinct.select("fp", F.posexplode(F.array(*_keys(sets, 0))).alias("set", "key"))
    if len(sets[0]) >= 8 - radius:
        return posted.select("key", "fp")
    hot = written(posted.groupBy("key").count().where(F.col("count") > long_list).select("key", F.lit(True).alias("hot")), "long-lists")
    marked = posted.join(hot, "key", "left")
    # the key that a set and one more position make; sets are numbered on from the first
    wider = [[tuple(sorted({*s, p})) for p in range(8) if p not in s] for s in sets]
    names = sorted({w for ws in wider for w in ws})
    number = {w: k for k, w in enumerate(names)}
    choice = F.coalesce(*[F.when(F.col("set") == k, F.array(*[_keys([w], len(sets) + number[w])[0] for w in ws])) for k, ws in enumerate(wider)])
    return marked.select(F.explode(F.when(F.col("hot"), choice).otherwise(F.array("key"))).alias("key"), "fp").distinct()


def near_links(distinct: DataFrame, radius: int = 4, key_bytes: int = 3, long_list: int = 50_000) -> DataFrame:
    """(u, v): links between distinct fingerprints (fp), enough to connect all that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds whole lists, sorted by key; a list may span batches."""
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def links(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            out = postings_links(k, f, radius).view(np.int64)
            return pa.record_batch([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["u", "v"])

        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            fps = np.concatenate((fps, batch.column(1).to_numpy().view(np.uint64)))
            if len(keys) > 200_000 and (whole := int(np.searchsorted(keys, keys[-1]))):  # all lists but the last are complete
                yield links(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield links(keys, fps)

    # fp last in the order: the same lists in the same order on every run
    return postings(distinct, radius, key_bytes, long_list).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "u long, v long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, key_bytes: int = 3) -> DataFrame:
    """(id, fp, component_id) for each row of docs."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("id").alias("least"))
    classes = components(near_links(distinct.select("fp"), radius, key_bytes))
    named = distinct.join(classes, distinct.fp == classes.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    # written, so that both sides of the joins come straight from a shuffle and the runtime optimiser can split a component
    # or a fingerprint that a third of all rows share
    least = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    named = named.join(least, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("id", "fp", "component_id")
