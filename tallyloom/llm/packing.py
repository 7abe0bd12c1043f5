"""Cost-balanced packing of token streams into fixed-length training sequences.

A document's attention cost is estimated as linear + quadratic in its length. Whole sequences are
cut off long documents first; what is left, in descending length, goes to the sequence of lowest
cost that still holds it. A piece that no sequence holds whole is cut at the room of the
cheapest sequence that has any, and its rest is dealt on in turn, so every sequence is filled.

Packing runs inside each map task over groups of about ``group_tokens`` tokens: no shuffle, memory
bounded by the group, and a retried task repeats the same ids. Only the last sequence of a
group can be short; it is opened as its binary parts (1024, 512, ...), lengths that need no padding.

Ids come from the byte-level BPE vocabulary in ``vocabulary``; the same merges are run by the
faster tiktoken engine, and by tokenizers itself for a text that holds a special token's string.

Defined cases: null or empty text is its end id alone, one piece of length 1; repeated rows are
packed one by one; documents longer than a sequence are cut; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import text_or_empty

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=4)
def encoder(vocabulary: str, ranks: str):
    """text -> uint32 ids; vocabulary and ranks: two files of one vocabulary."""
    import base64

    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path(vocabulary))
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    with open(public.path(ranks), "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(ranks, pat_str=public.PATTERN, mergeable_ranks=merges, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(fast.encode_to_numpy(text), np.uint32)

    return encode


def balance(lengths: list[int], full: int, a: float, b: float) -> list[tuple[int, int, int, int, int]]:
    """(item, start in item, length, sequence, offset) of items in sequences of at most full tokens.

    Sequences are numbered from 0; all have full tokens but the parts of the last.
    """
    out: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []  # (-length, item, start)
    seq = 0
    for i, n in enumerate(lengths):
        for s in range(0, n - full + 1, full):
            out.append((i, s, full, seq, 0))
            seq += 1
        if n % full:
            rest.append((-(n % full), i, n - n % full))
    total = -sum(x[0] for x in rest)
    room = np.array([full] * (total // full) + [1 << k for k in range(full.bit_length() - 1, -1, -1) if total % full >> k & 1], np.int64)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    heapq.heapify(rest)
    while rest:
        minus, item, start = heapq.heappop(rest)
        n = -minus
        for least in (n, 1):
            fits = np.flatnonzero(room >= least)
            if len(fits):
                break
        k = int(fits[np.argmin(cost[fits])])
        take = min(n, int(room[k]))
        out.append((item, start, take, seq + k, int(used[k])))
        room[k] -= take
        used[k] += take
        cost[k] += a * take + b * take * take
        if take < n:
            heapq.heappush(rest, (take - n, item, start + take))
    return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence_tokens: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    group_tokens: int = 1 << 22,
    vocabulary: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """One row per piece; see SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        first = TaskContext.get().partitionId() << 32
        ids: list = []
        streams: list[np.ndarray] = []
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal first, held
            pieces = balance([len(s) for s in streams], sequence_tokens, linear, quadratic)
            cols = list(zip(*pieces))
            crc = [zlib.crc32(streams[i][s : s + n]) for i, s, n, _, _ in pieces]
            out = pa.record_batch(
                [
                    pa.array([ids[i] for i in cols[0]], pa.int64()),
                    pa.array(cols[1], pa.int64()),
                    pa.array(cols[2], pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array([len(streams[i]) for i in cols[0]], pa.int64()),
                    pa.array([first + q for q in cols[3]], pa.int64()),
                    pa.array(cols[4], pa.int64()),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            first += max(cols[3]) + 1
            ids.clear()
            streams.clear()
            held = 0
            return out

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                streams.append(np.append(encode(text.as_py()), np.uint32(end_id)))
                held += len(streams[-1])
                if held >= group_tokens:
                    yield packed()
        if streams:
            yield packed()

    return docs.select(F.col(id_col).cast("long"), text_or_empty(text_col)).mapInArrow(run, SCHEMA)
