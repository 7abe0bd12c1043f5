"""Secret scans: assignments, access keys, hex runs, and a token-efficiency test.

The test encodes candidate runs with a tiktoken vocabulary: text that people write packs many
characters into a token, random strings few. A candidate that holds a letter (others are numbers, dates
or rules) and whose characters per token fall below ``ratio`` is reported as kind ``random``, unless it
is a known digest (pure hex of a usual digest length), a UUID, or an identifier: words joined by _ - or
case, with up to four closing digits, of which each is efficiently tokenised by itself.

Defined cases: null text is empty and has no spans; offsets are code points, end exclusive;
overlapping kinds are all reported; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import text_or_empty

KINDS = ("assign", "access", "hex", "random")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Names in either case of ASCII letters, spelt out so that the matcher can skip by first letter.
_NAMES = "|".join(["[pP][aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD])", _either_case("secret"), _either_case("token"), "[aA][pP][iI]_?[kK][eE][yY]"])
ASSIGN = re.compile(rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")  # what stands before an = is a name, not a part
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))
PURE_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
IDENTIFIER = re.compile(r"[A-Za-z]+(?:[_-][A-Za-z]+)*(?:[_-]?[0-9]{1,4})?")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")  # of an identifier
LEAST_WORD = 3  # random letters in either case fall into parts of one or two, many of which are tokens


@lru_cache(maxsize=2)
def tiktoken_encoder(ranks: str):
    import base64

    import public_tokenizers as public
    import tiktoken

    with open(public.path(ranks), "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(ranks, pat_str=public.PATTERN, mergeable_ranks=merges, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the three fixed kinds."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # a maximal run that is shorter than 32 is dropped, so only runs of 32 and more need finding
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def identifier(run: str, encode, ratio: float) -> bool:
    return bool(IDENTIFIER.fullmatch(run)) and all(len(w) >= LEAST_WORD and len(w) >= ratio * len(encode(w)) for w in PART.findall(run))


def random_spans(text: str, ranks: str, ratio: float) -> list[tuple[int, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if not any(c.isalpha() for c in s) or (PURE_HEX.fullmatch(s) and len(s) in DIGEST_LENGTHS) or UUID.fullmatch(s):
            continue
        encode = tiktoken_encoder(ranks).encode_ordinary
        if len(s) < ratio * len(encode(s)) and not identifier(s, encode, ratio):
            out.append((m.start(), 3, m.end()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = "byte_bpe_50k.tiktoken", ratio: float = 2.0) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_random, base_spans, spans) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py()
                base = base_spans(text)
                more = random_spans(text, ranks, ratio)
                n = [sum(x[1] == k for x in base) for k in range(3)]
                rows.append((*n, len(more), joined(base), joined(base + more)))
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.record_batch(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_spans", "spans"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_spans string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)
