"""What the operators of this subpackage share: table readers, words, shared-folder tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_crc_mod(col: str, n: int) -> Column:
    """crc32 of the id's decimal digits, modulo n; of no digits where there is no id, which is 0."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one named by spark.checkpoint.dir.

    Where none is named, a local session, whose executors are the driver itself, gets one; a cluster gets an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "tallyloom-checkpoints"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder, once, and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Removes a table made by written() once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# ---- arrays as bytes, inside tasks ---------------------------------------------------------------


def planes(*arrays: np.ndarray) -> bytes:
    """Arrays of integers (negative ones take all eight bytes) as byte planes, which compress well."""
    head, body = [len(arrays)], []
    for x in arrays:
        x = np.ascontiguousarray(x).astype("<u8")
        width = (int(x.max(initial=0)).bit_length() + 7) // 8
        head += [len(x), width]
        body.append(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return np.array(head, "<i8").tobytes() + b"".join(body)


def unplaned(raw: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for size, width in sizes.tolist():
        x = np.zeros((size, 8), np.uint8)
        x[:, :width] = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        out.append(x.view("<i8").ravel())
        at += size * width
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """An ascending array by its differences."""
    return np.diff(x, prepend=0)


# ---- words as arrays, inside tasks ---------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed_bits(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _power(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n of each; kept per process."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table, out=table)
    return _powers


class Words:
    """The words of some texts, joined by single blanks in ``line``.

    at, end: a word's bytes in line; first, lengths: a text's words. With lines, texts are strings one to a
    line (words parted by one blank), and ``string`` numbers the string of each word.
    """

    def __init__(self, texts: list[bytes], lines: bool = False):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = _SPACE[raw]
        before = np.empty_like(space)
        before[0], before[1:] = True, space[:-1]
        begin = np.flatnonzero(before & ~space)
        end = np.flatnonzero(space & ~before)
        if lines:
            self.line, self.at, self.end = raw, begin, end
            new = raw[end] == 10
            self.string = np.cumsum(new) - new
        else:
            bounds = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
            upto = np.searchsorted(begin, bounds)
            self.lengths = np.diff(upto, prepend=0)
            self.first = upto - self.lengths
            keep = ~space
            keep[end] = True
            self.line = raw[keep]
            size = end - begin
            self.end = np.cumsum(size + 1) - 1
            self.at = self.end - size
            self.line[self.end] = 32

    _prefix = None

    def _summed(self) -> None:
        """Prefix sums for hashes, made when the first one is asked for."""
        if self._prefix is None:
            power, self._back = _power(len(self.line) + 1)
            prefix = np.zeros(len(self.line) + 1, np.uint64)
            np.cumsum((self.line.astype(np.uint64) + np.uint64(1)) * power[: len(self.line)], out=prefix[1:])
            self._prefix = prefix

    def __len__(self) -> int:
        return len(self.at)

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes a to b of line: a polynomial modulo 2^64 from prefix sums, mixed."""
        self._summed()
        return mixed_bits((self._prefix[b] - self._prefix[a]) * self._back[a])

    def runs(self, m: int) -> np.ndarray:
        """The hash of each run of m words."""
        n = len(self) - m + 1
        return self.spans(self.at[:n], self.end[m - 1 :]) if n > 0 else np.zeros(0, np.uint64)


class Bytes(Words):
    """The same over single bytes: texts follow each other in ``line`` without blanks."""

    def __init__(self, texts: list[bytes]):
        self.line = np.frombuffer(b"".join(texts), np.uint8)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.cumsum(self.lengths) - self.lengths
        self.at = np.arange(len(self.line))
        self.end = self.at + 1

    def runs(self, m: int) -> np.ndarray:
        self._summed()
        n = len(self) - m + 1
        return mixed_bits((self._prefix[m:] - self._prefix[:n]) * self._back[:n]) if n > 0 else np.zeros(0, np.uint64)
