"""Language-model scoring by a hierarchical Pitman-Yor process over pairs of words.

Model. Every word that occurs, and the end of a text, is a *context restaurant* that serves the words that follow it
(the end is followed by the first word of a text). All context restaurants share one parent, the *word restaurant*,
whose base measure is even over the V training words and one unknown word. A text's probability is that of its
lower-cased words and one end token, each given the token before it:

    P(w | u) = (c_uw - d t_uw + (s + d T_u) P(w)) / (s + c_u),   P(w) = (C_w - d' t_w + (s + d' T) / (V + 1)) / (s + C)

with customers c and tables t of each (context, word), C_w the tables of all contexts that serve w, and so on. All figures
of a sample come from one state, so the P(. | u) of every context sum to 1 over the V words and the unknown one.

Sampling (see pitman_yor.py). A round seats all customers of all contexts again, given the word restaurant, then those
of the word restaurant, given all tables below it; predictive probabilities are averaged over the last rounds' samples. Draws are
hashes of words, so neither partitions nor retries change a score.

Distribution. Texts are read once, into blocks of word numbers; a block table keeps them, bucketed by block. What a step
works on stays in such tables, bucketed by the key that joins it, and only messages are shuffled:

* words are dealt by hash, but told apart by their bytes: their counts are summed and they get numbers (rank and bucket in one);
* pairs of neighbours are dealt by a hash of both words, so no frequent word makes a task large; a block sends each
  distinct pair once, with its count;
* each round, pair buckets send tables per word (as context and as word), word buckets answer with the sums;
* blocks get the figures of their words and pairs, and sum their documents' logarithms.

What reaches the driver are sums that Spark has added up: nine numbers at most, whatever the size of the corpus.

Defined cases: null text is empty and holds its end token alone; no training rows: every word is unknown; rows that
repeat an id are scored one by one; very long texts are one block; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import pitman_yor as process
from tallyloom.llm.common import Words, drop_written, planes, shared_dir, steps, text_or_empty, unplaned, written

BLOCK_BYTES = 4 << 20
BUCKET_TOKENS = 1 << 23  # tokens of the corpus per bucket of words
PAIR_TOKENS = 1 << 22  # and per bucket of pairs: each packet names its words, so few large buckets send less
CONTEXT_DRAWS, WORD_DRAWS, PARENT_DRAWS = 1000, 2000, 3000  # numbers of draws, apart from those of the sweeps
END = 0  # the end token's number among a block's words, which are in order: it is the empty word
ROWS = "kind string, at long, to long, blob binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


# ---- arrays as bytes ------------------------------------------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of integers from 0, by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(planes(*arrays))


def unpacked(blob: bytes) -> list[np.ndarray]:
    return unplaned(zstandard.ZstdDecompressor().decompress(blob))


def with_words(words: list[bytes], *arrays: np.ndarray) -> bytes:
    """Words in order and arrays, compressed."""
    head = planes(*arrays)
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(8, "little") + head + b"\n".join(words))


def words_and(blob: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    upto = 8 + int.from_bytes(raw[:8], "little")
    arrays = unplaned(raw[8:upto])
    return raw[upto:].split(b"\n") if len(arrays[0]) else [], arrays


# ---- blocks of texts ------------------------------------------------------------------------------


class Block:
    """Documents as tokens: numbers in ``vocab``, ascending; document k has lengths[k] of them, its end last."""

    def __init__(self, vocab: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, ids: np.ndarray, none: np.ndarray, held: np.ndarray):
        self.vocab, self.tokens, self.lengths, self.ids, self.none, self.held = vocab, tokens, lengths, ids, none, held

    @classmethod
    def of(cls, rows: list[tuple]) -> tuple[Block, list[bytes]]:
        """rows: (id, held out, text). The block's words, in order of their bytes, and the block in their numbers."""
        words = Words([r[2].encode().lower() for r in rows])
        # the words with the blank behind each, as one Arrow array, whose values are compared as bytes
        offsets = pa.py_buffer(np.append(words.at, len(words.line)).astype(np.int32).tobytes())
        coded = pa.Array.from_buffers(pa.binary(), len(words), [None, offsets, pa.py_buffer(words.line.tobytes())]).dictionary_encode()
        found = [w[:-1] for w in coded.dictionary.to_pylist()]
        order = sorted(range(len(found)), key=found.__getitem__)
        number = np.empty(len(found), np.int64)
        number[order] = np.arange(1, len(found) + 1)
        lengths = words.lengths + 1
        ends = np.cumsum(lengths) - 1
        tokens = np.full(int(lengths.sum()), END, np.int64)
        is_word = np.ones(len(tokens), bool)
        is_word[ends] = False
        tokens[is_word] = number[coded.indices.to_numpy()]
        ids = np.array([r[0] or 0 for r in rows], np.int64)
        block = cls(np.arange(len(found) + 1), tokens, lengths, ids, np.array([r[0] is None for r in rows]), np.array([bool(r[1]) for r in rows]))
        return block, [b"", *[found[k] for k in order]]

    def arrays(self) -> list[np.ndarray]:
        """Tokens as ranks by frequency, which are small numbers; the counts give the order back."""
        count = np.bincount(self.tokens, minlength=len(self.vocab))
        rank = np.empty(len(count), np.int64)
        rank[np.lexsort((np.arange(len(count)), -count))] = np.arange(len(count))
        return [steps(self.vocab), count, rank[self.tokens], self.lengths, self.ids.view(np.uint64), self.none, self.held]

    def blob(self) -> bytes:
        return packed(*self.arrays())

    @classmethod
    def from_arrays(cls, vocab, count, ranks, lengths, ids, none, held) -> Block:
        order = np.lexsort((np.arange(len(count)), -count))
        return cls(np.cumsum(vocab), order[ranks], lengths, ids, none.astype(bool), held.astype(bool))

    @classmethod
    def from_blob(cls, blob: bytes) -> Block:
        return cls.from_arrays(*unpacked(blob))

    def training(self) -> np.ndarray:
        """Per token, whether it is learned from."""
        return np.repeat(~self.held, self.lengths)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (context, word), ascending, by place in vocab; how often each is learned from; each token's pair."""
        context = np.empty_like(self.tokens)
        context[1:] = self.tokens[:-1]
        context[:1] = self.tokens[-1:]  # a block ends with an end token
        n = len(self.vocab)
        pair, of = np.unique(context * n + self.tokens, return_inverse=True)
        return pair // n, pair % n, np.bincount(of, self.training(), len(pair)).astype(np.int64), of


def buckets_of(words: list[bytes], n: int) -> np.ndarray:
    """Each word's bucket, by a hash of its bytes; the end token's is 0. words: as in a block, the empty one first."""
    w = Words([b" ".join(words)])
    return np.append(np.zeros(1, np.int64), (w.spans(w.at, w.end) % np.uint64(n)).astype(np.int64))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, list[bytes]]]:
    rows, size = [], 0
    for batch in batches:
        for i, held, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            rows.append((i, held, t.as_py()))
            size += len(rows[-1][2]) + 1
            if size >= BLOCK_BYTES:
                yield Block.of(rows)
                rows, size = [], 0
    if rows:
        yield Block.of(rows)


def dealt(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of keys % n, places ascending."""
    bucket = keys % n
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
        yield int(bucket[part[0]]), part


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (process.keys(u, w, 0) >> np.uint64(1)).astype(np.int64)


# ---- tables and messages --------------------------------------------------------------------------


class Table:
    """Rows (kind, at, to, blob) in the shared folder, by kind, bucketed by at: what is joined by at need not move."""

    def __init__(self, df: DataFrame, buckets: int):
        self.spark, self.name = df.sparkSession, f"lm_{uuid.uuid4().hex}"
        self._written_path = f"{shared_dir(self.spark)}/{self.name}"
        try:
            df.write.partitionBy("kind").bucketBy(buckets, "at").option("path", self._written_path).saveAsTable(self.name)
        except Exception:
            self.drop()
            raise

    def rows(self, kind: str) -> DataFrame:
        return self.spark.table(self.name).where(F.col("kind") == kind).select("at", "to", "blob")

    def sums(self) -> list[int]:
        """What the rows of the kind "sums" add up to, by their place."""
        got = self.spark.table(self.name).where("kind = 'sums'").groupBy("at").agg(F.sum("to").alias("n")).collect()
        return [r["n"] for r in sorted(got, key=lambda r: r["at"])]

    @property
    def sparkSession(self):
        return self.spark

    def drop(self) -> None:
        """Once nothing reads it any more; a second time does nothing."""
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            drop_written(self)
            self.name = ""


def gathered(messages: DataFrame) -> DataFrame:
    """(at, got): what was sent to each place, with its senders."""
    return messages.groupBy(F.col("to").alias("at")).agg(F.collect_list(F.struct("at", "blob")).alias("got"))


def step(f: Callable, states: list[DataFrame], got: DataFrame, schema: str = ROWS) -> DataFrame:
    """f(at, blobs of the states, {sender: message}) for every row of the first state; without states, of got.

    f yields (kind, to, blob), or ("sums", None, figures); with another schema, record batches.
    """
    df = None
    for k, s in enumerate(states):
        one = s.select("at", F.col("blob").alias(f"s{k}"))
        df = one if df is None else df.join(one, "at", "left")
    df = got if df is None else df.join(got, "at", "left")
    n = len(states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                at = batch.column(0)[i].as_py()
                sent = {m["at"]: m["blob"] for m in batch.column(n + 1)[i].as_py() or []}
                rows = f(at, [batch.column(k + 1)[i].as_py() for k in range(n)], sent)
                if schema != ROWS:
                    yield from rows
                    continue
                for kind, to, blob in rows:
                    yield sum_rows(blob) if kind == "sums" else one_row(kind, at, to, blob)

    return df.select("at", *[f"s{k}" for k in range(n)], "got").mapInArrow(run, schema)


def one_row(kind: str, at: int, to: int, blob: bytes) -> pa.RecordBatch:
    return pa.record_batch([pa.array([kind]), pa.array([at]), pa.array([to]), pa.array([blob], pa.binary())], names=["kind", "at", "to", "blob"])


def sum_rows(figures: list[int]) -> pa.RecordBatch:
    """Figures to be added up by Spark, each by its place."""
    n = len(figures)
    return pa.record_batch([pa.array(["sums"] * n), pa.array(range(n), pa.int64()), pa.array([int(x) for x in figures], pa.int64()), pa.array([None] * n, pa.binary())], names=["kind", "at", "to", "blob"])


def raw_block(blob: bytes) -> tuple[Block, list[bytes]]:
    words, arrays = words_and(blob)
    return Block.from_arrays(*arrays), words


def of_blocks(table: DataFrame, f: Callable, opened: Callable = lambda blob: (Block.from_blob(blob),)) -> DataFrame:
    """f(block) for every block: yields (kind, to, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                for kind, to, out in f(*opened(blob.as_py())):
                    yield one_row(kind, at, to, out)

    return table.select("at", "blob").mapInArrow(run, ROWS)


# ---- the job --------------------------------------------------------------------------------------


def scored(
    docs: DataFrame,
    held_out,
    id_col: str = "doc_id",
    text_col: str = "text",
    strength: float = 1.0,
    burn_in: int = 1,
    samples: int = 3,
    buckets: int | None = None,
) -> DataFrame:
    """One row per row of docs; held_out: a boolean column, true for rows not learned from."""
    spark = docs.sparkSession
    parts = max(1, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    s = strength
    made: list[Table] = []

    def table(df: DataFrame) -> Table:
        made.append(Table(df, parts))
        return made[-1]

    try:
        return _scored(docs, held_out, id_col, text_col, s, burn_in, samples, table)
    finally:  # after a failure, too
        for t in made:
            t.drop()


def _scored(docs: DataFrame, held_out, id_col: str, text_col: str, s: float, burn_in: int, samples: int, table: Callable[[DataFrame], Table]) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), text_or_empty(text_col).alias("text"))

    # 1. texts to blocks; words are numbered: rank in their bucket times the number of buckets, plus the bucket.
    # That number comes from the data alone, as draws depend on the words' numbers.

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 24
        for block, words in blocks(batches):
            yield one_row("block", at, at, with_words(words, *block.arrays()))
            yield sum_rows([len(block.tokens)])
            at += 1

    raw = table(rows.mapInArrow(read, ROWS))
    tokens = sum(raw.sums())
    word_buckets = pair_buckets = 4
    while word_buckets * BUCKET_TOKENS < tokens:
        word_buckets *= 2
    while pair_buckets * PAIR_TOKENS < tokens:
        pair_buckets *= 2

    def ask_numbers(block: Block, words: list[bytes]):
        count = np.bincount(block.tokens, block.training(), len(block.vocab)).astype(np.int64)
        for to, mine in dealt(buckets_of(words, word_buckets), word_buckets):
            yield "ask", to, with_words([words[k] for k in mine.tolist()], count[mine])

    def number(at, _, got):
        """Words get their rank among the bucket's, in order of their bytes."""
        asked = {sender: words_and(m) for sender, m in got.items()}
        rank = {w: k for k, w in enumerate(sorted({w for words, _ in asked.values() for w in words}))}
        count = np.zeros(len(rank), np.int64)
        for sender, (words, (n,)) in asked.items():
            of = np.fromiter(map(rank.__getitem__, words), np.int64, len(words))
            count[of] += n
            yield "numbers", sender, packed(steps(of))
        yield "words", at, packed(count)

    numbered = table(step(number, [], gathered(of_blocks(raw.rows("block"), ask_numbers, raw_block))))

    def renumber(at, states, got):
        block, words = raw_block(states[0])
        new = np.empty_like(block.vocab)
        for bucket, mine in dealt(buckets_of(words, word_buckets), word_buckets):
            new[mine] = np.cumsum(unpacked(got[bucket])[0]) * word_buckets + bucket
        order = np.argsort(new)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        yield "block", at, Block(new[order], place[block.tokens], block.lengths, block.ids, block.none, block.held).blob()

    texts = table(step(renumber, [raw.rows("block")], gathered(numbered.rows("numbers"))))
    raw.drop()

    # 2. pairs meet; the first state has one table for each

    def send_pairs(block: Block):
        u, w, count, _ = block.pairs()
        for to, mine in dealt(pair_keys(block.vocab[u], block.vocab[w]), pair_buckets):
            used, of = np.unique(np.concatenate((u[mine], w[mine])), return_inverse=True)
            yield "pairs", to, packed(steps(block.vocab[used]), steps(of[: len(mine)]), of[len(mine) :], count[mine])

    def to_words(ids: np.ndarray, *figures: np.ndarray):
        for to, mine in dealt(ids, word_buckets):
            yield "tables", to, packed(steps(ids[mine] // word_buckets), *[x[mine] for x in figures])

    def meet(at, _, got):
        sent = {sender: unpacked(m) for sender, m in got.items()}
        ids, of = np.unique(np.concatenate([np.cumsum(x[0]) for x in sent.values()]), return_inverse=True)
        n, begin, every = len(ids), 0, []
        for x in sent.values():
            mine = of[begin : begin + len(x[0])]
            begin += len(x[0])
            every.append(mine[np.cumsum(x[1])] * n + mine[x[2]])
        pair, of = np.unique(np.concatenate(every), return_inverse=True)
        count = np.bincount(of, np.concatenate([x[3] for x in sent.values()]), len(pair)).astype(np.int64)
        u, w = pair // n, pair % n
        once, more = count == 1, count > 1
        figures = [np.bincount(x[which], minlength=n) for which in (once, more) for x in (u, w)]
        busy = (figures[2] + figures[3]) > 0  # words of pairs that are seated anew in each round
        place = np.cumsum(busy) - 1
        yield "state", at, packed(steps(ids[busy]), count, steps(place[u[more]]), place[w[more]])
        begin = 0
        for sender, x in zip(sent, every):
            yield "places", sender, packed(steps(of[begin : begin + len(x)]))
            begin += len(x)
        seen = sum(figures) > 0
        yield from to_words(ids[seen], *[x[seen] for x in figures])
        yield "sums", None, [once.sum(), (count == 2).sum()]

    pairs = table(step(meet, [], gathered(of_blocks(texts.rows("block"), send_pairs))))
    d = process.discount(*(pairs.sums() or [0, 0]))

    def begin_words(at, states, got):
        (count,) = unpacked(states[0])
        base = np.zeros((2, len(count)), np.int64)  # tables of pairs that occur once, as context and as word
        extra = np.zeros_like(base)
        sent = {sender: unpacked(m) for sender, m in got.items()}
        for x in sent.values():
            place = np.cumsum(x[0])
            for k in range(2):
                base[k, place] += x[1 + k]
                extra[k, place] += x[3 + k]
        under, guests = base + extra
        tables = np.minimum(guests, 1)
        yield "words", at, packed(count, *base)
        yield "seating", at, packed([], [])
        for sender, x in sent.items():
            place = np.cumsum(x[0])[(x[3] + x[4]) > 0]
            yield "figures", sender, packed(under[place], guests[place], tables[place])
        yield "sums", None, [(count > 0).sum(), count.sum(), guests.sum(), tables.sum(), (guests == 1).sum(), (guests == 2).sum()]

    words = table(step(begin_words, [numbered.rows("words")], gathered(pairs.rows("tables"))))
    numbered.drop()
    v, n, guests, tables, ones, twos = words.sums() or [0] * 6
    d_words = process.discount(ones, twos)

    def parent(guests_of, tables_of, total):
        """P(w) under the word restaurant; total: its customers and tables."""
        return (guests_of - d_words * tables_of + (s + d_words * total[1]) / (v + 1)) / (s + total[0])

    # 3. rounds: first the contexts, given the word restaurant, then the word restaurant

    def contexts_round(number: int, draws: int, total: tuple[int, int]):
        def seat(at, states, got):
            ids, count, u, w = unpacked(states[0])
            ids, u, count = np.cumsum(ids), np.cumsum(u), count[count > 1]
            dish, before = unpacked(states[1]) if states[1] else (np.zeros(0, np.int64),) * 2
            dish = np.cumsum(dish)
            figures = np.zeros((3, len(ids)), np.int64)
            for bucket, mine in dealt(ids, word_buckets):
                figures[:, mine] = unpacked(got[bucket])
            x = process.gamma(s / d + figures[0], process.keys(ids, np.zeros(len(ids)), CONTEXT_DRAWS + number))
            a = d * x[u] * parent(figures[1], figures[2], total)[w]
            seen, sums = np.zeros(len(count), np.int64), []
            for k in range(draws):
                dish, before = process.sweep(count, a, d, dish, before, process.keys(ids[u], ids[w], number + k))
                extra = np.bincount(dish, minlength=len(count))
                seen += extra
                sums += [np.bincount(z, 1 + extra, len(ids)).astype(np.int64) for z in (u, w)]
            yield "seating", at, packed(steps(dish), before)
            yield "seen", at, packed(seen)
            yield from to_words(ids, *sums)

        return seat

    def words_round(number: int, draws: int, strengths: float):
        def seat(at, states, got):
            count, *base = unpacked(states[0])
            dish, before = unpacked(states[1])
            dish = np.cumsum(dish)
            sent = {sender: unpacked(m) for sender, m in got.items()}
            ids = np.arange(len(count)) * word_buckets + at
            samples_of, sums = [], []
            for k in range(draws):
                under, guests_of = base[0].copy(), base[1].copy()
                for x in sent.values():
                    place = np.cumsum(x[0])
                    under[place] += x[1 + 2 * k]
                    guests_of[place] += x[2 + 2 * k]
                on = before < guests_of[dish]  # customers who left were the last to come
                dish, before = dish[on], before[on]
                many = np.flatnonzero(guests_of > 1)
                place = np.zeros(len(count), np.int64)
                place[many] = np.arange(len(many))
                some, before = process.sweep(
                    guests_of[many], np.full(len(many), d_words * strengths / (v + 1)), d_words, place[dish], before, process.keys(ids[many], np.zeros(len(many)), WORD_DRAWS + number + k)
                )
                dish = many[some]
                tables_of = np.minimum(guests_of, 1) + np.bincount(dish, minlength=len(count))
                samples_of += [under, guests_of, tables_of]
                sums += [guests_of.sum(), tables_of.sum()]
            yield "seating", at, packed(steps(dish), before)
            for sender, x in sent.items():
                place = np.cumsum(x[0])
                yield "figures", sender, packed(*[y[place] for y in samples_of[-3:]])
            yield "samples", at, packed(count, *samples_of)
            yield "sums", None, sums

        return seat

    seated, last, totals = None, words, [(guests, tables)]
    for number in range(burn_in + 1):
        draws = samples if number == burn_in else 1
        old = (seated, last)
        states = [pairs.rows("state")] + ([seated.rows("seating")] if seated else [pairs.rows("state").where("false")])
        seated = table(step(contexts_round(number, draws, totals[-1]), states, gathered(last.rows("figures"))))
        x = float(process.gamma(np.array([s / d_words + totals[-1][1]]), process.keys(np.zeros(1), np.zeros(1), PARENT_DRAWS + number))[0])
        after = table(step(words_round(number, draws, x), [words.rows("words"), last.rows("seating")], gathered(seated.rows("tables"))))
        sums = after.sums() or [0, 0] * draws
        totals = list(zip(sums[::2], sums[1::2]))
        last = after
        for t in old:
            if t is not None and t is not words:
                t.drop()
    words.drop()

    # 4. figures go back to the blocks

    def ask_figures(block: Block):
        for to, mine in dealt(block.vocab, word_buckets):
            yield "ask", to, packed(steps(block.vocab[mine] // word_buckets))

    def answer_words(at, states, got):
        figures = unpacked(states[0])
        for sender, m in got.items():
            place = np.cumsum(unpacked(m)[0])
            yield "words", sender, packed(*[x[place] for x in figures])

    def answer_pairs(at, states, got):
        count = unpacked(states[0])[1]
        tables_of = np.minimum(count, 1) * samples
        tables_of[count > 1] += unpacked(states[1])[0]
        for sender, m in got.items():
            place = np.cumsum(unpacked(m)[0])
            yield "pairs", sender, packed(count[place], tables_of[place])

    unit = float(np.log10(n + 0.5 * (v + 1)))

    def score(at, states, got):
        block = Block.from_blob(states[0])
        u, w, _, of = block.pairs()
        figures = np.zeros((1 + 3 * samples, len(block.vocab)), np.int64)
        for bucket, mine in dealt(block.vocab, word_buckets):
            figures[:, mine] = unpacked(got[bucket])
        seen = np.zeros((2, len(u)), np.int64)
        for bucket, mine in dealt(pair_keys(block.vocab[u], block.vocab[w]), pair_buckets):
            seen[:, mine] = unpacked(got[-1 - bucket])
        count = figures[0]
        p = seen[0] - d * seen[1] / samples
        for k, (under, guests_of, tables_of) in enumerate(figures[1:].reshape(samples, 3, -1)):
            p += (s + d * under)[u] * parent(guests_of, tables_of, totals[k])[w] / samples
        p /= (s + count)[u]
        first = np.cumsum(block.lengths) - block.lengths
        sums = [np.add.reduceat(x, first) for x in ((count > 0)[block.tokens].astype(np.int64), np.log10(count + 0.5)[block.tokens] - unit, np.log10(p)[of])]
        yield pa.record_batch([pa.array(block.ids, mask=block.none), pa.array(block.held), pa.array(block.lengths), *map(pa.array, sums)], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    asked = gathered(of_blocks(texts.rows("block"), ask_figures))
    of_words = step(answer_words, [last.rows("samples")], asked)
    places = pairs.rows("places").groupBy("at").agg(F.collect_list(F.struct(F.col("to").alias("at"), "blob")).alias("got"))
    of_pairs = step(answer_pairs, [pairs.rows("state"), seated.rows("seen")], places)
    answers = of_words.select("at", "to", "blob").unionByName(of_pairs.select((-1 - F.col("at")).alias("at"), "to", "blob"))
    out = written(step(score, [texts.rows("block")], gathered(answers), SCORES), "scores")
    for t in (texts, pairs, seated, last):
        t.drop()
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(n)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
