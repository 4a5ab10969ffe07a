"""A hidden Markov language model, learned and applied on all documents.

Symbols. A word that makes at least one in SHARE training tokens, and at least OFTEN of them, is a symbol of its own, so there are at most
SHARE of them, whatever the corpus. Every other word is rare and belongs to a class by its letters; a class is a symbol too. The states emit symbols, and a rare word
w of class r has the probability of r times (c(w) + 1) / (N(r) + V(r) + 1), with the training tokens N and distinct words V of the
class; the factor does not depend on the state. So the forward recursion runs over symbols, and the rare words of a text add a plain sum.

Learning. Words are counted over all training documents. Baum-Welch runs over whole documents: each task computes expected counts of first
states, transitions and emissions by the scaled forward and backward recursion, for many documents at once, and returns one row per symbol
that it met; Spark sums them over the partitions, and the driver gets the sums, symbols x states numbers at most, and makes the next
model of them, which is broadcast. Emissions are smoothed towards the shares of the symbols, so that no state excludes a word.

Scoring. The scaled forward recursion gives the exact likelihood of the sequence of symbols. The counts of rare words come by a join of the
rare words of the documents with the table of counts; being rare, none of them is a hot key.

Tokens: A-Z in lower case, words [^\\x20\\x09-\\x0D]+, and one end after the last word. base_score is log10 of add-one smoothed word shares.

Defined cases: NULL and empty texts are one end. Documents with a NULL key are not held out. Repeated rows count and are scored each. An empty
table gives an empty result; without training documents nothing is known, base_score is 0 and every sequence of symbols has the score of
an untrained model over rare classes and the end. Other columns are not read. Texts are never cut.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import ASCII_LOWER, pieces, text_bytes, text_columns, written

#: A word is a symbol if at least one in so many training tokens is that word, and so many tokens at least.
SHARE, OFTEN = 200_000, 5
STATES, ROUNDS = 8, 4
#: Before the first round: share of the transitions into the same state, and how far emissions are apart.
STAY, APART = 0.9, 2.0
#: Emissions get so many tokens spread by the shares of the symbols, transitions and first states so many each.
PRIOR, LEAST = 200.0, 1.0
#: Bytes of text, and of symbols, that a task takes at once.
PIECE, SEQUENCES = 8 << 20, 2 << 20
#: Bytes of symbols that are sorted by length at once.
BUFFER = 32 << 20
#: Distinct words that a task counts before it passes them on.
WORDS = 400_000
#: Tokens whose probabilities are held at once.
HELD = 1 << 19
#: Classes of rare words; end is the symbol before them.
CLASSES = ("digit", "foreign", "short", "long", "mixed")

_DIGITS = b"0123456789"


def held_out(key: str) -> Column:
    """Whether crc32 of the key as text leaves 2 when divided by 7; a NULL key is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words(text: bytes) -> list[bytes]:
    return text.translate(ASCII_LOWER).split()


def kind(word: bytes) -> int:
    """The class of a rare word."""
    if word.isalpha():  # letters of ASCII only
        return 2 if len(word) < 6 else 3
    if len(word.translate(None, _DIGITS)) < len(word):
        return 0
    return 4 if word.isascii() else 1


class Vocabulary(NamedTuple):
    """counts: word, kind and c of every training word, as a written table. symbols: the frequent words and their counts."""

    counts: DataFrame
    symbols: dict[bytes, int]
    tokens: int
    distinct: int
    ends: int
    #: Tokens and distinct words of each class of rare words.
    rare: list[tuple[int, int]]

    def shares(self) -> np.ndarray:
        """Share of each symbol: frequent words, end, classes; one is added to the last."""
        own = np.array([*self.symbols.values(), self.ends + 1, *[n + 1 for n, _ in self.rare]], float)
        return own / own.sum()


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", share: int = SHARE, least: int = OFTEN) -> Vocabulary:
    """Counts over the training documents."""
    train = docs.where(~held_out(key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for piece in pieces(batches, limit=PIECE):
            for t in text_bytes(piece):
                n.update(words(t))
            if len(n) > WORDS:
                yield counted(n)
                n = Counter()
        yield counted(n)

    def counted(n: Counter) -> pa.RecordBatch:
        got = list(n)
        return pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), pa.array(list(map(kind, got)), pa.int32()), pa.array(list(n.values()), pa.int64())], names)

    names = ["word", "kind", "c"]
    parts = text_columns(train, key, text).mapInArrow(run, "word binary, kind int, c long")
    counts = written(parts.groupBy("word", "kind").agg(F.sum("c").alias("c")), "counts")
    ends = train.count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens = total + ends
    often = (F.col("c") * share >= tokens) & (F.col("c") >= least)
    symbols = {bytes(r["word"]): r["c"] for r in counts.where(often).orderBy("word").collect()}
    rare = {r["kind"]: (r["n"], r["v"]) for r in counts.where(~often).groupBy("kind").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    return Vocabulary(counts, symbols, tokens, distinct + (ends > 0), ends, [rare.get(k, (0, 0)) for k in range(len(CLASSES))])


class Met(dict):
    """Symbols of frequent words, and of the rare ones met so far, negative so that they are told apart."""

    def __init__(self, numbers: dict[bytes, int]):
        super().__init__(numbers)
        self.first = len(numbers) + 1

    def __missing__(self, word: bytes) -> int:
        self[word] = symbol = -(self.first + kind(word))
        return symbol


def encode(docs: DataFrame, known: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: row, key, held_out, symbols, and its rare words; a written table."""
    numbers = {w: i for i, w in enumerate(known.symbols)}
    shared = docs.sparkSession.sparkContext.broadcast(numbers)
    slim = docs.select(F.col(f"`{key}`").alias("key"), held_out(key).alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("key", slim.schema["key"].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("symbols", T.BinaryType()), T.StructField("rare", T.ArrayType(T.BinaryType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, row = shared.value, TaskContext.get().partitionId() << 33
        end = len(numbers).to_bytes(4, "little")
        for piece in pieces(batches, limit=PIECE):
            symbols, rare = [], []
            met = Met(numbers)
            for t in text_bytes(piece):
                own = words(t)
                got = np.fromiter(map(met.__getitem__, own), np.int32, len(own))
                rare.append([own[i] for i in np.flatnonzero(got < 0).tolist()])
                symbols.append(np.abs(got).tobytes() + end)
            m = len(symbols)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + m)), piece.column("key"), piece.column("held_out"), pa.array(symbols, pa.binary()),
                pa.array(rare, pa.list_(pa.binary())),
            ], schema.names)
            row += m

    return written(slim.mapInArrow(run, schema), "encoded")


class Model(NamedTuple):
    """Probabilities of the first state, of the next state, and of each symbol (rows) in each state."""

    first: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def start(shares: np.ndarray, states: int) -> Model:
    """Emissions near the shares of the symbols, apart by hashes of their numbers; states like to stay."""
    apart = np.array([xxhash.xxh64_intdigest(f"{i} {s}") for i in range(len(shares)) for s in range(states)], np.float64) / 2.0**64
    emit = shares[:, None] * np.exp(APART * apart.reshape(-1, states))
    step = np.full((states, states), (1 - STAY) / states) + STAY * np.eye(states)
    return Model(np.full(states, 1 / states), step, emit / emit.sum(0))


class Batch:
    """Some sequences in the order of time: the symbols at one time stand together, longest sequences first."""

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences], np.int64)
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        # how many sequences are still there at each time
        self.there = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), "right")
        self.at = np.concatenate(([0], np.cumsum(self.there)))
        flat = np.concatenate([sequences[i] for i in self.order])
        time = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.symbols = np.empty(len(flat), np.int64)
        self.symbols[self.at[time] + np.repeat(np.arange(len(sizes)), sizes)] = flat

    def ranges(self, tokens: int) -> list[tuple[int, int]]:
        """Ranges of times with about so many tokens each."""
        cuts = [0]
        while cuts[-1] < len(self.there):
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(self.at, self.at[cuts[-1]] + tokens, "right")) - 1))
        return list(zip(cuts, cuts[1:]))

    def forward(self, model: Model, times: tuple[int, int], last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Scales of a range of times, and its scaled forward probabilities."""
        ends = self.at[times[0] : times[1] + 1]
        alpha = model.emit[self.symbols[ends[0] : ends[-1]]]
        ends = (ends - ends[0]).tolist()
        scale, one = np.empty(ends[-1]), np.ones(len(model.first))
        for a, b in zip(ends, ends[1:]):
            now = alpha[a:b]
            now *= model.first if last is None else last[: b - a] @ model.step
            c = now @ one
            now /= c[:, None]
            scale[a:b] = c
            last = now
        return scale, alpha

    def final(self, alpha: np.ndarray, times: tuple[int, int]) -> np.ndarray:
        """The probabilities of the last time of a range."""
        return alpha[len(alpha) - self.there[times[1] - 1] :]

    def likelihood(self, model: Model) -> np.ndarray:
        """log10 likelihood of each sequence."""
        total, last = np.zeros(self.there[0]), None
        for times in self.ranges(HELD):
            scale, alpha = self.forward(model, times, last)
            last = self.final(alpha, times).copy()
            logs, first = np.log10(scale), self.at[times[0]]
            ends = self.at[times[0] : times[1] + 1] - first
            for a, b in zip(ends, ends[1:]):
                total[: b - a] += logs[a:b]
        out = np.empty(len(total))
        out[self.order] = total
        return out

    def expected(self, model: Model, held: int = HELD) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected first states, transitions and emissions, and the log10 likelihood.

        Only the probabilities of one range of times are held; those of a very long sequence are computed once more from where each range begins.
        """
        ranges, begins = self.ranges(held), [None]
        for times in ranges[:-1]:
            begins.append(self.final(self.forward(model, times, begins[-1])[1], times).copy())
        states = len(model.first)
        pairs, emitted, logs = np.zeros((states, states)), np.zeros(model.emit.shape), 0.0
        follow, back = np.empty((0, states)), model.step.T.copy()
        for times, begin in zip(ranges[::-1], begins[::-1]):
            scale, alpha = self.forward(model, times, begin)
            logs += float(np.log10(scale).sum())
            there = self.there[times[0] : times[1]]
            ends = (self.at[times[0] : times[1] + 1] - self.at[times[0]]).tolist()
            symbols = self.symbols[self.at[times[0]] : self.at[times[1]]]
            # what comes after each place, and with the own emission over its scale
            beta, ahead = np.ones_like(alpha), model.emit[symbols]
            ahead /= scale[:, None]
            pairs += self.final(alpha, times)[: len(follow)].T @ follow
            for a, b in zip(ends[-2::-1], ends[:0:-1]):
                if n := len(follow):
                    np.matmul(follow, back, out=beta[a : a + n])
                follow = ahead[a:b]
                follow *= beta[a:b]
            # the same sequence one step earlier
            before = np.arange(there[0], len(alpha)) - np.repeat(there[:-1], there[1:])
            pairs += alpha[before].T @ ahead[there[0] :]
            alpha *= beta
            emitted += np.stack([np.bincount(symbols, alpha[:, s], len(model.emit)) for s in range(states)], 1)
            follow = follow.copy()
        return alpha[: self.there[0]].sum(0), pairs * model.step, emitted, logs


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in pieces of about SEQUENCES bytes of symbols; of BUFFER bytes at a time the longest come together, as a piece takes as many steps as its longest row."""

    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        order = np.argsort(-pc.binary_length(rows["symbols"]).to_numpy(), kind="stable")
        yield from pieces(rows.take(order).combine_chunks().to_batches(), "symbols", SEQUENCES)

    held, size = [], 0
    for piece in pieces(batches, "symbols", SEQUENCES):
        held.append(piece)
        size += piece.column("symbols").nbytes
        if size >= BUFFER:
            yield from cut(held)
            held, size = [], 0
    if held:
        yield from cut(held)


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(s, np.int32) for s in batch.column("symbols").to_pylist()]


def expected_counts(encoded: DataFrame, model: Model) -> tuple[Model, float, int]:
    """Expected counts over all rows in the shape of a model, log10 likelihood, and number of tokens."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    states = len(model.first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        first, pairs, emitted, logs, n = np.zeros(states), np.zeros((states, states)), np.zeros(model.emit.shape), 0.0, 0
        for piece in by_length(batches):
            f, p, e, part = (batch := Batch(_sequences(piece))).expected(model)
            first, pairs, emitted, logs, n = first + f, pairs + p, emitted + e, logs + part, n + len(batch.symbols)
        if n:
            met = np.flatnonzero(emitted.any(1))
            rows = [(0, 0, [logs, float(n)]), (1, 0, first.tolist()), *[(2, s, pairs[s].tolist()) for s in range(states)]]
            rows += [(3, int(i), emitted[i].tolist()) for i in met]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.list_(pa.float64())))], ["what", "nr", "n"])

    parts = encoded.select("symbols").mapInArrow(run, "what int, nr int, n array<double>")
    sums = parts.groupBy("what", "nr").agg(*[F.sum(F.get("n", F.lit(s))).alias(f"s{s}") for s in range(max(2, states))])
    out = Model(np.zeros(states), np.zeros((states, states)), np.zeros(model.emit.shape))
    logs, n = 0.0, 0.0
    for what, nr, *v in sums.collect():
        if what == 0:
            logs, n = v[:2]
        else:
            (out.first if what == 1 else out[what - 1][nr])[:] = v[:states]
    return out, logs, int(n)


def maximised(counts: Model, shares: np.ndarray, prior: float = PRIOR, least: float = LEAST) -> Model:
    first, step, emit = counts.first + least, counts.step + least, counts.emit + prior * shares[:, None]
    return Model(first / first.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def fit(encoded: DataFrame, known: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model after some rounds over the rows that are not held out, and log10 likelihood per token before each round."""
    shares = known.shares()
    model, path = start(shares, states), []
    train = encoded.where("NOT held_out")
    for _ in range(rounds):
        counts, logs, n = expected_counts(train, model)
        if not n:
            break
        path.append(logs / n)
        model = maximised(counts, shares)
    return model, path


def score(encoded: DataFrame, known: Vocabulary, model: Model, key: str = "doc_id") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    total = known.tokens + known.distinct + 1
    # per symbol: log10 of its add-one share; rare words are judged one by one, here only what they are divided by
    own = np.array([*known.symbols.values(), known.ends, *[0] * len(CLASSES)], float)
    base = np.log10((own + 1) / total)
    base[len(known.symbols) + 1 :] = -np.log10(total)
    over = np.zeros(len(own))
    over[len(known.symbols) + 1 :] = [np.log10(n + v + 1) for n, v in known.rare]
    shared = encoded.sparkSession.sparkContext.broadcast((model, base, over, own > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, base, over, there = shared.value
        for piece in by_length(batches):
            seqs = _sequences(piece)
            logs = Batch(seqs).likelihood(model)
            yield pa.RecordBatch.from_arrays([
                piece.column("row"), piece.column("key"), piece.column("held_out"), pa.array([len(s) for s in seqs], pa.int64()),
                pa.array([int(there[s].sum()) for s in seqs], pa.int64()), pa.array([float(base[s].sum()) for s in seqs]),
                pa.array([x - float(over[s].sum()) for x, s in zip(logs.tolist(), seqs)], pa.float64()),
            ], schema.names)

    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("key", encoded.schema["key"].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("logs", T.DoubleType()),
    ])
    parts = encoded.select("row", "key", "held_out", "symbols").mapInArrow(run, schema)
    rare = encoded.select("row", F.explode("rare").alias("w"))
    seen = F.coalesce("c", F.lit(0))
    # words are distinct in the counts, so every partition of them holds its even share and can be hashed
    met = rare.join(known.counts.select("word", "c").hint("shuffle_hash"), F.col("w") == F.col("word"), "left")
    met = met.groupBy(F.col("row").alias("r_row")).agg(F.count_if(F.col("c") > 0).alias("known_rare"), F.sum(F.log10(seen + 1)).alias("up"))
    joined = parts.join(met, F.col("row") == F.col("r_row"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("known") + zero("known_rare")).cast("bigint").alias("n_known"),
        F.lit(known.tokens).cast("bigint").alias("train_tokens"), (F.col("base") + zero("up")).alias("base_score"), (F.col("logs") + zero("up")).alias("score"),
    )
