"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn over the features, each tree seeing one feature; their sum is one lookup table
per feature. Then trees over two features refine the pairs with the largest gain left. A text is scored by adding the
entries of its bins. The model is fitted on at most SAMPLE labelled rows (the only bound; everything else covers all rows);
keys, languages and sources are no features.

Defined cases: NULL and empty texts have all measures 0 and get the score of that point. Repeated rows are
scored each. Without any label the score is 0.5; with labels of one kind it stays inside (0, 1). Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations
from operator import eq
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.boosting import BINS, binned, edges, grow, prior, sigmoid, slopes
from veilframe.llm.common import keep_rows, per_text
from veilframe.llm.labelled import held_out, sample

#: Labelled rows the model is fitted on.
SAMPLE = 20_000
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 120, 40, 8, 0.1
THRESHOLD = 0.7

FEATURES = [
    "log_words", "word_bytes", "symbols_per_word", "capitals", "digits", "punctuation", "exclamations_per_word", "distinct_words",
    "words_like_previous", "lines_with_end", "repeated_lines", "bars_per_word", "above_ascii", "byte_entropy", "words_per_line",
]


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars.encode())] = 1
    return out


_CLASSES = np.stack([
    _class("#*$%&|<>"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(".,;:!?'\"()-"), _class("!"), _class("|"),
    np.arange(256) > 127,
], axis=1)
_ENDS = (b".", b"!", b"?", b":", b'"', b")", "…".encode(), "»".encode(), "”".encode())


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        words = text.split()
        n = len(words)
        if not n:
            continue
        counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        size = len(text)
        symbols, capitals, digits, marks, cries, bars, high = counts @ _CLASSES
        share = counts[counts > 0] / size
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        ends = sum(x.rstrip().endswith(_ENDS) for x in lines)
        out[i] = (
            np.log1p(n), sum(map(len, words)) / n, symbols / n, capitals / size, digits / size, marks / size, cries / n,
            len(set(words)) / n, sum(map(eq, words, words[1:])) / n, ends / len(lines), 1 - len(set(lines)) / len(lines), bars / n,
            high / size, -(share * np.log2(share)).sum(), np.log1p(n / len(lines)),
        )
    return out


class Gam(NamedTuple):
    """Start value, bin edges, one table per feature, one per pair."""

    start: float
    cuts: list[np.ndarray]
    tables: np.ndarray
    pairs: dict[tuple[int, int], np.ndarray]

    def raw(self, codes: np.ndarray) -> np.ndarray:
        score = self.start + sum(table[codes[:, j]] for j, table in enumerate(self.tables))
        for (a, b), table in self.pairs.items():
            score = score + table[codes[:, a], codes[:, b]]
        return score

    def score(self, values: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(binned(values, self.cuts)))


def fit(values: np.ndarray, label: np.ndarray) -> Gam:
    """Cyclic boosting over single features, then over the pairs that gain most."""
    many = values.shape[1]
    cuts = edges(values) if len(values) else [np.empty(0)] * many
    codes = binned(values, cuts)
    start = prior(label)
    tables, pairs = np.zeros((many, BINS)), {}
    score = np.full(len(label), start)
    own = np.arange(BINS)[:, None]
    if len(label):
        for _ in range(ROUNDS):
            for j in range(many):
                grad, hess = slopes(score, label)
                step = grow(codes[:, [j]], grad, hess, 2, [0], RATE)(own)
                tables[j] += step
                score += step[codes[:, j]]
        grad, hess = slopes(score, label)
        grid = np.stack(np.meshgrid(np.arange(BINS), np.arange(BINS), indexing="ij"), -1).reshape(-1, 2)

        def left(pair: tuple[int, int]) -> float:
            tree = grow(codes[:, pair], grad, hess, 2, [0, 1], 1.0)
            return float((grad * tree(codes[:, pair])).sum())

        chosen = sorted(combinations(range(many), 2), key=left)[:PAIRS]
        for _ in range(PAIR_ROUNDS):
            for pair in chosen:
                grad, hess = slopes(score, label)
                step = grow(codes[:, pair], grad, hess, 3, [0, 1], RATE)(grid).reshape(BINS, BINS)
                pairs[pair] = pairs.get(pair, 0) + step
                score += step[codes[:, pair[0]], codes[:, pair[1]]]
    return Gam(start, cuts, tables, pairs)


_VALUES = [T.StructField("values", T.ArrayType(T.DoubleType(), False))]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", limit: int = SAMPLE) -> Gam:
    """The model of at most limit labelled rows."""
    rows = sample(docs, labels, label, key, text, limit)
    values = per_text(rows.withColumn("key", F.struct("key", "label")), "key", "text", _VALUES, lambda texts: [list(features(texts))])
    got = values.orderBy(F.xxhash64("key.key"), "key.key").limit(limit).collect()
    return fit(np.array([r["values"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["key"]["label"] for r in got]))


def score(docs: DataFrame, model: Gam, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, held_out, score and predicted of every row. No shuffle."""
    fields = [T.StructField("score", T.DoubleType())]
    made = per_text(docs, key, text, fields, lambda texts: [model.score(features(texts))])
    return made.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Gam, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, with a score of at least the threshold."""
    return keep_rows(docs, text, lambda texts: model.score(features(texts)) >= threshold)
