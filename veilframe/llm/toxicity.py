"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a fixed lexicon and of a learned one (words and word beginnings that labelled toxic
texts hold far more often), how near their hits stand to the second person, capitals, punctuation, and the rate of
disguised words (digits or signs between letters that spell a lexicon word, stretched letters).

At most SAMPLE labelled rows teach the lexicon, the trees and the calibration; this is the only bound. The rows are cut into FOLDS parts. For the
calibration a row is scored by a lexicon, bins and trees that were learned from the other parts only, so its label is nowhere in its score. Keys,
languages and sources are no features.

Defined cases: NULL and empty texts have all measures 0 and get the score of that point. Repeated rows are scored
each. Without any label the score is 0.5. Other columns are not read. Long texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.boosting import Tree, binned, edges, grow, prior, sigmoid, slopes
from veilframe.llm.common import ASCII_LOWER, per_text, pieces, text_bytes, written
from veilframe.llm.labelled import held_out, sample

SAMPLE = 20_000
TREES, DEPTH, RATE, FOLDS = 80, 3, 0.1, 4
THRESHOLD = 0.3
#: Learned units: toxic texts they stand in, at least; how many times as dense as in other texts; how many are kept.
LEAST_TEXTS, LEAST_RATIO, UNITS = 8, 4.0, 400
BEGINNINGS = (4, 5, 6, 7)
NEAR = 5

#: Insults of everyday English.
LEXICON = (
    "idiot moron stupid dumb loser scum trash garbage pathetic worthless disgusting clown fool jerk freak filth vermin imbecile "
    "ugly hate liar coward creep pig rat crap damn hell bastard"
).split()
SECOND_PERSON = "you your yours u ur tu te toi ton ta vous votre du dich dir dein sie ihr tú ti usted vosotros".split()

_lexicon = {w.encode() for w in LEXICON}
_second = {w.encode() for w in SECOND_PERSON}
# ASCII other than letters and digits becomes a space
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_LEET = bytes.maketrans(b"013457@$!", b"oieastasi")
_NOT_LETTERS = bytes(b for b in range(128) if not 97 <= b <= 122)

FEATURES = [
    "fixed_density", "fixed_count", "learned_density", "learned_count", "learned_mean", "near_second_person", "second_person",
    "capitals", "capital_words", "exclamations", "questions", "punctuation", "disguised", "mixed_words", "stretched_words", "log_words",
]


def units(word: bytes) -> list[bytes]:
    """The word as a whole (closed by a space) and its beginnings."""
    return [word + b" ", *[word[:k] for k in BEGINNINGS if len(word) >= k]]


class Weights(dict):
    """Weight of a word: the largest of its units. Words met are kept, up to a number."""

    def __init__(self, of_unit: dict[bytes, float], most: int = 300_000):
        super().__init__()
        self.of_unit, self.most = of_unit, most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = got = max(self.of_unit.get(u, 0.0) for u in units(word))
        return got


def features(texts: list[bytes], weights: Weights) -> np.ndarray:
    """One row of FEATURES per text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        words = text.translate(_WORDS).split()
        n = len(words)
        raw = text.split()
        if not raw:
            continue
        n = max(n, 1)
        counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        learned = np.fromiter(map(weights.__getitem__, words), float, len(words))
        fixed = np.fromiter(map(_lexicon.__contains__, words), bool, len(words))
        persons = np.fromiter(map(_second.__contains__, words), bool, len(words))
        hits = np.flatnonzero(fixed | (learned > 0))
        near = 0
        if len(hits) and persons.any():
            at = np.flatnonzero(persons)
            k = np.searchsorted(at, hits)
            gap = np.minimum(np.abs(at[np.minimum(k, len(at) - 1)] - hits), np.abs(at[np.maximum(k - 1, 0)] - hits))
            near = int((gap <= NEAR).sum())
        disguised = mixed = stretched = 0
        for w in set(raw):
            inside = w.strip(b".,;:!?'\"()")
            if not inside.isalpha() and inside and inside.isascii():
                low = inside.translate(ASCII_LOWER)
                if low.isdigit():
                    continue
                mixed += 1
                plain = low.translate(_LEET, b"").translate(None, _NOT_LETTERS)
                disguised += plain in _lexicon and low not in _lexicon
            elif len(inside) > 4 and any(inside[j] == inside[j + 1] == inside[j + 2] for j in range(len(inside) - 2)):
                stretched += 1
        found = learned[learned > 0]
        out[i] = (
            fixed.sum() / n, np.log1p(fixed.sum()), learned.sum() / n, np.log1p(len(found)), found.mean() if len(found) else 0, near / n,
            persons.sum() / n, counts[65:91].sum() / len(text), sum(map(bytes.isupper, raw)) / n, counts[33] / n, counts[63] / n,
            counts[[33, 44, 46, 58, 59, 63]].sum() / n, disguised / n, mixed / n, stretched / n, np.log1p(n),
        )
    return out


class Toxicity(NamedTuple):
    """Weights of units, bin edges, trees, and the calibration as points of a rising line."""

    of_unit: dict[bytes, float]
    cuts: list[np.ndarray]
    start: float
    trees: list[Tree]
    at: np.ndarray
    to: np.ndarray

    def score(self, values: np.ndarray) -> np.ndarray:
        codes = binned(values, self.cuts)
        return np.interp(boosted(self.start, self.trees, codes), self.at, self.to)


def boosted(start: float, trees: list[Tree], codes: np.ndarray) -> np.ndarray:
    return sigmoid(start + sum((t(codes) for t in trees), np.zeros(len(codes))))


def boost(codes: np.ndarray, label: np.ndarray, start: float) -> list[Tree]:
    trees, score = [], np.full(len(label), start)
    for _ in range(TREES if len(label) else 0):
        grad, hess = slopes(score, label)
        trees.append(tree := grow(codes, grad, hess, DEPTH, range(codes.shape[1]), RATE))
        score += tree(codes)
    return trees


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising line of least squared error: neighbouring blocks that fall are pooled."""
    if not len(score):
        return np.array([0.0, 1.0]), np.array([0.5, 0.5])
    x, group = np.unique(score, return_inverse=True)
    weight = np.bincount(group).astype(float)
    blocks: list[list[float]] = []  # sum, weight, first and last place
    for k, (s, w) in enumerate(zip(np.bincount(group, label), weight)):
        blocks.append([s, w, x[k], x[k]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], last]
    level = [s / w for s, w, _, _ in blocks]
    at = [p for _, _, first, last in blocks for p in (first, last)]
    return np.array(at), np.repeat(level, 2)


def fit(of_unit: dict[bytes, float], values: np.ndarray, label: np.ndarray, fold: np.ndarray) -> Toxicity:
    """Trees on all rows; the calibration on the scores that each row gets from the other folds.

    values: rows x (FOLDS + 1) x features; first the features by the lexicon of all rows, then by those that leave one fold out.
    """
    start = prior(label)
    unseen = np.zeros(len(label))
    for k in range(FOLDS):
        own = fold % FOLDS == k
        codes, _ = _codes(values[:, k + 1], ~own)
        before = prior(label[~own])
        unseen[own] = boosted(before, boost(codes[~own], label[~own], before), codes[own])
    codes, cuts = _codes(values[:, 0], np.ones(len(label), bool))
    return Toxicity(of_unit, cuts, start, boost(codes, label, start), *isotonic(unseen, label))


def _codes(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bin numbers of all rows, and the edges of the bins, which are learned from some of them."""
    cuts = edges(values[of]) if of.any() else [np.empty(0)] * len(FEATURES)
    return binned(values, cuts), cuts


def learn_units(rows: DataFrame) -> list[dict[bytes, float]]:
    """Log ratios of units that are far denser in toxic texts: by all rows, and by all but those of each fold.

    Counted in the tasks by fold, added up after one shuffle; rows has key, text, label and fold.
    """
    schema = "fold int, unit binary, texts long, toxic double, other double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            sums = [(Counter(), Counter(), Counter()) for _ in range(FOLDS)]
            for text, label, fold in zip(text_bytes(piece), piece.column("label").to_pylist(), piece.column("fold").to_pylist()):
                texts, toxic, other = sums[fold]
                words = Counter(text.translate(_WORDS).split())
                own = Counter()
                for w, k in words.items():
                    for u in units(w):
                        own[u] += k
                n = max(1, words.total())
                into = toxic if label else other
                for u, k in own.items():
                    into[u] += k / n
                if label:
                    texts.update(own.keys())
            for fold, counts in enumerate(sums):
                keys = list({**counts[1], **counts[2]})
                cells = [pa.array([c[u] for u in keys], t) for c, t in zip(counts, (pa.int64(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([pa.array([fold] * len(keys), pa.int32()), pa.array(keys, pa.binary()), *cells], ["fold", "unit", "texts", "toxic", "other"])

    sizes = {r["fold"]: (r["t"] or 0.0, r["o"] or 0.0) for r in rows.groupBy("fold").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("o")).collect()}
    by_fold = [
        F.coalesce(F.sum(F.when(F.col("fold") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}") for c in ("texts", "toxic", "other") for k in range(FOLDS)
    ]
    sums = written(rows.mapInArrow(run, schema).groupBy("unit").agg(*by_fold), "units")
    out = []
    for left_out in (None, *range(FOLDS)):
        folds = [k for k in range(FOLDS) if k != left_out]
        n_toxic, n_other = (sum(sizes.get(k, (0.0, 0.0))[i] for k in folds) + 1.0 for i in (0, 1))
        texts, toxic, other = (sum((F.col(f"{c}{k}") for k in folds[1:]), F.col(f"{c}{folds[0]}")) for c in ("texts", "toxic", "other"))
        # a twentieth of one word in a thousand is added on both sides
        ratio = F.log((toxic / n_toxic + 5e-5) / (other / n_other + 5e-5))
        found = sums.where((texts >= LEAST_TEXTS) & (ratio >= float(np.log(LEAST_RATIO)))).select("unit", ratio.alias("w"), texts.alias("texts"))
        top = found.orderBy(F.desc(F.col("w") * F.log1p("texts")), "unit").limit(UNITS).collect()
        out.append({bytes(r["unit"]): r["w"] for r in top})
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", limit: int = SAMPLE) -> Toxicity:
    """The model of at most limit labelled rows."""
    hashed = F.xxhash64("key")
    rows = sample(docs, labels, label, key, text, limit).withColumn("fold", F.pmod(hashed, F.lit(FOLDS)).cast("int"))
    lexicons = learn_units(rows)
    weights = [Weights(w) for w in lexicons]
    fields = [T.StructField("values", T.ArrayType(T.DoubleType(), False))]
    packed = rows.select(F.struct("key", "label", "fold", hashed.alias("hash")).alias("key"), "text")
    values = per_text(packed, "key", "text", fields, lambda texts: [list(np.hstack([features(texts, w) for w in weights]))])
    got = values.orderBy("key.hash", "key.key").limit(limit).collect()
    return fit(
        lexicons[0], np.array([r["values"] for r in got]).reshape(-1, FOLDS + 1, len(FEATURES)), np.array([r["key"]["label"] for r in got]),
        np.array([r["key"]["fold"] for r in got], int),
    )


def score(docs: DataFrame, model: Toxicity, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, held_out, score and predicted of every row. No shuffle."""
    weights = Weights(model.of_unit)
    fields = [T.StructField("score", T.DoubleType())]
    made = per_text(docs, key, text, fields, lambda texts: [model.score(features(texts, weights))])
    return made.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
