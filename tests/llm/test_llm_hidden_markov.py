"""The hidden Markov model against enumeration of all state paths, over odd texts, repeated rows and empty tables."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF

from veilframe.llm import hidden_markov as hmm
from veilframe.llm import queries


def plain_words(text):
    return (text or "").encode().translate(hmm.ASCII_LOWER).split()


def documents(spark, texts):
    rows = [(None if i == 3 else i, t, 5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, n_tokens int, row string").repartition(3), [*rows, rows[0]]


TEXTS = [
    "the cat sat on the mat", None, "", "The CAT sat", " \n\t", "a1 b2 c3 étude naïve x-y", "der Hund und die Katze " * 30, "the dog and the cat " * 40,
    "zzz", "le chat noir et le chien", "the\x85cat\xa0sat\x1con", "und der Hund", "\x00 nul", "the the the", "mat mat cat", "w" * 3000,
]


def enumerated(model, seq):
    """Likelihood, and expected first states, transitions and emissions, by all paths."""
    n = len(model.first)
    total, first, step, emit = 0.0, np.zeros(n), np.zeros((n, n)), np.zeros(model.emit.shape)
    paths = []
    for path in itertools.product(range(n), repeat=len(seq)):
        p = model.first[path[0]] * math.prod(model.emit[s, k] for s, k in zip(seq, path)) * math.prod(model.step[a, b] for a, b in itertools.pairwise(path))
        total += p
        paths.append((path, p))
    for path, p in paths:
        first[path[0]] += p / total
        for a, b in itertools.pairwise(path):
            step[a, b] += p / total
        for s, k in zip(seq, path):
            emit[s, k] += p / total
    return total, first, step, emit


@pytest.mark.parametrize("held", [1, 4, 1 << 19])
def test_forward_and_backward_by_enumeration(held):
    rng = np.random.default_rng(3)
    model = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    seqs = [rng.integers(0, 5, n).astype(np.int32) for n in (1, 6, 3, 6, 1, 7, 2)]
    batch = hmm.Batch(seqs)
    want = [enumerated(model, s) for s in seqs]
    assert np.allclose(batch.likelihood(model), [math.log10(w[0]) for w in want])
    first, step, emit, logs = batch.expected(model, held)
    assert np.allclose(first, sum(w[1] for w in want)) and np.allclose(step, sum(w[2] for w in want)) and np.allclose(emit, sum(w[3] for w in want))
    assert math.isclose(logs, sum(math.log10(w[0]) for w in want))


def test_scores_by_brute_force(spark):
    docs, rows = documents(spark, TEXTS)
    share = 20  # few words are symbols, most are rare
    known = hmm.count_words(docs, share=share, least=1)
    encoded = hmm.encode(docs, known)
    model, path = hmm.fit(encoded, known, states=2, rounds=3)
    got = sorted((tuple(r) for r in hmm.score(encoded, known, model).collect()), key=str)
    held = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, *_ in rows]
    assert any(held) and not all(held)
    count = Counter(w for (_, t, *_), h in zip(rows, held) if not h for w in [*plain_words(t), None])
    total = sum(count.values())
    assert known.tokens == total and known.distinct == len(count)
    often = sorted(w for w in count if w is not None and count[w] * share >= total)
    assert list(known.symbols) == often and often
    seen = [Counter(), Counter()]
    for w, c in count.items():
        if w is not None and w not in often:
            seen[0][hmm.kind(w)] += c
            seen[1][hmm.kind(w)] += 1
    want = []
    for (k, t, *_), h in zip(rows, held):
        own = [*plain_words(t), None]
        base = sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in own)
        symbols = [often.index(w) if w in often else len(often) if w is None else len(often) + 1 + hmm.kind(w) for w in own]
        alpha, logs = None, 0.0
        for s in symbols:
            alpha = (model.first if alpha is None else alpha @ model.step) * model.emit[s]
            logs += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        logs += sum(math.log10((count[w] + 1) / (seen[0][hmm.kind(w)] + seen[1][hmm.kind(w)] + 1)) for w in own if w is not None and w not in often)
        want.append((k, h, len(own), sum(count[w] > 0 for w in own), total, base, logs))
    want.sort(key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want])
    assert path == sorted(path)  # every round gains


def test_expected_counts_are_those_of_any_partitioning(spark):
    docs, _ = documents(spark, TEXTS)
    known = hmm.count_words(docs, share=20, least=1)
    models = [hmm.fit(hmm.encode(docs.repartition(n), known), known, states=3, rounds=2)[0] for n in (1, 7)]
    assert all(np.allclose(a, b) for a, b in zip(*models))


def test_probabilities_of_symbols_sum_to_one(spark):
    docs, _ = documents(spark, TEXTS)
    known = hmm.count_words(docs, share=20, least=1)
    model = hmm.fit(hmm.encode(docs, known), known, states=3, rounds=2)[0]
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.step.sum(1), 1) and math.isclose(model.first.sum(), 1) and (model.emit > 0).all()
    for c, (n, v) in enumerate(known.rare):
        words = [r["c"] for r in known.counts.where(f"kind = {c}").collect() if bytes(r["word"]) not in known.symbols]
        # the words of a class and one word that was never seen
        assert math.isclose(sum((x + 1) / (n + v + 1) for x in words) + 1 / (n + v + 1), 1)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    known = hmm.count_words(empty)
    encoded = hmm.encode(empty, known)
    assert hmm.score(encoded, known, hmm.fit(encoded, known)[0]).count() == 0
    held = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2)
    one = spark.createDataFrame([(held, "never seen words")], "doc_id long, text string")
    known = hmm.count_words(one)
    encoded = hmm.encode(one, known)
    row = hmm.score(encoded, known, hmm.fit(encoded, known)[0]).first()
    assert row["held_out"] and (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (4, 0, 0, 0.0) and row["score"] < 0


def test_held_out_documents_gain(spark):
    rows = queries.op13_hidden_markov(spark, SF).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and held
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    random.Random(1).shuffle(rows)
    assert all(r["train_tokens"] == rows[0]["train_tokens"] for r in rows)
