"""Quality rules, line first: lines are judged one by one, then the document by what it lost.

A line is removed if it breaks one of these rules; lines without a word are kept and count for nothing.

* punctuation: it does not end like a sentence, more than a third as many symbols as words, or more than
  half as many exclamation marks as words;
* navigation: at least a fifth of its words are bare separators;
* boilerplate: it holds one of the phrases below, or equals an earlier line of the document.

A document is rejected if it has fewer than 20 words, if repeated 8-word windows cover more than 30 % of its
words, or if more than half of its words were removed.

NULL and empty texts have no words and are rejected. Repeated rows are judged each for themselves; the key may
be NULL or repeated. Other columns are not read. No text is cut: a long document only makes a longer task.
"""

from __future__ import annotations

import re
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilframe.llm.common import per_text

SYMBOLS = "#*$%&|<>"
TERMINAL = ".!?…:;\"'”’»)]"
SEPARATORS = "|»›•·>/-"
BOILERPLATE = (
    "all rights reserved|privacy policy|terms of (use|service)|cookie|copyright|javascript|licensed under|"
    "sign (in|up)|log ?in|subscribe|click here|lorem ipsum"
)
MIN_WORDS, MAX_REPEATED, MAX_REMOVED, WINDOW = 20, 30, 50, 8

FIELDS = [
    *[T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("base_failed", T.BooleanType()),
    *[T.StructField(n, T.LongType()) for n in ("n_lines", "n_punctuation", "n_navigation", "n_boilerplate", "n_removed_words")],
    T.StructField("kept", T.BooleanType()),
    T.StructField("clean_text", T.StringType()),
]

_symbols_out = SYMBOLS.encode()
_separator_word = re.compile(rb"(?:[|>/-]|" + b"|".join(c.encode() for c in SEPARATORS if ord(c) > 127) + rb")+")
_boilerplate = re.compile(BOILERPLATE.encode())
_terminal = tuple(c.encode() for c in TERMINAL)
_lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of that many words that occur at least twice in the list."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    # equal words get the number of their first place
    rank = np.fromiter(map(ids.setdefault, words, count()), np.int64, n)
    if len(ids) == n:
        return 0
    width = 1
    while width < window:  # windows of twice the width from pairs of neighbours; 8 = 1 + 1 + 2 + 4
        step = min(width, window - width)
        pairs = rank[: len(rank) - step] * n + rank[step:]
        distinct, rank = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(pairs):
            return 0
        width += step
    starts = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def judge(text: bytes) -> tuple:
    """The measures of one text, whether it is kept, and what is left of it, in the order of FIELDS."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.decode("utf-8"))
    symbols = len(text) - len(text.translate(None, _symbols_out))
    repeated = repeated_words(words)
    seen: set[bytes] = set()
    left: list[bytes] = []
    lines = doubled = bad_marks = navigation = boilerplate = removed = 0
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            left.append(line)
            continue
        lines += 1
        again = line in seen
        doubled += again
        seen.add(line)
        k = len(own)
        marks = (
            not own[-1].endswith(_terminal)
            or 3 * (len(line) - len(line.translate(None, _symbols_out))) > k
            or 2 * line.count(b"!") > k
        )
        menu = 5 * sum(1 for w in own if _separator_word.fullmatch(w)) >= k
        plate = again or bool(_boilerplate.search(line.translate(_lower)))
        bad_marks, navigation, boilerplate = bad_marks + marks, navigation + menu, boilerplate + plate
        if marks or menu or plate:
            removed += k
        else:
            left.append(line)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    kept = not failed and 100 * removed <= MAX_REMOVED * n
    return (n, chars, symbols, doubled, repeated, failed, lines, bad_marks, navigation, boilerplate, removed, kept, b"\n".join(left).decode("utf-8"))


def clean_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, measures, base_failed, kept and clean_text. No shuffle."""

    def run(texts: list[bytes]) -> list:
        return [list(c) for c in zip(*map(judge, texts))]

    return per_text(docs, key, text, FIELDS, run)
