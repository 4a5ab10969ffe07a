"""Token counts by unigram segmentation, with the work shared along a trie of words.

The pieces and scores are those of a sentencepiece model file. A text is cut into words at white space, each word is
led by the mark of a word start, and its best segmentation is the one of the greatest sum of scores, of equal sums the one
with fewer tokens. The best score of a beginning depends on the beginning only: so the distinct words that
a worker meets are put into a trie, the forward scores are computed once per node, and the nodes where words end keep the number
of tokens. A character outside the pieces costs FAR below the worst score and counts as its UTF-8 bytes (byte fallback).

Defined cases: NULL and empty texts have 0 tokens. Repeated rows are counted each. Words are never cut. Other columns are not read.
The work stays in the task that reads the rows; the trie is bounded.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilframe.llm.common import per_text

START = "▁"
FAR = 10.0
#: Nodes beyond which a worker starts a new trie.
NODES = 800_000


def read_pieces(path: str) -> dict[str, float]:
    """Pieces of text and their scores; runs of marks, which stand for runs of spaces, occur in no word."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    text = [i for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
    scores = {p.id_to_piece(i): p.get_score(i) for i in text}
    return {piece: score for piece, score in scores.items() if piece == START or piece.strip(START)}


class Counter:
    """Counts tokens of words by the pieces of one model; the trie stays until it has NODES nodes.

    Which pieces end at a node is told by a second automaton (Aho and Corasick, 1975) over the pieces, whose state is kept per node.
    """

    def __init__(self, pieces: dict[str, float]):
        self.unknown = min(pieces.values()) - FAR
        edges: dict[int, int] = {}
        states = [(0, 0, "")]  # depth, state before, character
        own: dict[int, tuple[int, float]] = {}
        for piece, gain in pieces.items():
            at = 0
            for depth, c in enumerate(piece, 1):
                step = at << 21 | ord(c)
                if step not in edges:
                    edges[step] = len(states)
                    states.append((depth, at, c))
                at = edges[step]
            own[at] = (len(piece), gain)
        self.edges, self.fail = edges, [0] * len(states)
        #: Length and score of the pieces that end in a state, short ones first.
        self.ending: list[tuple[tuple[int, float], ...]] = [()] * len(states)
        for at in sorted(range(1, len(states)), key=lambda i: states[i][0]):
            depth, before, c = states[at]
            self.fail[at] = self.next(self.fail[before], ord(c)) if depth > 1 else 0
            self.ending[at] = self.ending[self.fail[at]] + ((own[at],) if at in own else ())
        self.plant()

    def next(self, state: int, char: int) -> int:
        while True:
            after = self.edges.get(state << 21 | char)
            if after is not None:
                return after
            if not state:
                return 0
            state = self.fail[state]

    def plant(self) -> None:
        """An empty trie: children by node and character; state, score and tokens of each node; and where words end."""
        self.child: dict[int, int] = {}
        self.state, self.score, self.tokens = [0], [0.0], [0]
        self.terminal: dict[str, int] = {}

    def count(self, words: list[str]) -> list[tuple[int, float]]:
        """Tokens and score of each word."""
        if len(self.state) > NODES:
            self.plant()
        child, state, score, tokens, terminal, ending = self.child, self.state, self.score, self.tokens, self.terminal, self.ending
        for word in words:
            if word in terminal:
                continue
            path = [0]
            for c in START + word:
                step = path[-1] << 21 | ord(c)
                node = child.get(step)
                if node is None:
                    node = child[step] = len(state)
                    after = self.next(state[path[-1]], ord(c))
                    best = None
                    for length, gain in ending[after]:
                        at = path[-length]
                        s, n = score[at] + gain, tokens[at] + 1
                        if best is None:
                            best, fewest = s, n
                            if length > 1:  # no piece for the character itself: bytes may stand for it
                                s, n = score[path[-1]] + self.unknown, tokens[path[-1]] + len(c.encode())
                        if s > best or (s == best and n < fewest):
                            best, fewest = s, n
                    if best is None:
                        best, fewest = score[path[-1]] + self.unknown, tokens[path[-1]] + len(c.encode())
                    state.append(after)
                    score.append(best)
                    tokens.append(fewest)
                path.append(node)
            terminal[word] = path[-1]
        return [(tokens[terminal[w]], score[terminal[w]]) for w in words]


@lru_cache(2)
def counter(path: str) -> Counter:
    """One per worker and model."""
    return Counter(read_pieces(path))


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())]


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_tokens and the sum of scores of every row. No shuffle."""

    def run(texts: list[bytes]) -> list:
        split = [t.split() for t in texts]
        words = list(set().union(*split))
        number = {w: i for i, w in enumerate(words)}
        counts, scores = np.array(counter(path).count([w.decode() for w in words])).reshape(-1, 2).T
        places = [np.fromiter(map(number.__getitem__, s), np.int64, len(s)) for s in split]
        return [[len(s) for s in split], [int(counts[p].sum()) for p in places], [float(scores[p].sum()) for p in places]]

    return per_text(docs, key, text, FIELDS, run)
