"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each task.

Every match of the split pattern is encoded by itself. The distinct matches that a task has not met yet become
rows of an in-process DuckDB (in memory, one thread, no server). In each round of a recursive query the
token-position rows of a word meet the merge table, the leftmost pair of least rank is contracted, and words
without a mergeable pair are finished. Decoding joins (document, position, id) rows to the vocabulary and puts the bytes
together by an ordered aggregate.

A word beyond LONG bytes is cut into pieces that go through the same query, since a list per round costs the square of its
length. That is exact by this rule: tokens t1 … tn are the encoding of their bytes if and only if, for each two neighbours, the bytes of both
encode to these two. (No pair across a border is contracted in the one exactly if none is in the other: as long as no border was
crossed, the contractions inside two neighbours come in the same order whatever surrounds them.) So each border of two pieces
is tested by encoding its two neighbours; where they do not stay apart, the tokens around the border are encoded anew as one
piece, twice as many in each round, and the borders of that piece are tested in their turn.

Defined cases: NULL is the empty text, which has no ids. Repeated rows and keys are encoded each for themselves. Other columns
are not read. Texts are cut for memory only between documents, never inside. An id outside the vocabulary fails the decoding.

Memory of a worker: equal parts of texts are one string, new words are learned some at a time, shorter ones first, and after each piece of a
task DuckDB is closed and free memory goes back to the system, since Spark keeps the worker for later stages. The words stay.
"""

from __future__ import annotations

import base64
import ctypes
import hashlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import per_text

#: Words that a worker remembers; beyond that only those of the present texts stay. More words take more memory and less time.
REMEMBERED = 200_000
#: Unknown parts of texts that are split and encoded at once: that share of the remembered words, LEAST at least. Fewer take more time and less memory.
SHARE, LEAST = 5, 1000
#: Bytes beyond which a word is encoded in pieces, and bytes of such a piece.
LONG, PIECE = 256, 48
#: Squares of the lengths of words that are encoded at once.
ROUND_CELLS = 10_000_000
#: Tokens on each side of a border that are encoded anew at first.
AROUND = 4
#: Ids that are decoded at once.
DECODED = 500_000

# A word is one row with the list of its tokens; places count from 1.
CONTRACT = """
WITH RECURSIVE walk(word, toks) AS (
    SELECT word, list(tok ORDER BY pos) FROM symbols GROUP BY word
    UNION ALL
    SELECT w.word, w.toks[:(p.best & 1048575) - 1] || [(p.best >> 20)::INTEGER] || w.toks[(p.best & 1048575) + 2:]
    FROM walk w JOIN (
        SELECT word, min((m.merged::BIGINT << 20) | place) AS best
        FROM (SELECT word, unnest(toks[:-2]) AS a, unnest(toks[2:]) AS b, unnest(range(1, len(toks))) AS place FROM walk) t
        JOIN merges m ON m.pair = ((t.a::BIGINT << 20) | t.b)
        GROUP BY word) p USING (word))
SELECT word, array_to_string(arg_min(toks, len(toks)), ' ') AS ids FROM walk GROUP BY word
"""

DECODE = """
SELECT doc, string_agg(hex, '' ORDER BY pos) AS hex, count(*) AS n
FROM pieces JOIN vocab USING (tok) GROUP BY doc
"""


class Codec:
    """The vocabulary of one rank file in an in-process DuckDB, and the words met so far."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        self.remembered, self.learned = remembered, max(LEAST, remembered // SHARE)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.spaces = regex.compile(r"\s\s").search
        self.whole = {w.decode(): b"%d" % r for w, r in ranks.items() if _is_text(w)}
        self.words = dict(self.whole)  # a word that is a token is encoded as that token
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        made = [(ranks[w[:i]], ranks[w[i:]], r) for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks]
        a, b, merged = np.array(made, np.int64).T
        self.merges = pa.table({"pair": (a << 20) | b, "merged": merged.astype(np.int32)})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))
        self.vocab = pa.table({"tok": np.array(list(ranks.values()), np.int32), "hex": [w.hex() for w in ranks]})

    @cached_property
    def con(self) -> duckdb.DuckDBPyConnection:
        """The database with the merge table and the vocabulary, opened when it is needed."""
        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        for name, rows in (("merges", self.merges), ("vocab", self.vocab)):
            con.register("made", rows)
            con.execute(f"CREATE TABLE {name} AS SELECT * FROM made")
            con.unregister("made")
        return con

    def rest(self) -> None:
        """Close the database and give free memory back to the system; the words stay known."""
        if "con" in self.__dict__:
            self.con.close()
            del self.con
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet."""
        raw = [w.encode() for w in words]
        made = self.contracted([d for d in raw if len(d) <= LONG])
        if len(made) < len(raw):
            made |= {d: " ".join(map(str, ids)) for d, ids in self.in_pieces([d for d in raw if len(d) > LONG]).items()}
        for w, data in zip(words, raw):
            self.words[w] = made[data].encode()

    def ids_of(self, parts: list[bytes]) -> dict[bytes, list[int]]:
        return {p: list(map(int, ids.split())) for p, ids in self.contracted(parts).items()}

    def contracted(self, parts: list[bytes]) -> dict[bytes, str]:
        """The decimal ids of each part, joined by a space: the leftmost pair of least rank is contracted until none is left."""
        out: dict[bytes, str] = {}
        # the recursion keeps what a word was in each round
        upto = np.cumsum([len(p) ** 2 for p in parts])
        at = 0
        while at < len(parts):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ROUND_CELLS, "right")))
            some, at = parts[at:end], end
            sizes = np.array(list(map(len, some)))
            data = np.frombuffer(b"".join(some), np.uint8)
            word = np.repeat(np.arange(len(some), dtype=np.int32), sizes)
            pos = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            self.con.register("symbols", pa.table({"word": word, "pos": pos.astype(np.int32), "tok": self.single[data]}))
            found = self.con.sql(CONTRACT).to_arrow_table()
            out.update(zip(map(some.__getitem__, found["word"].to_pylist()), found["ids"].to_pylist()))
        return out

    def in_pieces(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """The ids of long words, from pieces whose borders are tested and mended."""
        cut = [[w[a : a + PIECE] for a in range(0, len(w), PIECE)] for w in words]
        known = self.ids_of(list(dict.fromkeys(p for c in cut for p in c)))
        # places of tokens as bytes, and which of them are borders still to be tested
        state = []
        for c in cut:
            ids = [i for p in c for i in known[p]]
            state.append((ids, set(range(PIECE, sum(map(len, c)), PIECE)), AROUND))
        todo = [k for k in range(len(words)) if state[k][1]]
        while todo:
            pairs: dict[bytes, list[int]] = {}
            tested = []
            for k in todo:
                ids, borders, _ = state[k]
                ends = np.cumsum(self.sizes[ids])
                at = np.searchsorted(ends, sorted(borders))  # the token before each border
                first = ends[at] - self.sizes[np.array(ids)[at]]
                own = [words[k][a:b] for a, b in zip(first.tolist(), ends[at + 1].tolist())]
                pairs |= dict.fromkeys(own)
                tested.append((k, ends, at, own))
            pairs = self.ids_of(list(pairs))
            windows = []
            for k, ends, at, own in tested:
                ids, _, around = state[k]
                spans: list[list[int]] = []
                for i, p in zip(at.tolist(), own):
                    if pairs[p] != ids[i : i + 2]:
                        a, b = max(0, i + 1 - around), min(len(ids), i + 1 + around)
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(b, spans[-1][1])
                        else:
                            spans.append([a, b])
                windows += [(k, a, b, words[k][int(ends[a - 1]) if a else 0 : int(ends[b - 1])], int(ends[a - 1]) if a else 0, int(ends[b - 1])) for a, b in spans]
            anew = self.ids_of(list(dict.fromkeys(w[3] for w in windows)))
            by_word: dict[int, list[tuple]] = {}
            for k, a, b, data, start, end in windows:
                by_word.setdefault(k, []).append((a, b, anew[data], start, end))
            for k in todo:
                ids, _, around = state[k]
                made, last, borders = [], 0, set()
                for a, b, new, start, end in by_word.get(k, []):
                    made += ids[last:a] + new
                    last = b
                    borders |= {start, end} - {0, len(words[k])}
                state[k] = (made + ids[last:], borders, 2 * around)
            todo = [k for k in todo if state[k][1]]
        return {w: s[0] for w, s in zip(words, state)}

    def parts(self, text: str) -> list[str]:
        """The text cut where two matches of the pattern meet in any case: before a space and around a line break,
        if no two characters of white space stand in a row; otherwise at each match."""
        if "\0" in text or self.spaces(text):
            return self.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The decimal ids of each text, joined by one space."""
        one: dict[str, str] = {}
        split = [list(map(one.setdefault, s, s)) for s in map(self.parts, texts)]
        if len(self.words) > self.remembered:
            self.words = {w: self.words[w] for w in one.keys() & self.words.keys()} | self.whole
        known = self.words
        unknown = sorted(one.keys() - known.keys(), key=len)  # a round of the query costs the same for few words, and long ones need many
        for at in range(0, len(unknown), self.learned):
            new = {p: self.split(p) for p in unknown[at : at + self.learned]}
            words = {w for s in new.values() for w in s}.difference(known)
            if words:
                self.learn(sorted(words, key=len))
            for part, made in new.items():
                if len(made) != 1:
                    known[part] = b" ".join([known[w] for w in made])
        return [b" ".join(filter(None, map(known.__getitem__, s))) for s in split]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each list of ids; ids holds them one after another."""
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        pos = np.arange(len(ids), dtype=np.int32)
        self.con.register("pieces", pa.table({"doc": doc, "pos": pos, "tok": ids}))
        out = self.con.sql(DECODE).to_arrow_table()
        texts = [b""] * len(sizes)
        for d, digits, n in zip(out["doc"].to_pylist(), out["hex"].to_pylist(), out["n"].to_pylist()):
            if n != sizes[d]:
                raise ValueError("ids outside the vocabulary")
            texts[d] = bytes.fromhex(digits)
        return texts


def _is_text(word: bytes) -> bool:
    try:
        word.decode()
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(2)
def codec(path: str, pattern: str, remembered: int = REMEMBERED) -> Codec:
    """One per worker and vocabulary."""
    return Codec(path, pattern, remembered)


ENCODED = [
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
]


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_tokens, ids_sha256 (of the decimal ids joined by a space) and ids of every row. No shuffle."""

    def run(texts: list[bytes]) -> list:
        made, ids, sizes = encoded_texts(texts, path, pattern)
        codec(path, pattern).rest()
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids))
        return [pa.array(sizes), [hashlib.sha256(m).hexdigest() for m in made], lists]

    return per_text(docs, key, text, ENCODED, run)


def encoded_texts(texts: list[bytes], *vocabulary) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Decimal ids of each text joined by a space, all ids, and their number per text."""
    made = codec(*vocabulary).encode([t.decode() for t in texts])
    lists = [np.fromstring(m, np.int32, sep=" ") if m else np.empty(0, np.int32) for m in made]
    return made, np.concatenate(lists), np.array([len(x) for x in lists])


DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Key, n_tokens and digests of the ids and of the bytes they decode to. Encoding and decoding share a worker, so no ids travel."""
    own = (path, pattern, remembered)

    def run(texts: list[bytes]) -> list:
        made, ids, sizes = encoded_texts(texts, *own)
        digests: list[str] = []
        for start, end in _runs(sizes):
            first = sizes[:start].sum()
            decoded = codec(*own).decode(ids[first : first + sizes[start:end].sum()], sizes[start:end])
            digests += [hashlib.sha256(d).hexdigest() for d in decoded]
        codec(*own).rest()
        return [pa.array(sizes), [hashlib.sha256(m).hexdigest() for m in made], digests]

    return per_text(docs, key, text, DIGESTS, run)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the bytes of their ids as a binary column in the place of the ids. NULL ids are no ids."""
    rest = [c for c in encoded.columns if c not in (ids, into)]
    source = encoded.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(f"`{ids}`").cast("array<int>"), F.array().cast("array<int>")).alias(ids))
    out = T.StructType([*[f for f in source.schema.fields if f.name != ids], T.StructField(into, T.BinaryType())])
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _by_size(batch, ids):
                lists = piece.column(ids)
                sizes = np.diff(lists.offsets.to_numpy())
                values = lists.flatten().to_numpy(zero_copy_only=False)
                texts = codec(path, pattern).decode(values, sizes)
                codec(path, pattern).rest()
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in rest], pa.array(texts, pa.binary())], names)

    return source.mapInArrow(run, out)


def _by_size(batch: pa.RecordBatch, ids: str) -> Iterator[pa.RecordBatch]:
    for start, end in _runs(np.diff(batch.column(ids).offsets.to_numpy())):
        yield batch.slice(start, end - start)


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about DECODED ids."""
    upto, start = np.cumsum(sizes), 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + DECODED, "right")))
        yield start, end
        start = end
