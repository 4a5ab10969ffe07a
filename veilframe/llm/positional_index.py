"""Benchmark decontamination with a distributed positional inverted index.

`build` stores the postings of all tokens: the index is cut by documents into segments of some megabytes of text, and a
segment is one row that holds, for every term, the ascending places where it stands. Places run through the documents of a
segment with a gap between two of them. `search` looks up phrases: windows with a term that the segment has nowhere are left out at
once; of each other window it takes the list of the rarest term in the segment, shifts it to the window's start, and intersects it with
the shifted lists of the next rarer terms, until it is empty or all terms agree. No posting leaves its segment, so nothing is
shuffled and no key can be hot. With `slop`, windows that do not match are also searched by proximity: a document holds the terms of
the window, of eight or more distinct ones all but one in eight, and the three of them that are rarest in that document stand
somewhere within the length of the window plus slop words.

The test items are the query set, and the index does not depend on it. Items are taken in blocks of about BLOCK_BYTES: one block at a
time is on the driver, is broadcast, meets the stored index, and is released when its finds are written.

Words: A-Z in lower case, then [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. A window is 13 words in a row of an item, a shorter item is one window.

Defined cases: NULL and empty texts have no words and no hits; items without words have no window. Equal windows are
searched once and count for each of their items; items are told apart by their id (NULL reads as the text null). Repeated documents are
judged each. An empty test table leaves all documents clean. Other columns are not read. Documents are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import pieces, text_bytes, text_columns, written

WINDOW = 13
BLOCK_BYTES = 2 << 20
#: A document is contaminated if the hit words are at least one in so many.
SHARE = 20
#: So many of the rarest terms of a window have to stand together for a near match, within the window's length and SLOP words.
RAREST = 3
SLOP = 5
#: Of so many distinct terms of a window one may be missing in a near match.
SPARE = 8

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Items(NamedTuple):
    """Windows of a block of items, as numbers of their terms; shorter windows end with -1. The items of window k are owners[upto[k]:upto[k + 1]]."""

    names: list[str]
    terms: list[bytes]
    windows: np.ndarray
    sizes: np.ndarray
    upto: np.ndarray
    owners: np.ndarray

    def of(self, window: int) -> list[int]:
        return self.owners[self.upto[window] : self.upto[window + 1]].tolist()


def windows(rows: list[tuple[str, bytes]], width: int = WINDOW) -> Items:
    """The windows of items, given as name and text."""
    names = sorted({name for name, _ in rows})
    number = {name: i for i, name in enumerate(names)}
    terms: dict[bytes, int] = {}
    made, owner = [np.empty((0, width), np.int32)], [np.empty(0, np.int64)]
    for name, text in rows:
        own = np.array([terms.setdefault(w, len(terms)) for w in words(text)], np.int32)
        if len(own):
            padded = np.concatenate([own, np.full(max(0, width - len(own)), -1, np.int32)])
            made.append(np.lib.stride_tricks.sliding_window_view(padded, width))
            owner.append(np.full(len(made[-1]), number[name]))
    distinct, which = np.unique(np.concatenate(made), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), np.concatenate(owner)], 1), axis=0)
    upto = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
    return Items(names, list(terms), distinct, (distinct >= 0).sum(1), upto, pairs[:, 1])


class Segment(NamedTuple):
    """Postings of some documents: first place and number of words of each, and the places of the terms that are looked for, by their number."""

    first: np.ndarray
    n_words: np.ndarray
    places: dict[int, np.ndarray]


def segment(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Words per text, terms that occur, postings of each, and all places, term after term."""
    numbers: dict[bytes, int] = {}
    ids, sizes, fresh = [], [], count()
    for text in texts:
        own = words(text)
        sizes.append(len(own))
        # a term gets the number of its first place
        ids.append(np.fromiter(map(numbers.setdefault, own, fresh), np.int64, len(own)))
    n_words = np.array(sizes, np.int64)
    every = np.concatenate(ids) if ids else np.empty(0, np.int64)
    place = np.arange(len(every)) + np.repeat(np.arange(len(sizes)), n_words)
    own = np.empty(len(every), np.int32)
    own[list(numbers.values())] = np.arange(len(numbers))
    term = own[every]
    order = np.argsort(term.astype(np.uint16) if len(numbers) < 65536 else term, kind="stable")
    return n_words, sorted(numbers, key=numbers.get), np.bincount(term, minlength=len(numbers)), place[order].astype(np.int32)


def opened(n_words: np.ndarray, terms: pa.Array, counts: np.ndarray, places: np.ndarray, wanted: list[bytes]) -> Segment:
    """The postings of the wanted terms."""
    first = np.cumsum(n_words) - n_words + np.arange(len(n_words))
    ends = np.cumsum(counts)
    at = pc.index_in(pa.array(wanted, pa.binary()), value_set=terms).to_pylist()
    return Segment(first, n_words, {t: places[ends[k] - counts[k] : ends[k]] for t, k in enumerate(at) if k is not None})


def _there(places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(places, wanted)
    at[at == len(places)] = 0
    return places[at] == wanted


def phrase(places: dict[int, np.ndarray], window: list[int]) -> np.ndarray:
    """Places where the window begins; all its terms are there."""
    lists = sorted(((len(places[term]), k, places[term]) for k, term in enumerate(window)), key=lambda x: x[:2])
    _, k, got = lists[0]
    start = got - k
    for _, k, got in lists[1:]:
        start = start[_there(got, start + k)]
        if not len(start):
            break
    return start


class Spread(NamedTuple):
    """Which documents hold which terms: ascending keys term x documents + document, the places of each as places[start:end], and the keys of term t as keys[upto[t]:upto[t + 1]]."""

    documents: int
    keys: np.ndarray
    start: np.ndarray
    end: np.ndarray
    upto: np.ndarray
    places: np.ndarray


def spread(seg: Segment, terms: int) -> Spread:
    n, lists = len(seg.n_words), [seg.places.get(t, np.empty(0, np.int32)) for t in range(terms)]
    places = np.concatenate([*lists, np.empty(0, np.int32)])
    every = np.repeat(np.arange(terms), list(map(len, lists))) * n + np.searchsorted(seg.first, places, "right") - 1
    start = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.empty(0, np.int64)
    keys = every[start]
    return Spread(n, keys, start, np.append(start[1:], len(every)), np.searchsorted(keys, np.arange(terms + 1) * n), places)


def least_span(lists: list[np.ndarray]) -> int:
    """Length of the shortest run of words with a place of each list; every place is tried as its begin."""
    best = np.iinfo(np.int32).max
    for k, own in enumerate(lists):
        high, ok = own, np.ones(len(own), bool)
        for other in lists[:k] + lists[k + 1 :]:
            at = np.searchsorted(other, own)
            ok &= at < len(other)
            high = np.maximum(high, other[np.minimum(at, len(other) - 1)])
        best = min(best, int((high - own)[ok].min(initial=best - 1)) + 1)
    return best


def near(found: Spread, window: list[int], span: int) -> np.ndarray:
    """Documents that hold the terms of the window, but for one in SPARE, and the RAREST rarest of them within that many words.

    Rarity and presence are those in the document, equally rare terms go by their place in the window, so the
    other documents of the segment do not matter.
    """
    terms = np.array(list(dict.fromkeys(window)))
    spare = len(terms) // SPARE
    low, high = found.upto[terms], found.upto[terms + 1]
    # a document that misses so few terms holds one of the rarest spare + 1
    some = np.argsort(high - low, kind="stable")[: spare + 1].tolist()
    docs = np.unique(np.concatenate([found.keys[low[k] : high[k]] - terms[k] * found.documents for k in some]))
    if not len(docs):
        return docs
    wanted = terms[:, None] * found.documents + docs
    at = np.minimum(np.searchsorted(found.keys, wanted), len(found.keys) - 1)
    there = found.keys[at] == wanted
    enough = there.sum(0) >= len(terms) - spare
    if not enough.any():
        return docs[enough]
    docs, there, at = docs[enough], there[:, enough], at[:, enough]
    start, end = found.start[at], np.where(there, found.end[at], np.iinfo(np.int64).max)
    rarest = np.argsort(end - start, axis=0, kind="stable")[:RAREST].T.tolist()
    ok = [least_span([found.places[start[k, d] : end[k, d]] for k in some if there[k, d]]) <= span for d, some in enumerate(rarest)]
    return docs[np.array(ok)]


def matches(seg: Segment, items: Items, slop: int | None = None) -> tuple[list[list], list[set], list[set]]:
    """Per document: merged spans of hit words as [from, to), items hit, items near."""
    n = len(seg.n_words)
    spans, hit, close = [[] for _ in range(n)], [set() for _ in range(n)], [set() for _ in range(n)]
    there = np.zeros(len(items.terms) + 1, bool)
    there[list(seg.places)] = True
    there[-1] = True  # behind the end of short windows
    absent = (~there[items.windows]).sum(1)
    found = spread(seg, len(items.terms)) if slop is not None else None
    for w in np.flatnonzero(absent <= (items.windows.shape[1] // SPARE if slop is not None else 0)).tolist():
        window = items.windows[w, : items.sizes[w]].tolist()
        start = phrase(seg.places, window) if not absent[w] else ()
        if len(start):
            docs = np.searchsorted(seg.first, start, "right") - 1
            for d, s in zip(docs.tolist(), (start - seg.first[docs]).tolist()):
                spans[d].append((s, s + len(window)))
            for d in set(docs.tolist()):
                hit[d].update(items.of(w))
        if slop is not None:
            for d in near(found, window, len(window) + slop).tolist():
                close[d].update(items.of(w))
    return [merged(s) for s in spans], hit, [c - h for c, h in zip(close, hit)]


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def blocks(bench: DataFrame, item: str = "item_id", text: str = "text", width: int = WINDOW) -> Iterator[Items]:
    """The query set in blocks of about BLOCK_BYTES, one at a time; at least one."""
    rows = bench.select(
        F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")).alias("name"), F.col(f"`{text}`").cast("string").cast("binary").alias("text")
    ).where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = total // BLOCK_BYTES + 1
    part = F.pmod(F.xxhash64("name", "text"), F.lit(n))
    for k in range(n):
        yield windows([(r["name"], bytes(r["text"])) for r in rows.where(part == k).toLocalIterator()], width)


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index, stored in the shared folder: one row per segment."""
    slim = text_columns(docs, key, text)
    kind = slim.schema["key"].dataType
    schema = T.StructType([
        T.StructField("segment", T.LongType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("n_words", T.BinaryType()),
        T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("counts", T.BinaryType()), T.StructField("steps", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, piece in enumerate(pieces(batches)):
            n_words, found, counts, places = segment(text_bytes(piece))
            steps = np.diff(places, prepend=np.int32(0))  # small numbers; falls where a new term begins
            yield pa.RecordBatch.from_arrays([
                pa.array([task << 32 | k], pa.int64()), pa.array([piece.column("key").to_pylist()], pa.list_(piece.column("key").type)),
                pa.array([n_words.astype(np.int32).tobytes()], pa.binary()), pa.array([found], pa.list_(pa.binary())),
                pa.array([counts.astype(np.int32).tobytes()], pa.binary()), pa.array([steps.astype(np.int32).tobytes()], pa.binary()),
            ], schema.names)

    return written(slim.mapInArrow(run, schema), "index")


def search(index: DataFrame, items: Broadcast[Items], key: str = "doc_id", slop: int | None = None) -> DataFrame:
    """One row per document: segment and row in it, key, n_words, hit spans, items with a window in it, items near."""
    kind = index.schema["keys"].dataType.elementType
    names = T.ArrayType(T.StringType())
    schema = T.StructType([
        T.StructField("segment", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField(key, kind), T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("items", names), T.StructField("near_items", names),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                ints = lambda c: np.frombuffer(row.column(c)[0].as_py(), np.int32)
                seg = opened(ints("n_words"), row.column("terms").flatten(), ints("counts"), np.cumsum(ints("steps"), dtype=np.int32), own.terms)
                spans, hit, close = matches(seg, own, slop)
                n = len(spans)
                named = lambda sets: pa.array([sorted(own.names[i] for i in s) for s in sets], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([
                    pa.array([row.column("segment")[0].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), row.column("keys").flatten(),
                    pa.array(seg.n_words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), named(hit), named(close),
                ], schema.names)

    return index.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", slop: int | None = None) -> DataFrame:
    """key, n_words, spans, n_hit, items, near_items and contaminated of every row of docs."""
    index = build(docs, key, text)
    found = []
    for items in blocks(bench, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        found.append(written(search(index, shared, key, slop), "found"))
        shared.destroy()
    rows = found[0]
    if len(found) > 1:
        for f in found[1:]:
            rows = rows.unionAll(f)
        rows = rows.groupBy("segment", "row").agg(
            F.first(key).alias(key), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
            *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near_items")],
        )
        rows = rows.withColumn("near_items", F.array_except("near_items", "items"))
    # spans of one block are merged already; of several they are summed over the parts not yet covered
    hit = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("to"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["to"], s[1]).alias("to"), (acc["n"] + F.greatest(F.lit(0), s[1] - F.greatest(acc["to"], s[0]))).cast("bigint").alias("n")
        ),
        lambda acc: acc["n"],
    )
    rows = rows.withColumn("n_hit", hit)
    return rows.select(key, "n_words", "spans", "n_hit", "items", "near_items", ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def keep_clean(
    docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated.

    Rows are told apart by two hashes of key and text; the contaminated ones are written, and whether they are broadcast depends on their size.
    """
    k, t = F.col(f"`{key}`").cast("string"), F.col(f"`{text}`").cast("string")
    own = F.struct(F.xxhash64(k, F.lit("|"), t).alias("a"), F.xxhash64(t, F.lit("|"), k, F.lit(1)).alias("b"))
    marked = docs.select(own.alias("key"), t.alias("text"))
    gone = decontaminate(marked, bench, "key", "text", item, item_text).where("contaminated").select("key.*").distinct()
    gone = written(gone, "contaminated").select(F.col("a").alias("gone_a"), F.col("b").alias("gone_b"))
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), own.alias("own"))
    left = packed.join(gone, (F.col("own.a") == F.col("gone_a")) & (F.col("own.b") == F.col("gone_b")), "left_anti")
    return left.select(*[F.col("r")[c].alias(c) for c in names])


def sha_of_items(items: str = "items"):
    """Digest of the ids, sorted as text and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)
