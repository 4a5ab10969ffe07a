"""Hard negatives of anchor vectors, with bounds along a spanning tree of the anchors.

The positives of an anchor are its best rows of the same label, by inner product. For each positive, the negatives are the best rows of
another label whose score lies in a window below the positive's score.

Anchors are the query set. They are cut into blocks of about ANCHORS rows; a task joins the anchors of a block by a minimum spanning
tree. Each block is broadcast in its turn and meets all rows, which were written once as blocks of vectors, in two passes: the
first finds positives, the second negatives. In a pass the tree is walked from its root. A child differs from its parent by an edge
of known length, so its score with a row lies within edge length times the norm of the row around the parent's score (or around the
bounds of the parent's score, if that was not computed). Only rows whose bounds overlap a window that is still open are scored
exactly: a window reaches from its lower end, or from the worst score kept so far once it is full, to its upper end.

Every task returns at most as many rows per anchor and window as are asked for; these meet in two steps, by parts of the
tasks and then by anchor. No pairs are made beside them. A block of anchors has a fixed size, so what is broadcast does not
grow with the table; the number of passes does. Results of a block are written, so a lost executor costs one block at most.

Defined cases: rows with a NULL label, a NULL vector, or a component that is NULL or not finite take no part. Components are
floor(scale * x); shorter vectors count as if zeros followed. A row with the anchor's key is neither positive nor negative of it. Repeated rows are rows each, but
equal anchors are one. A row with a NULL key is no anchor; as a positive or negative it sorts behind all others of its score. An empty
table, or one without anchors, gives an empty result. Other columns are not read. Scores beyond 2^62 stop the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import written
from veilframe.llm.vectors import NONE, Block, blocks, each, finite, opened
from veilframe.session import scratch_dir

#: Anchors of a block, which is broadcast.
ANCHORS = 1024
POSITIVES, NEGATIVES, SCALE = 5, 3, 256
#: A negative scores between these hundredths of its positive's score.
LOW, HIGH = 50, 95
#: Tasks whose finds meet in the first step.
PARTS = 64

TREE = "block int, row int, key long, label long, vector array<long>, parent int, edge double"


class Anchors(NamedTuple):
    """A block of anchors in the order of the walk: a parent stands before its children, the root is its own parent."""

    rows: np.ndarray
    keys: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    parents: np.ndarray
    edges: np.ndarray

    def last_use(self) -> np.ndarray:
        """The last anchor whose bounds hang on each one."""
        last = np.arange(len(self.rows))
        np.maximum.at(last, self.parents, np.arange(len(self.rows)))
        return last


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the walk, parent of each vector, and length of the edge to it (Prim)."""
    n = len(vectors)
    v = vectors.astype(float)
    near, parent = np.full(n, np.inf), np.zeros(n, np.int64)
    near[0] = 0
    left, order, edge = np.ones(n, bool), [], np.zeros(n)
    for _ in range(n):
        at = int(np.where(left, near, np.inf).argmin())
        left[at] = False
        order.append(at)
        edge[at] = near[at]
        d = np.sqrt(((v - v[at]) ** 2).sum(1))
        closer = left & (d < near)
        near[closer], parent[closer] = d[closer], at
    return np.array(order), parent, edge


def trees(anchors: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Anchors with their place in the tree of their block, as a written table, and the number of blocks."""
    anchors = written(anchors.distinct(), "anchors")
    n = -(-anchors.count() // size)
    if not n:
        return anchors, 0
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("key", "label", "vector"), F.lit(n)).cast("int"))

    def grown(rows: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, rows["vector"]))
        v = np.zeros((len(rows), width), np.int64)
        for i, own in enumerate(rows["vector"]):
            v[i, : len(own)] = own
        order, parent, edge = spanning_tree(v)
        place = np.argsort(order)
        rows = rows.iloc[order]
        return rows.assign(row=np.arange(len(rows), dtype=np.int32), parent=place[parent[order]].astype(np.int32), edge=edge[order])[
            ["block", "row", "key", "label", "vector", "parent", "edge"]
        ]

    return written(dealt.groupBy("block").applyInPandas(grown, TREE), "trees"), n


def anchors_of(trees: DataFrame, block: int) -> Anchors:
    """A block of at most some thousand anchors, for a broadcast."""
    rows = trees.where(F.col("block") == block).orderBy("row").collect()
    width = max(len(r["vector"]) for r in rows)
    v = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        v[i, : len(r["vector"])] = r["vector"]
    col = lambda c, t: np.array([r[c] for r in rows], t)
    return Anchors(col("row", np.int64), col("key", np.int64), col("label", np.int64), v, col("parent", np.int64), col("edge", float))


def scores(cells: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers; the longer side is cut to the shorter, as zeros follow that."""
    n = min(cells.shape[1], len(vector))
    return cells[:, :n] @ vector[:n]


class Best:
    """The first rows by score (higher first) and key (smaller first) among those met so far."""

    def __init__(self, many: int):
        self.many, self.scores, self.keys = many, np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self) -> float:
        """The score a row needs to come in."""
        return -np.inf if len(self.scores) < self.many else int(self.scores[-1])

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        s, k = np.concatenate([self.scores, scores]), np.concatenate([self.keys, keys])
        first = np.lexsort((k, -s))[: self.many]
        self.scores, self.keys = s[first], k[first]


class Wanted(NamedTuple):
    """What a pass looks for: per anchor some windows of scores, lower and upper ends included, and what was found in each."""

    same_label: bool
    low: list[np.ndarray]
    high: list[np.ndarray]
    found: list[list[Best]]


def windows_of(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score between low and high hundredths of the positive's score."""
    return -((-low * positive) // 100), (high * positive) // 100


def walk(block: Block, anchors: Anchors, wanted: Wanted) -> int:
    """Meet a block of rows with all anchors along the tree; returns how many scores were computed."""
    cells = block.cells.astype(np.int64)
    norms = np.sqrt((cells.astype(float) ** 2).sum(1)) * (1 + 1e-12)
    largest = np.sqrt((anchors.vectors.astype(float) ** 2).sum(1).max(initial=0))
    if norms.max(initial=0) * largest >= 2.0**62:
        raise ValueError("a score may be beyond 2^62")
    slack = 1e-6 + 1e-14 * largest * norms  # rounding of scores and bounds
    last, bounds, computed = anchors.last_use(), {}, 0
    for i in range(len(anchors.rows)):
        p = int(anchors.parents[i])
        if p == i:
            lower, upper = np.full(len(cells), -np.inf), np.full(len(cells), np.inf)
        else:
            reach = anchors.edges[i] * norms * (1 + 1e-12) + slack
            lower, upper = bounds[p][0] - reach, bounds[p][1] + reach
            if last[p] == i:
                del bounds[p]
        open_ = (block.labels == anchors.labels[i]) == wanted.same_label
        open_ &= block.keys != anchors.keys[i]
        low, high, found = wanted.low[i], wanted.high[i], wanted.found[i]
        met = np.zeros(len(cells), bool)
        for a, b, best in zip(low, high, found):
            met |= (upper >= max(a, best.least())) & (lower <= b)
        met &= open_
        if p == i:
            met[:] = True  # the root is scored with all rows
        at = np.flatnonzero(met)
        if len(at):
            exact = scores(cells if len(at) == len(cells) else cells[at], anchors.vectors[i])
            computed += len(at)
            lower[at] = upper[at] = exact
            fit = open_[at]
            for a, b, best in zip(low, high, found):
                own = fit & (exact >= max(a, best.least())) & (exact <= b)
                if own.any():
                    best.add(exact[own], block.keys[at[own]])
        if last[i] > i:
            bounds[i] = (lower, upper)
    return computed


def _pass(rows: DataFrame, anchors: Anchors, many: int, same: bool, low: list[np.ndarray], high: list[np.ndarray]) -> DataFrame:
    """row (of the anchor), window, score, key and rank of the first rows in each window."""
    shared = rows.sparkSession.sparkContext.broadcast((anchors, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, low, high = shared.value
        found = [[Best(many) for _ in ends] for ends in low]
        wanted = Wanted(same, low, high, found)
        for row in each(batches):
            walk(opened(row), anchors, wanted)
        task = TaskContext.get().partitionId()
        out = [
            (r, w, s, k) for r, windows in enumerate(found) for w, best in enumerate(windows) for s, k in zip(best.scores.tolist(), best.keys.tolist())
        ]
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([
                pa.array([task % PARTS] * len(out), pa.int32()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                pa.array(cols[3], pa.int64()),
            ], ["part", "row", "window", "score", "key"])

    made = rows.mapInArrow(run, "part int, row int, window int, score long, key long")
    order = [F.desc("score"), F.asc("key")]
    for by in (["row", "window", "part"], ["row", "window"]):
        made = made.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= many)
    return made.drop("part")


def mine(
    vectors: DataFrame, anchor: Column, label: Column | None = None, key: str = "vec_id", vector: str = "embedding", positives: int = POSITIVES,
    negatives: int = NEGATIVES, scale: int = SCALE, low: int = LOW, high: int = HIGH, size: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor says which rows are anchors, label what the label of a row is (the column label, if not given).
    """
    spark = vectors.sparkSession
    label = F.col("label") if label is None else label
    v = F.col(f"`{vector}`").cast("array<double>")
    taken = vectors.where(label.isNotNull() & finite(v))
    rows = written(blocks(taken, key, vector, scale, label), "vectors")
    chosen = taken.where(F.coalesce(anchor, F.lit(False)) & F.col(f"`{key}`").isNotNull())
    whole = F.transform(v, lambda x: F.floor(x * scale))
    grown, n = trees(chosen.select(F.col(f"`{key}`").cast("bigint").alias("key"), label.cast("bigint").alias("label"), whole.alias("vector")), size)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    folder = scratch_dir(spark)
    for b in range(n):
        _block(rows, grown, b, positives, negatives, low, high).write.parquet(f"{folder}/mined/block={b}")
    return spark.read.schema(schema).parquet(f"{folder}/mined").drop("block")


def _block(rows: DataFrame, grown: DataFrame, block: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result of one block of anchors; it holds positives x anchors rows on the driver, a fixed number."""
    spark = rows.sparkSession
    anchors = anchors_of(grown, block)
    n = len(anchors.rows)
    near = _pass(rows, anchors, positives, True, [np.array([-np.inf])] * n, [np.array([np.inf])] * n).collect()
    best: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for r in sorted(near, key=lambda r: r["rank"]):
        best[r["row"]].append((r["score"], r["key"]))
    ends = [windows_of(np.array([s for s, _ in b], np.int64), low, high) for b in best]
    found = _pass(rows, anchors, negatives, False, [e[0] for e in ends], [e[1] for e in ends])
    known = [(i, w, int(anchors.keys[i]), None if k == NONE else k, s) for i, b in enumerate(best) for w, (s, k) in enumerate(b)]
    pairs = spark.createDataFrame(known, "row int, window int, anchor_id long, positive_id long, positive_score long")
    return found.join(F.broadcast(pairs), ["row", "window"]).select(
        "anchor_id", "positive_id", "rank", F.when(F.col("key") != NONE, F.col("key")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
