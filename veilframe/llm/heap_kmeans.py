"""Centroid clustering of whole-number vectors with heap-ordered bounds.

Each cluster keeps a heap of its vectors, ordered by lower minus upper bound: the distance to the second nearest centroid minus
that to the own one, when they were last measured. A round moves the centroids; the gap of every vector of cluster a shrinks
by at most the drift of a plus the largest drift of the others. That is added to one number per cluster, and a vector enters
the heap with its gap plus the number of that moment. So a round pops only vectors whose gap has expired, scans
them exactly against all centroids, and pushes them where they belong; all others are known to stay, without being looked at.

Vectors live in blocks of some thousands, and each block has its own heap per cluster. Blocks with their heaps are written after each
round, so lineage ends there. A task adds to the sums of a cluster only what its moved vectors change; these differences are
summed by Spark, and the driver holds sums, centroids and drifts: clusters x components numbers, at any number of vectors.

Arithmetic is exact: components are floor(scale * x), distances are squared and whole, a centroid is floor(sum / count) per
component. Bounds are kept a little tighter than measured, so that rounding never hides an expired gap; equal distances have
no gap and are scanned in each round. Ties go to the smaller number of a cluster. Empty clusters stay where they are.

Defined cases: vectors that are NULL, of another width, or with a component that is NULL or not finite are left out. The first centroids
are the vectors of least sha256 of `seed:key`, equal hashes by their components; a NULL key comes last. With fewer vectors than
clusters there are as many clusters as vectors. Repeated rows are vectors each. An empty table gives an empty result. Other columns
are not read. Components beyond 2^27 after scaling stop the job, as their distances do not fit into a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import written
from veilframe.llm.vectors import SCHEMA, blocks, each, finite, keys_of

CLUSTERS, ROUNDS, WIDTH, SCALE, SEED = 16, 3, 64, 64, "1"
#: Bounds are kept by so much tighter, relative to the distances that they are made of.
SLACK = 1e-9

STATE = T.StructType([
    *[f for f in SCHEMA.fields if f.name != "labels"],
    T.StructField("gaps", T.BinaryType()), T.StructField("rows", T.BinaryType()), T.StructField("sizes", T.BinaryType()),
    T.StructField("scans", T.BinaryType()), T.StructField("change", T.ArrayType(T.LongType())),
])


class Clusters(NamedTuple):
    """key, cluster, distance (squared) and scans of every vector, as a written table, and the centroids."""

    rows: DataFrame
    centroids: np.ndarray


def distances(cells: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each vector to each centroid, in whole numbers."""
    out = np.empty((len(cells), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        step = cells - c
        out[:, k] = np.einsum("ij,ij->i", step, step)
    return out


def scan(cells: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector, and the gap between the second nearest and it."""
    d = distances(cells.astype(np.int64), centroids)
    own = d.argmin(1)
    if len(centroids) == 1:
        return own, np.full(len(d), np.inf)
    near, second = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(float)).T
    return own, second - near - SLACK * (1 + second + near)


class Heaps:
    """One heap per cluster over the vectors of a block."""

    def __init__(self, heaps: list[list[tuple[float, int]]]):
        self.heaps = heaps

    @classmethod
    def opened(cls, row: dict) -> Heaps:
        gaps, rows = np.frombuffer(row["gaps"]).tolist(), np.frombuffer(row["rows"], np.int32).tolist()
        ends = np.cumsum(np.frombuffer(row["sizes"], np.int32)).tolist()
        return cls([list(zip(gaps[a:b], rows[a:b])) for a, b in zip([0, *ends], ends)])

    def expired(self, spent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take the vectors whose gap is used up: rows and the clusters they were in."""
        rows, was = [], []
        for a, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= spent[a]:
                rows.append(heappop(heap)[1])
                was.append(a)
        return np.array(rows, np.int64), np.array(was, np.int64)

    def push(self, rows: np.ndarray, own: np.ndarray, gaps: np.ndarray) -> None:
        for r, a, g in zip(rows.tolist(), own.tolist(), gaps.tolist()):
            heappush(self.heaps[a], (g, r))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        flat = [x for h in self.heaps for x in h]
        gaps, rows = (np.array([x[i] for x in flat], t) for i, t in ((0, np.float64), (1, np.int32)))
        return gaps.tobytes(), rows.tobytes(), np.array([len(h) for h in self.heaps], np.int32).tobytes()

    def own(self, n: int) -> np.ndarray:
        """The cluster of each vector."""
        out = np.empty(n, np.int64)
        for a, heap in enumerate(self.heaps):
            out[[r for _, r in heap]] = a
        return out


def _sums(cells: np.ndarray, own: np.ndarray, clusters: int) -> np.ndarray:
    """Sum of the vectors of each cluster, and their number as last column."""
    out = np.zeros((clusters, cells.shape[1] + 1), np.int64)
    np.add.at(out, own, np.hstack([cells, np.ones((len(cells), 1), np.int64)]))
    return out


def _state(row: dict, heaps: Heaps, scans: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    values = [row["keys"], row["width"], row["cells"], *heaps.packed(), scans.astype(np.int32).tobytes(), change.ravel().tolist()]
    kinds = [pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], STATE.names)


def _cells(row: dict) -> np.ndarray:
    return np.frombuffer(row["cells"], np.int32).reshape(-1, row["width"])


def first_round(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Blocks with heaps after a scan of all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            cells = _cells(row)
            own, gaps = scan(cells, centroids)
            heaps = [list(zip(gaps[own == a].tolist(), np.flatnonzero(own == a).tolist())) for a in range(len(centroids))]
            for heap in heaps:
                heapify(heap)
            yield _state(row, Heaps(heaps), np.ones(len(cells)), _sums(cells, own, len(centroids)))

    return vectors.mapInArrow(run, STATE)


def rescan(row: dict, centroids: np.ndarray, spent: np.ndarray) -> tuple[Heaps, np.ndarray, np.ndarray]:
    """The heaps of a block after a round, scans of each vector, and what changes in the sums."""
    cells, heaps = _cells(row), Heaps.opened(row)
    rows, was = heaps.expired(spent)
    own, gaps = scan(cells[rows], centroids)
    heaps.push(rows, own, gaps + spent[own])
    scans = np.frombuffer(row["scans"], np.int32).copy()
    scans[rows] += 1
    moved = own != was
    k = len(centroids)
    return heaps, scans, _sums(cells[rows[moved]], own[moved], k) - _sums(cells[rows[moved]], was[moved], k)


def next_round(state: DataFrame, centroids: np.ndarray, spent: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            yield _state(row, *rescan(row, centroids, spent))

    return state.mapInArrow(run, STATE)


def last_round(state: DataFrame, centroids: np.ndarray, spent: np.ndarray, key: str) -> DataFrame:
    """key, cluster, distance and scans of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            heaps, scans, _ = rescan(row, centroids, spent)
            cells = _cells(row)
            own = heaps.own(len(cells))
            step = cells - centroids[own]
            far = np.einsum("ij,ij->i", step, step)
            keys = keys_of(np.frombuffer(row["keys"], np.int64))
            yield pa.RecordBatch.from_arrays([keys, pa.array(own, pa.int32()), pa.array(far), pa.array(scans)], names)

    names = [key, "cluster", "distance", "scans"]
    return state.mapInArrow(run, f"`{key}` long, cluster int, distance long, scans int")


def _changes(state: DataFrame, shape: tuple[int, int]) -> list[list[int]]:
    """Sums over all blocks; as many rows as centroids have components reach the driver."""
    cells = state.select(F.posexplode("change").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out = [[0] * shape[1] for _ in range(shape[0])]
    for at, v in cells:
        out[at // shape[1]][at % shape[1]] = int(v)
    return out


def seeds(vectors: DataFrame, key: str, vector: str, clusters: int, scale: int, seed: str) -> np.ndarray:
    """The first centroids."""
    whole = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda x: F.floor(x * scale))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{key}`").cast("string")), 256)
    rows = vectors.select(hashed.alias("h"), whole.alias("v")).orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH,
    scale: int = SCALE, seed: str = SEED,
) -> Clusters:
    """Assign and move centroids for so many rounds, then assign once more."""
    v = F.col(f"`{vector}`")
    kept = vectors.where((F.size(v) == width) & finite(v.cast("array<double>")))
    centroids = seeds(kept, key, vector, clusters, scale, seed)
    if not len(centroids):
        empty = kept.select(F.col(f"`{key}`").cast("bigint").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"), F.lit(0).alias("scans"))
        return Clusters(empty.limit(0), np.empty((0, width), np.int64))
    k = len(centroids)
    totals = [[0] * (width + 1) for _ in range(k)]
    spent = np.zeros(k)
    state = None
    for n in range(rounds):
        made = first_round(blocks(kept, key, vector, scale), centroids) if state is None else next_round(state, centroids, spent)
        state = written(made, f"round{n}")
        totals = [[a + b for a, b in zip(*rows)] for rows in zip(totals, _changes(state, (k, width + 1)))]
        moved = np.array([[s // t[-1] for s in t[:-1]] if t[-1] else c.tolist() for t, c in zip(totals, centroids)], np.int64)
        drift = np.sqrt(((moved - centroids) ** 2).sum(1).astype(float))
        others = np.array([max([0.0, *drift[:a], *drift[a + 1 :]]) for a in range(k)])
        spent = (spent + drift + others) * (1 + SLACK)
        centroids = moved
    if state is None:
        state = written(first_round(blocks(kept, key, vector, scale), centroids), "round")
    return Clusters(written(last_round(state, centroids, spent, key), "assigned"), centroids)


def digest(centroid: np.ndarray) -> str:
    """Components as decimal numbers joined by commas."""
    return ",".join(map(str, centroid.tolist()))
