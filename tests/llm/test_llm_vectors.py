"""Clustering and hard negatives against plain versions, over odd vectors, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_llm_operators import connect

import __spark_entry__ as entry
import check
from veilframe.llm import hard_negatives, heap_kmeans, queries

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance int, score int"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, y, "x", 1, 2) for k, v, y in rows], SCHEMA)


def odd(rng, n=300):
    """Vectors of 64 components in groups, with ties, repeated rows, and rows that take no part."""
    centres = [[rng.gauss(0, 0.4) for _ in range(64)] for _ in range(9)]
    rows = [(k, [x + rng.gauss(0, 0.05) for x in centres[k % 9]], rng.randrange(3)) for k in range(n)]
    rows += [(1000 + k, centres[0], k % 2) for k in range(40)]  # equal vectors under other keys
    rows += [rows[7], rows[7], rows[50], (None, centres[1], 1), (2000, None, 1), (2001, centres[2], None)]
    for bad in (math.nan, math.inf, -math.inf, None):
        rows.append((2002, [bad, *centres[3][1:]], 1))
    rng.shuffle(rows)
    return rows


def plain_clusters(rows, clusters=16, rounds=3):
    kept = [(k, tuple(math.floor(64 * np.float64(np.float32(x))) for x in v)) for k, v, _ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((k is None, hashlib.sha256(f"1:{k}".encode()).hexdigest() if k is not None else "", v) for k, v in kept)
    centres = [v for _, _, v in first[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for step in range(rounds + 1):
        own = [min((far(v, c), i) for i, c in enumerate(centres)) for _, v in kept]
        if step < rounds:
            for i in range(len(centres)):
                group = [v for (_, v), (_, o) in zip(kept, own) if o == i]
                if group:
                    centres[i] = tuple(sum(x) // len(group) for x in zip(*group))
    return sorted((k is None, k or 0, i, d) for (k, _), (d, i) in zip(kept, own)), centres


@pytest.mark.parametrize("n", [300, 5])
def test_clusters_by_brute_force(spark, n):
    rows = odd(random.Random(n), n) if n > 5 else [(k, [float(k % 3)] * 64, 0) for k in range(n)] + [(9, [1.0] * 63, 0)]
    found = heap_kmeans.cluster(vectors(spark, rows).repartition(5))
    want, centres = plain_clusters(rows)
    got = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"]) for r in found.rows.collect())
    assert got == want and [tuple(c) for c in found.centroids.tolist()] == centres


def test_clusters_equal_sql_on_odd_rows(spark, tmp_path):
    df = vectors(spark, odd(random.Random(4)))
    con = connect(tmp_path, embeddings=df)
    made = queries.op11_heap_kmeans(spark, saved(df, tmp_path))
    assert check.compare(made, con, queries.SQL["op11_heap_kmeans"]) == []


def saved(df, tmp_path):
    df.write.parquet(f"{tmp_path}/sf/embeddings.parquet")
    return f"{tmp_path}/sf"


def test_only_expired_gaps_are_scanned(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 2) for _ in range(64)] for _ in range(16)]
    rows = [(k, [x + rng.gauss(0, 0.02) for x in centres[k % 16]], 0) for k in range(400)]
    df = vectors(spark, rows)
    found = heap_kmeans.cluster(df, rounds=8)
    assert [r for r in plain_clusters(rows, rounds=8)[0]] == sorted((False, r["vec_id"], r["cluster"], r["distance"]) for r in found.rows.collect())
    # at rest after some rounds: far fewer scans than nine for each vector
    assert found.rows.agg(F.sum("scans")).first()[0] < 4 * len(rows)


def test_clusters_of_nothing_and_of_one(spark):
    none = heap_kmeans.cluster(vectors(spark, [(1, None, 0), (2, [1.0], 0)]))
    assert none.rows.columns == ["vec_id", "cluster", "distance", "scans"] and none.rows.count() == 0
    one = heap_kmeans.cluster(vectors(spark, [(1, [0.5] * 64, 0)]), rounds=0).rows.collect()
    assert [tuple(r) for r in one] == [(1, 0, 0, 1)]
    with pytest.raises(Exception, match="after scaling"):
        heap_kmeans.cluster(vectors(spark, [(1, [1e30] * 64, 0)]))


def plain_negatives(rows, anchor, label, positives=5, negatives=3):
    kept = [(k, y, [math.floor(256 * float(np.float32(x))) for x in v]) for k, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(k, label(k, y), v) for k, y, v in kept]
    anchors = {(k, y, tuple(v)) for k, y, v in kept if k is not None and anchor(k)}
    out = []
    for a, ya, va in anchors:
        ranked = sorted((-sum(x * z for x, z in zip(va, v)), k is None, k or 0, y) for k, y, v in kept if k != a)
        for s, none, p, _ in [r for r in ranked if r[3] == ya][:positives]:
            fit = [r for r in ranked if r[3] != ya and 50 * -s <= 100 * -r[0] <= 95 * -s][:negatives]
            out += [(a, None if none else p, i + 1, None if r[1] else r[2], -s, -r[0]) for i, r in enumerate(fit)]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [3, 1024])
def test_negatives_by_brute_force(spark, size):
    rows = odd(random.Random(11), 250) + [(3, [0.3] * 7, 1), (50, [], 2), (100, [0.9] * 70, 0)]
    found = hard_negatives.mine(vectors(spark, rows).repartition(6), F.col("vec_id") % 10 == 0, F.col("label"), size=size)
    want = plain_negatives(rows, lambda k: k % 10 == 0, lambda k, y: y)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want and want


def test_negatives_equal_sql_on_odd_rows(spark, tmp_path):
    df = vectors(spark, odd(random.Random(5)))
    con = connect(tmp_path, embeddings=df)
    assert check.compare(queries.op12_tree_negatives(spark, saved(df, tmp_path)), con, queries.SQL["op12_tree_negatives"]) == []


def test_bounds_leave_scores_out():
    rng = np.random.default_rng(1)
    # anchors close together, rows far from them and of many norms: a few scores are enough
    centre = rng.normal(0, 100, 64)
    anchors = np.floor(centre + rng.normal(0, 1, (40, 64))).astype(np.int64)
    order, parent, edge = hard_negatives.spanning_tree(anchors)
    place = np.argsort(order)
    own = hard_negatives.Anchors(np.arange(40), -1 - np.arange(40), np.zeros(40, np.int64), anchors[order], place[parent[order]], edge[order])
    assert all(p <= i for i, p in enumerate(own.parents)) and (own.parents[1:] < np.arange(1, 40)).all()
    cells = np.floor(rng.normal(0, 100, (2000, 64))).astype(np.int32)
    block = hard_negatives.Block(np.arange(2000), np.zeros(2000, np.int64), cells)
    found = [[hard_negatives.Best(5)] for _ in range(40)]
    wanted = hard_negatives.Wanted(True, [np.array([-np.inf])] * 40, [np.array([np.inf])] * 40, found)
    hard_negatives.walk(block, own, wanted)
    for i in range(40):
        exact = cells.astype(np.int64) @ own.vectors[i]
        first = np.lexsort((np.arange(2000), -exact))[:5]
        assert found[i][0].keys.tolist() == first.tolist() and found[i][0].scores.tolist() == exact[first].tolist()
    again = hard_negatives.walk(block, own, wanted)
    assert again < 0.2 * 40 * 2000  # with full windows few scores are computed besides the root's


def test_negatives_of_nothing(spark):
    empty = hard_negatives.mine(vectors(spark, [(1, [0.1], None)]), F.col("vec_id") % 50 == 0)
    assert empty.count() == 0 and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("name", ["op11_heap_kmeans", "op12_tree_negatives"])
def test_given_tables(spark, name):
    con = check.connect(SF)
    assert check.compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == []
