"""The partition tree and the linkage attack over it, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.operators import kd_tree
from veilframe.operators import risk as K


def skewed(n, seed):
    """A third of all values equal, a heavy tail, and a column of three values."""
    rng = np.random.default_rng(seed)
    x = np.exp(rng.normal(0, 3, n))
    x[::3] = 1.0
    return np.stack([x / x.max(), rng.normal(0, 0.2, n), rng.integers(0, 3, n) / 2.0], axis=1)


def frame(spark, values, names):
    rows = [(i, *map(float, v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in names)).repartition(5)


def grown(rows, names, depth):
    levels = []
    for _ in range(depth):
        levels.append(kd_tree.split(kd_tree.deal(rows, levels, names), names))
    return levels


def test_every_row_has_one_leaf_and_leaves_are_even(spark):
    xs = ["a", "b", "c"]
    rows = frame(spark, skewed(6000, 1), xs)
    dealt = kd_tree.deal(rows, grown(rows, xs, 2), xs)
    assert dealt.count() == dealt.select("id").distinct().count() == 6000
    sizes = [r["count"] for r in dealt.groupBy("leaf").count().collect()]
    assert len(sizes) > 150 and max(sizes) < 100  # one level has but three values to part
    assert kd_tree.leaves(kd_tree.split(kd_tree.root(rows), xs)) == 64


def test_no_neighbour_is_lost(spark):
    xs, ps = ["a", "b", "c"], ["p", "q", "r"]
    values = skewed(3000, 2)
    rng = np.random.default_rng(3)
    centres = values[:200] + rng.normal(0, 0.05, (200, 3))
    centres[:5] *= 1000  # far outside
    radii = np.abs(rng.normal(0, 0.1, 200))
    radii[5:10] = 1e150
    rows = frame(spark, values, xs)
    balls = frame(spark, np.column_stack([centres, radii]), [*ps, "radius"]).withColumnRenamed("id", "ball")
    levels = grown(rows, xs, 2)
    reached = kd_tree.reach(balls, levels, ps, "radius")
    met = reached.join(kd_tree.deal(rows, levels, xs), "leaf").select("ball", "id").collect()
    found = {(r["ball"], r["id"]) for r in met}
    assert len(found) == len(met)  # a ball meets a row once
    near = np.argwhere(((centres[:, None] - values[None]) ** 2).sum(-1) <= (radii ** 2)[:, None])
    assert len(near) > 15000
    assert {(int(b), int(i)) for b, i in near} <= found
    bounded = sum(1 for b, _ in found if not 5 <= b < 10)
    assert bounded < 0.2 * 195 * 3000  # and most leaves are left out


def test_nodes_without_rows_and_odd_values(spark):
    seen = frame(spark, [(0.0,), (1.0,), (2.0,)], ["a"])
    levels = grown(seen, ["a"], 2)
    odd = spark.createDataFrame([(0, float("nan")), (1, 1e300), (2, None), (3, -5.0)], "id int, a double")
    assert kd_tree.deal(odd, levels, ["a"]).count() == 4
    balls = odd.select("id", "a", F.lit(float("nan")).alias("radius"))
    assert {r["id"] for r in kd_tree.reach(balls, levels, ["a"], "radius").select("id").collect()} == {0, 1, 2, 3}
    empty = kd_tree.split(kd_tree.root(seen.where("id < 0")), ["a"])
    assert empty.count() == 0
    assert [r["leaf"] for r in kd_tree.deal(seen, [empty], ["a"]).collect()] == [0, 0, 0]


@pytest.mark.parametrize("noise", [0.001, 0.3])
def test_linkage_of_skewed_columns(spark, noise):
    """Enough rows for three rounds; a third of one column is one value, the rest has a heavy tail."""
    n = 9000
    values = skewed(n, 4)
    values[1::50] = values[0]  # equal originals
    released = values + np.random.default_rng(5).laplace(0, noise, values.shape) * [0.1, 1, 1]
    released[::7, 1] = 0.0  # many probes at one place of an axis
    names = ["a", "b", "c"]
    df = frame(spark, np.column_stack([values, released]), names + [c + "__noisy" for c in names])
    scale = np.abs(values).max(axis=0)
    original, noisy = values / scale, released / scale
    linked = 0
    for i, p in enumerate(noisy):
        d = original[:, 0] - p[0]
        total = d * d
        for j in (1, 2):
            d = original[:, j] - p[j]
            total = total + d * d
        linked += int(np.argmin(total)) == i
    row = K.linkage_attack(df, names, ["id"]).first()
    assert (row["probes"], row["linked"]) == (n, linked)
    assert 0 < linked < n


def test_a_round_holds_every_point_once(spark):
    """The side of the points has no generator, whatever the number of levels."""
    xs = ["x0", "x1"]
    rows = frame(spark, skewed(500, 6)[:, :2], xs)
    dealt = kd_tree.deal(rows, grown(rows, xs, 2), xs)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan


def counted_reach(monkeypatch):
    """A list that gets the number of pairs of ball and leaf of each round of an attack."""
    made, real = [], kd_tree.reach

    def reach(*args):
        out = real(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(kd_tree, "reach", reach)
    return made


def linked_by_brute_force(values, released):
    """Ids are positions; an equal distance goes to the smaller one."""
    scale = np.abs(values).max(axis=0)
    original, noisy = values / scale, released / scale
    return sum(int(np.argmin(((original - p) ** 2).sum(axis=1))) == i for i, p in enumerate(noisy))


def test_balls_between_lines_of_points_reach_few_leaves(spark, monkeypatch):
    """A column of five values with noise far wider than that of the other, of which a third is one value; a small tree has many rounds."""
    monkeypatch.setattr(kd_tree, "FANOUT", 8)
    for name, value in {"LEAF_POINTS": 8, "POINTS_PER_CUT": 2, "FEW_LEAVES": 1}.items():
        monkeypatch.setattr(K, name, value)
    rng = np.random.default_rng(8)
    n = 12000
    values = np.stack([rng.uniform(1000, 500000, n).round(2), rng.integers(1, 6, n)], axis=1)
    values[::3, 0] = 0.0
    released = values + rng.laplace(0, 1, (n, 2)) * [2000, 0.2]
    made = counted_reach(monkeypatch)
    df = frame(spark, np.column_stack([values, released]), ["a", "b", "a__noisy", "b__noisy"])
    row = K.linkage_attack(df, ["a", "b"], ["id"]).first()
    assert (row["probes"], row["linked"]) == (n, linked_by_brute_force(values, released))
    assert len(made) > 1 and max(made) < 2 * n


def test_boxes_lose_no_neighbour(spark):
    xs, ps = ["a", "b", "c"], ["p", "q", "r"]
    values = skewed(3000, 10)
    rng = np.random.default_rng(11)
    centres, radii = values[:150] + rng.normal(0, 0.05, (150, 3)), np.abs(rng.normal(0, 0.1, 150))
    rows = frame(spark, values, xs)
    balls = frame(spark, np.column_stack([centres, radii]), [*ps, "radius"]).withColumnRenamed("id", "ball")
    levels = grown(rows, xs, 3)
    dealt = kd_tree.deal(rows, levels, xs)
    low = kd_tree.boxes(dealt, xs)
    within = [kd_tree.outer(low, 3), low]
    reached = kd_tree.reach(balls, levels, ps, "radius", within).select("ball", "leaf")
    met = reached.join(dealt, "leaf").select("ball", "id").collect()
    found = {(r["ball"], r["id"]) for r in met}
    assert len(found) == len(met)
    near = np.argwhere(((centres[:, None] - values[None]) ** 2).sum(-1) <= (radii ** 2)[:, None])
    assert {(int(b), int(i)) for b, i in near} <= found
    assert reached.count() <= kd_tree.reach(balls, levels, ps, "radius").count()


def test_rows_without_a_key_are_never_beaten(spark):
    df = spark.sql("select if(id % 4 = 0, null, id) as k, cast(id % 10 as double) as x, cast(id % 10 as double) as x__noisy from range(400)")
    # of the ten values, the even ones have rows without a key; one keyed row of each value is first
    assert K.linkage_attack(df, ["x"], ["k"]).first()[:2] == (400, 110)
