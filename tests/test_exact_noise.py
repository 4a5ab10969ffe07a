"""Noise drawn by whole-number comparisons: its distribution, its grid, and its repetition."""

import math

import pytest
from pyspark.sql import functions as F

from veilframe.functions import exact as E
from veilframe.functions.rng import KeyedNoise
from veilframe.plans.anonymize import fit

N = 40_000


def chi_square(counts, weights):
    """Over cells of at least 20 expected draws; the rest is one cell."""
    total = sum(weights.values())
    cells, rest = [], [0, 0.0]
    for k, w in weights.items():
        want = N * w / total
        if want >= 20:
            cells.append((counts.get(k, 0), want))
        else:
            rest = [rest[0] + counts.get(k, 0), rest[1] + want]
    rest[0] += sum(n for k, n in counts.items() if k not in weights)
    cells += [tuple(rest)] if rest[1] > 1 else []
    return sum((n - w) ** 2 / w for n, w in cells), len(cells) - 1


def counted(spark, units):
    return {r["k"]: r["count"] for r in spark.range(N).select(units.alias("k")).groupBy("k").count().collect()}


@pytest.mark.parametrize("epsilon, units", [(0.5, 1), (1.0, 7), (0.1, 3)])
def test_laplace_units_by_chi_square(spark, epsilon, units):
    counts = counted(spark, E.laplace_units(KeyedNoise("s", "id"), "c", epsilon, units))
    a = epsilon / units
    got, free = chi_square(counts, {k: math.exp(-a * abs(k)) for k in range(-900, 901)})
    assert got < free + 4 * math.sqrt(2 * free)


@pytest.mark.parametrize("sigma", [0.8, 12.5, 47.0])
def test_gaussian_units_by_chi_square(spark, sigma):
    counts = counted(spark, E.gaussian_units(KeyedNoise("s", "id").bits("c", 0)[0], sigma))
    got, free = chi_square(counts, {k: math.exp(-k * k / (2 * sigma * sigma)) for k in range(-600, 601)})
    assert got < free + 4 * math.sqrt(2 * free)


def test_thresholds_are_the_probabilities():
    a = 0.3 / 5
    for j, t in enumerate(E.digit_thresholds(0.3, 5)):
        assert math.isclose(t / 2**60, 1 / (1 + math.exp(a * 2**j)), rel_tol=1e-12, abs_tol=2**-59)
    # no digit that could be 1 is left out
    assert 1 / (1 + math.exp(min(700, a * 2 ** len(E.digit_thresholds(0.3, 5))))) < 2**-59
    table = E.gaussian_thresholds(3.0)
    assert len(table) % 2 == 0 and list(table) == sorted(table) and table[0] >= 0 and table[-1] <= 2**60
    middle = len(table) // 2
    assert abs((table[middle] + table[middle - 1]) - 2**60) <= 2  # as much below as above


def test_all_results_are_on_one_grid(spark):
    noise = KeyedNoise("s", "id")
    value = F.col("id") * 0.1
    step = E.step_of(1.0, 0.3, False)
    rows = spark.range(2000).select(E.laplace(value, noise, "c", 1.0, 0.3).alias("l"), E.gaussian(value, noise, "c", 1.0, 0.3, 1e-5).alias("g")).collect()
    assert all((r["l"] / step).is_integer() for r in rows)
    grid, sigma = E.gaussian_grid(1.0, 0.3, 1e-5, False)
    assert all((r["g"] / grid).is_integer() for r in rows) and 32 <= sigma <= 80
    assert math.log2(step).is_integer() and math.log2(grid).is_integer()
    spread = math.sqrt(sum((r["l"] - 0.1 * i) ** 2 for i, r in enumerate(rows)) / len(rows))
    assert math.isclose(spread, math.sqrt(2) / 0.3, rel_tol=0.1)


def test_draws_repeat_under_any_partitioning(spark):
    units = E.laplace_units(KeyedNoise("s", "id"), "c", 0.5, 3)
    one, many = (sorted(map(tuple, spark.range(500).repartition(n).select("id", units.alias("k")).collect())) for n in (1, 13))
    assert one == many
    other = sorted(map(tuple, spark.range(500).select("id", E.laplace_units(KeyedNoise("t", "id"), "c", 0.5, 3).alias("k")).collect()))
    assert other != one


def test_missing_and_extreme_values(spark):
    df = spark.createDataFrame([(1, None, None), (2, float("nan"), 2**62), (3, 1e300, -(2**62)), (4, 2.5, 3)], "id long, x double, n long")
    noise = KeyedNoise("s", "id")
    rows = df.select(E.laplace(F.col("x"), noise, "x", 1.0, 1.0).alias("x"), E.laplace(F.col("n"), noise, "n", 1.0, 1.0, True).alias("n")).collect()
    assert rows[0]["x"] is None and rows[0]["n"] is None and rows[1]["x"] is None
    assert abs(rows[1]["n"] - 2**62) < 100 and isinstance(rows[3]["n"], int)
    for bad in ((0.0, 1.0), (1.0, 0.0)):
        with pytest.raises(ValueError):
            E.step_of(*bad, False)


def test_a_release_with_exact_noise(spark):
    df = spark.createDataFrame([(i, 100.0 + i / 7, i % 50) for i in range(800)], "id long, price double, visits int")
    policy = {"price": {"method": "exact_laplace", "epsilon": 0.5, "sensitivity": 2.0}, "visits": {"method": "exact_gaussian", "epsilon": 0.5, "sensitivity": 1.0}}
    plan = fit(df, key=["id"], secret="s", epsilon=5.0, policy=policy, overrides={"id": "id", "price": "monetary", "visits": "count"})
    out = plan.transform(df).collect()
    assert {p.column: p.mechanism.method for p in plan.columns if p.column != "id"} == {"price": "exact_laplace", "visits": "exact_gaussian"}
    step = E.step_of(2.0, 0.5, False)
    assert all((r["price"] / step).is_integer() and r["visits"].is_integer() for r in out)
    assert [tuple(r) for r in plan.transform(df.repartition(7)).orderBy("id").collect()] == [tuple(r) for r in plan.transform(df).orderBy("id").collect()]
