"""Statistical properties of the noise and of the draws behind it."""

import math

import pytest
from pyspark.sql import functions as F

from veilframe.functions import discrete as D
from veilframe.functions import noise as N
from veilframe.functions.rng import KeyedNoise, TaskNoise, hashed_row_key, row_key

LINES = "/root/testdata/sf0.01/lineitem.parquet"


@pytest.fixture(scope="module")
def lines(spark):
    df = spark.read.parquet(LINES)
    return df.select("l_quantity", hashed_row_key(df.columns).alias("k")).cache()


@pytest.fixture(params=["md5", "sha256", "task"])
def draws(request):
    return TaskNoise(7) if request.param == "task" else KeyedNoise("secret", "k", request.param)


def test_uniform_is_uniform(lines, draws):
    u = draws.uniform("c")
    row = lines.select(u.alias("u")).agg(
        F.count("u").alias("n"), F.avg("u").alias("m"), F.var_samp("u").alias("v"), F.min("u").alias("lo"),
        F.max("u").alias("hi"),
    ).first()
    assert 0 < row["lo"] and row["hi"] < 1
    assert abs(row["m"] - 0.5) < 4 * math.sqrt(1 / 12 / row["n"])
    assert abs(row["v"] - 1 / 12) < 0.002


def test_streams_and_columns_are_independent(lines):
    draws = KeyedNoise("secret", "k")
    pairs = lines.select(draws.uniform("a", 0).alias("a0"), draws.uniform("a", 1).alias("a1"), draws.uniform("b", 0).alias("b0"))
    row = pairs.agg(F.corr("a0", "a1").alias("x"), F.corr("a0", "b0").alias("y")).first()
    assert abs(row["x"]) < 0.02 and abs(row["y"]) < 0.02


def test_laplace_scale(lines, draws):
    diff = N.laplace(F.col("l_quantity"), draws.uniform("q"), 2.0, 0.5) - F.col("l_quantity")
    row = lines.select(diff.alias("d")).agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.avg(F.abs("d")).alias("a")).first()
    error = 4 * 4.0 * math.sqrt(2 / row["n"])
    assert abs(row["m"]) < error
    assert abs(row["a"] - 4.0) < error


def test_gaussian_deviation(lines, draws):
    noisy = N.gaussian(F.col("l_quantity"), draws.uniform("q", 0), draws.uniform("q", 1), 1.0, 0.5, 1e-5)
    row = lines.select((noisy - F.col("l_quantity")).alias("d")).agg(F.avg("d").alias("m"), F.stddev("d").alias("s"), F.count("d").alias("n")).first()
    sigma = N.gaussian_sigma(1.0, 0.5, 1e-5)
    assert sigma == pytest.approx(math.sqrt(2 * math.log(1.25e5)) / 0.5)
    assert abs(row["m"]) < 4 * sigma / math.sqrt(row["n"])
    assert abs(row["s"] - sigma) < 4 * sigma / math.sqrt(2 * row["n"])


def test_bounds_and_missing(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("v"))
    draws = KeyedNoise("secret", "k")
    out = df.select(
        "v",
        N.bounded_laplace(F.col("v"), draws.uniform("v"), 500.0, 0.5, 100.0, 900.0).alias("b"),
        N.bounded_gaussian(F.col("v"), draws.uniform("v", 0), draws.uniform("v", 1), 9.0, 0.5, 1e-5, 100.0, 900.0).alias("g"),
        N.discrete_laplace(F.col("v"), draws.uniform("v"), 1.0, 0.2).alias("d"),
    )
    row = out.agg(
        F.min("b").alias("lo"), F.max("b").alias("hi"), F.min("g").alias("glo"), F.max("g").alias("ghi"),
        F.count_if(F.col("v").isNull() != F.col("b").isNull()).alias("x"),
        F.count_if(F.col("v").isNull() != F.col("g").isNull()).alias("y"),
        F.count_if(F.col("d") != F.floor("d")).alias("z"),
    ).first()
    assert (row["lo"], row["hi"], row["glo"], row["ghi"]) == (100.0, 900.0, 100.0, 900.0)
    assert (row["x"], row["y"], row["z"]) == (0, 0, 0)


def test_half_is_rounded_to_even(spark):
    zero = F.lit(0.5)  # the median draw is no noise
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (None,)], "v double")
    got = [r[0] for r in df.select(N.discrete_laplace(F.col("v"), zero, 1.0, 1.0)).collect()]
    assert got == [0, 2, 2, 0, None] and all(type(g) is int for g in got[:4])


def test_whole_values_keep_their_digits(spark):
    zero = F.lit(0.5)
    big = 2**53 + 1
    df = spark.createDataFrame([(big,), (2**63 - 1,), (-5,), (None,)], "v bigint")
    got = [r[0] for r in df.select(N.discrete_laplace(F.col("v"), zero, 1.0, 1.0, integral=True, lower=0.5)).collect()]
    assert got == [big, 2**63 - 1, 1, None]
    far = spark.createDataFrame([(2**63 - 1,)], "v bigint").select(
        N.discrete_laplace(F.col("v"), F.lit(0.99), 1.0, 0.1, integral=True)).first()[0]
    assert 2**63 - 2048 <= far <= 2**63 - 1


def test_scaling_applies_to_the_value(spark):
    row = spark.range(1).select(N.scaled_laplace(F.lit(10.0), F.lit(0.5), 1.0, 1.0, 3.0)).first()
    assert row[0] == 30.0


@pytest.mark.parametrize("sensitivity, epsilon", [(1.0, 0.0), (1.0, -1.0), (-1.0, 1.0)])
def test_bad_parameters_are_refused(sensitivity, epsilon):
    with pytest.raises(ValueError):
        N.laplace(F.lit(1.0), F.lit(0.5), sensitivity, epsilon)


@pytest.mark.parametrize("delta", [0.0, 1.0, -0.1])
def test_bad_delta_is_refused(delta):
    with pytest.raises(ValueError):
        N.gaussian_sigma(1.0, 1.0, delta)


def test_boolean_response_keeps_with_its_probability(lines, draws):
    kept = D.boolean_response(F.col("l_quantity") > 25, draws.uniform("f"), 1.0) == (F.col("l_quantity") > 25)
    row = lines.select(kept.alias("kept")).agg(F.count("kept").alias("n"), F.avg(F.col("kept").cast("int")).alias("p")).first()
    p = D.keep_probability(1.0)
    assert p == pytest.approx(math.e / (math.e + 1))
    assert abs(row["p"] - p) < 4 * math.sqrt(p * (1 - p) / row["n"])


def test_categorical_response(lines, draws):
    cats = ["a", "b", "c", "d"]
    value = F.element_at(F.array(*map(F.lit, cats)), (F.col("l_quantity") % 4 + 1).cast("int"))
    out = lines.select(value.alias("v")).select("v", D.categorical_response(F.col("v"), draws.uniform("c", 0), draws.uniform("c", 1), cats, 1.0).alias("r")) \
        if isinstance(draws, TaskNoise) else \
        lines.select("k", value.alias("v")).select("v", D.categorical_response(F.col("v"), draws.uniform("c", 0), draws.uniform("c", 1), cats, 1.0).alias("r"))
    row = out.agg(F.count("v").alias("n"), F.avg((F.col("v") == F.col("r")).cast("int")).alias("p")).first()
    p = D.keep_probability(1.0, 4)
    assert abs(row["p"] - p) < 4 * math.sqrt(p * (1 - p) / row["n"])
    moved = {(r["v"], r["r"]): r["count"] for r in out.where("v <> r").groupBy("v", "r").count().collect()}
    assert len(moved) == 12
    assert min(moved.values()) > 0.8 * max(moved.values())


def test_unknown_category_draws_from_all(spark):
    df = spark.range(3000).select(F.col("id").alias("k"))
    draws = KeyedNoise("secret", "k")
    out = df.select(D.categorical_response(F.lit("new"), draws.uniform("c", 0), draws.uniform("c", 1), ["a", "b"], 0.1).alias("r"))
    assert {r["r"] for r in out.distinct().collect()} == {"a", "b", "new"}


def test_masks(spark):
    df = spark.createDataFrame([("",), ("abcd",), ("abcde",), ("häßlich",), (None,)], "v string")
    rows = df.select(*[D.mask(F.col("v"), kind).alias(kind) for kind in ("partial", "full", "hash")]).collect()
    assert [r["partial"] for r in rows] == ["", "****", "ab*de", "hä***ch", None]
    assert [r["full"] for r in rows] == ["", "********", "********", "********", None]
    assert [r["hash"] for r in rows] == ["", "e2fc714c4727", "ab56b4d92b40", rows[3]["hash"], None]
    assert len(rows[3]["hash"]) == 12
    with pytest.raises(ValueError):
        D.mask(F.col("v"), "rot13")


def test_keys_of_different_rows_differ(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "a"), ("a", None), ("-", "a"), ("1:a", "a"), ("", ""), ("", None)]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(row_key(["x", "y"])).distinct().count() == len(rows)
