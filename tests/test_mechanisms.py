"""Which mechanism a column gets, and with which parameters."""

import pytest
from pyspark.sql import functions as F

from veilframe.functions import mechanisms as M
from veilframe.plans import anonymize as A
from veilframe.plans.ml_compare import compare_models

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "semantic_type, settings, expected",
    [
        ("age", {}, dict(method="bounded_laplace", epsilon=0.2, sensitivity=1.0, lower=0.0, upper=120.0)),
        ("age", dict(minimum=18, maximum=90), dict(lower=18, upper=90)),
        ("year", {}, dict(method="bounded_laplace", epsilon=0.2, lower=1900.0, upper=2050.0)),
        ("numeric", {}, dict(method="laplace", epsilon=0.3, sensitivity=1.0, lower=None, upper=None)),
        ("numeric", dict(num_range=0.5), dict(sensitivity=0.5)),
        ("numeric", dict(num_range=0.0), dict(sensitivity=1.0)),
        ("numeric", dict(sensitivity=9.0, num_range=5.0), dict(sensitivity=5.0)),
        ("numeric", dict(non_negative=True), dict(lower=0.0)),
        ("monetary", {}, dict(method="scaled_laplace", epsilon=0.3, sensitivity=1000.0)),
        ("monetary", dict(num_range=80.0, non_negative=True), dict(sensitivity=80.0, lower=0.0)),
        ("count", {}, dict(method="discrete_laplace", epsilon=1.0, sensitivity=1.0, lower=0.0)),
        ("count", dict(non_negative=False), dict(lower=None)),
        ("count", dict(method="laplace"), dict(method="laplace")),
        ("boolean", {}, dict(method="randomized_response", epsilon=0.5, formal=True)),
        ("id", dict(mask_type="partial"), dict(method="mask", mask_type="hash", epsilon=None)),
        ("string", {}, dict(method="mask", mask_type="partial")),
        ("string", dict(mask_type="full"), dict(method="mask", mask_type="full")),
        ("string", dict(categories=("a", "b")), dict(method="categorical_response", epsilon=0.5)),
        ("string", dict(categories=("a",)), dict(method="mask")),
        ("string", dict(categories=tuple("abcdefghijklmnop")), dict(method="mask")),
        ("numeric", dict(sensitivity=1.0, minimum=0.0, maximum=1.0), dict(formal=True)),
        ("numeric", dict(sensitivity=1.0), dict(formal=False)),
    ],
)
def test_choice(semantic_type, settings, expected):
    m = M.choose("c", semantic_type, **settings)
    assert {f: getattr(m, f) for f in expected} == expected


@pytest.mark.parametrize(
    "semantic_type, settings",
    [("colour", {}), ("boolean", dict(method="laplace")), ("numeric", dict(method="randomized_response")),
     ("numeric", dict(method="bounded_laplace")), ("age", dict(minimum=10, maximum=10))],
)
def test_impossible_choices_are_refused(semantic_type, settings):
    with pytest.raises(ValueError):
        M.choose("c", semantic_type, **settings)


def test_description_of_a_plan(spark):
    df = spark.read.parquet(f"{SF}/customer.parquet")
    plan = A.fit(df, ["c_custkey"], secret="s", overrides={"c_custkey": "id"})
    rows = {r["column"]: r for r in plan.describe(spark).collect()}
    assert list(rows) == df.columns
    assert rows["c_mktsegment"]["categories"] == ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    assert rows["c_acctbal"]["min"] is None and rows["c_nationkey"]["min"] == 0.0


def test_models_lose_nothing_without_noise(spark):
    """With a huge epsilon both sides train on the same rows and find the same model."""
    df = spark.range(600).select(
        F.col("id").alias("k"), (F.col("id") * 7 % 100 + 0.5).alias("x"),
        F.when(F.col("id") * 7 % 100 > 50, "high").otherwise("low").alias("label"),
    )
    plan = A.fit(df, ["k"], secret="s", epsilon=1e9, overrides={"k": "id"}, exclude=["label"])
    rows = compare_models(df, plan, "label", skip=["k"], trees=5, iterations=20).collect()
    for r in rows:
        assert r["original_accuracy"] == r["anonymised_accuracy"] > 0.9 and r["grade"] == "Excellent"
