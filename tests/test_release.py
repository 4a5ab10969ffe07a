"""Whole releases: invariants of a plan, the decisions it embodies, and its physical plan."""

import pytest
from pyspark.sql import functions as F

from veilframe.functions.rng import TaskNoise
from veilframe.operators.utility import NOISY
from veilframe.plans import anonymize as A
from veilframe.session import scratch_dir
from veilframe.sources import tables as S

SF = "/root/testdata/sf0.01"
POLICY = {
    "age": {"method": "bounded_laplace", "epsilon": 0.2, "min": 18, "max": 90},
    "purchase_amount": {"method": "laplace", "epsilon": 0.4, "sensitivity": 1000.0},
    "login_count": {"method": "discrete_laplace", "epsilon": 0.2},
    "is_active": {"method": "randomized_response", "epsilon": 0.5},
    "last_login_days": {"method": "discrete_laplace", "epsilon": 0.3},
}


@pytest.fixture(scope="module")
def customers(spark):
    df = spark.read.parquet(f"{SF}/customer.parquet")
    return df, A.fit(df, ["c_custkey"], secret="s", overrides={"c_custkey": "id"})


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_trace_of_a_small_table(spark, users):
    plan = A.fit(users, ["user_id"], secret="s", policy=POLICY, charge_categorical=False, adjust_small=True)
    assert plan.types() == {
        "user_id": "count", "name": "string", "age": "age", "gender": "string", "location": "string",
        "purchase_amount": "numeric", "login_count": "count", "is_active": "boolean", "last_login_days": "count",
    }
    assert (plan.total_epsilon, plan.preprocessing_epsilon, plan.column_budget) == (4.0, 0.1, 3.9)
    report = plan.budget_report(spark).first()
    assert report["used_epsilon"] == 1.8 and report["skipped"] == 0
    methods = {p.column: p.mechanism.method for p in plan.columns}
    assert methods["gender"] == methods["location"] == "categorical_response" and methods["name"] == "mask"
    purchase = next(p.mechanism for p in plan.columns if p.column == "purchase_amount")
    assert purchase.sensitivity == pytest.approx(759.5) and purchase.lower == 0.0
    age = next(p.mechanism for p in plan.columns if p.column == "age")
    assert (age.lower, age.upper) == (18.0, 90.0)
    out = plan.transform(users)
    assert out.columns == users.columns and out.count() == 50
    checks = out.agg(F.min("age"), F.max("age"), F.count("age"), F.count("last_login_days"), F.min("login_count")).first()
    assert checks[0] >= 18 and checks[1] <= 90 and checks[2] == checks[3] == 50 and checks[4] >= 0
    assert dict(out.dtypes)["is_active"] == "boolean" and dict(out.dtypes)["age"] == "double"


def test_categories_are_charged_by_default(spark, users):
    plan = A.fit(users, ["user_id"], secret="s", policy=POLICY, adjust_small=True)
    assert plan.budget_report(spark).first()["used_epsilon"] == 2.8


def test_sampled_types(users):
    plan = A.fit(users.withColumn("k", F.col("user_id").cast("int")), ["k"], secret="s", sample_rows=10)
    assert plan.types()["gender"] == "string"


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_partitions_do_not_matter(customers, parts):
    df, plan = customers
    assert rows(plan.transform(df.repartition(parts))) == rows(plan.transform(df))


def test_transform_has_no_shuffle_and_no_python(customers):
    df, plan = customers
    text = plan.transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text and "Sort" not in text


def test_pruned_to_the_released_columns(customers):
    df, plan = customers
    text = plan.transform(df).select("c_nationkey")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int>" in text


def test_attack_joins_on_cells(spark):
    from veilframe.operators.kd_tree import root, split
    from veilframe.operators.risk import _beaten

    probes = spark.createDataFrame([(1, 0.0, 0.0, 0.1, 0.4)], "probe int, p0 double, p1 double, own double, radius double")
    points = spark.createDataFrame([(0.0, 0.0, 2)], "x0 double, x1 double, row int")
    level = split(root(points), ["x0", "x1"])
    for levels in ([], [level], [level, level]):
        text = _beaten(probes, points, levels, 2)._jdf.queryExecution().executedPlan().toString()
        keys = next(line for line in text.splitlines() if "Join" in line)
        assert "leaf" in keys and "cell" in keys and "NestedLoop" not in keys and "Cartesian" not in text
        # the one node of the first level is met without a key, by points and by probes
        assert levels or "NestedLoop" not in text


def test_first_rows_are_a_top_k(spark, customers):
    df, plan = customers
    from veilframe.operators.profile import first_rows, infer_types, profile

    pair = first_rows(plan.paired(df), ["c_custkey"], 500)
    derived = pair.withColumn("d", F.col("c_acctbal") - F.col("c_acctbal__noisy")).withColumn("e", F.col("d") * F.col("d"))
    for sample in (
        A.impact_view(df, plan, ["c_custkey"]),
        infer_types(profile(df, key=["c_custkey"], sample_rows=100)),
        plan.paired(first_rows(df, ["c_custkey"], 10)),
        derived,
    ):
        text = sample._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_audit_sees_what_was_released(customers):
    df, plan = customers
    released = plan.transform(df).select("c_acctbal").collect()
    paired = plan.paired(df).select("c_acctbal" + NOISY).collect()
    assert released == paired


def test_other_secret_other_noise(customers):
    df, plan = customers
    from veilframe.functions.rng import KeyedNoise

    other = A.with_noise(plan, KeyedNoise("t", A.KEY))
    assert rows(other.transform(df).select("c_acctbal")) != rows(plan.transform(df).select("c_acctbal"))


def test_task_noise(spark, customers):
    df, _ = customers
    plan = A.fit(df, ["c_custkey"], noise=TaskNoise(3), overrides={"c_custkey": "id"})
    out = plan.paired(df).select(F.abs(F.col("c_acctbal") - F.col("c_acctbal__noisy")).alias("d"))
    assert 0 < out.agg(F.avg("d")).first()[0] < 20


def test_excluded_columns_are_untouched(customers):
    df, _ = customers
    gaps = df.withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")))
    plan = A.fit(gaps, ["c_custkey"], secret="s", exclude=["c_acctbal"], overrides={"c_custkey": "id"})
    assert rows(plan.transform(gaps).select("c_acctbal")) == rows(gaps.select("c_acctbal"))
    assert all(row[3] != "c_acctbal" for row in plan.ledger_rows)


def test_over_budget_columns(spark, customers):
    df, _ = customers
    policy = {"c_acctbal": {"epsilon": 0.8}, "c_nationkey": {"epsilon": 0.5}}
    options = dict(secret="s", policy=policy, overrides={"c_custkey": "id"}, exclude=["c_mktsegment"])
    emptied = A.fit(df, ["c_custkey"], **options)
    assert emptied.transform(df).agg(F.count("c_nationkey"), F.count("c_acctbal")).first()[:] == (1500, 0)
    kept = A.fit(df, ["c_custkey"], on_exhausted="keep", **options)
    assert rows(kept.transform(df).select("c_acctbal")) == rows(df.select("c_acctbal"))
    with pytest.raises(ValueError, match="c_acctbal"):
        A.fit(df, ["c_custkey"], on_exhausted="error", **options)


def test_equal_split_spends_the_whole_budget(spark):
    df = spark.range(1000).select(F.col("id").alias("n"), *[(F.rand(i) * 1000).alias(f"x{i}") for i in range(3)])
    plan = A.fit(df, ["n"], secret="s")
    report = plan.budget_report(spark).first()
    assert report["skipped"] == 0 and report["used_epsilon"] == pytest.approx(0.9, abs=1e-8)


def test_imputation_is_in_the_ledger(spark, customers):
    df, _ = customers
    gaps = df.withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")))
    plan = A.fit(gaps, ["c_custkey"], secret="s", overrides={"c_custkey": "id"})
    stages = {(r["stage"], r["column"], r["operation"]) for r in plan.ledger(spark).collect()}
    assert ("imputation", "c_acctbal", "dp_mean") in stages
    assert plan.transform(gaps).where("c_acctbal is null").count() == 0
    unfilled = A.fit(gaps, ["c_custkey"], secret="s", overrides={"c_custkey": "id"}, impute="none")
    assert unfilled.transform(gaps).where("c_acctbal is null").count() == 500


def test_salted_hash_and_gaussian(spark, customers):
    df, _ = customers
    policy = {"c_acctbal": {"method": "gaussian", "epsilon": 0.5, "sensitivity": 2.0}}
    plan = A.fit(df, ["c_custkey"], secret="s", policy=policy, salt="pepper", overrides={"c_custkey": "id"})
    out = plan.transform(df)
    assert out.select(F.max(F.length("c_custkey"))).first()[0] == 64
    assert next(p for p in plan.columns if p.column == "c_acctbal").mechanism.method == "gaussian"


@pytest.mark.parametrize(
    "options",
    [dict(epsilon=0.0), dict(global_epsilon=-1.0), dict(policy={"c_acctbal": {"epsilon": -1.0}}),
     dict(policy={"c_acctbal": {"method": "exponential"}}), dict(policy={"c_acctbal": {"colour": 1}}),
     dict(overrides={"c_acctbal": "colour"}), dict(exclude=["nothing"]), dict(on_exhausted="raw"),
     dict(policy={"c_acctbal": {"method": "randomized_response"}}), dict(impute="zero")],
)
def test_bad_options_are_refused(customers, options):
    df, _ = customers
    with pytest.raises(ValueError):
        A.fit(df, ["c_custkey"], secret="s", **options)


def test_a_secret_is_needed(customers):
    with pytest.raises(ValueError):
        A.fit(customers[0], ["c_custkey"])


def test_empty_table(spark, customers):
    df = customers[0].where("false")
    plan = A.fit(df, ["c_custkey"], secret="s")
    assert plan.transform(df).count() == 0 and plan.rows == 0


def test_unreadable_booleans(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["yes", "no", "true", "1", "0", "maybe"] * 10)], "k int, flag string")
    plan = A.fit(df, ["k"], secret="s", overrides={"k": "id"})
    assert plan.types()["flag"] == "boolean"
    assert plan.transform(df).where("flag is null").count() == 10
    keeping = A.fit(df, ["k"], secret="s", overrides={"k": "id"}, keep_unreadable=True)
    assert keeping.transform(df).where("flag = 'maybe'").count() == 10


def test_wide_table(spark):
    df = spark.range(200).select("id", *[(F.col("id") * i + 0.5).alias(f"x{i}") for i in range(50)])
    plan = A.fit(df, ["id"], secret="s", overrides={"id": "id"}, distinct="approx")
    assert plan.transform(df).count() == 200
    assert plan.transform(df).agg(F.count("x49")).first()[0] == 200


# --- sources


def test_file_position_is_a_key(spark):
    df = S.with_file_key(S.read_table(spark, f"{SF}/lineitem.parquet"))
    assert df.select("file_key").distinct().count() == df.count() == 60000
    columns = ["l_quantity", "l_tax"]
    plan = A.fit(df, ["file_key"], secret="s", release=columns)
    out = plan.transform(df)
    assert out.columns == columns
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "l_orderkey" not in text


def test_files_without_header_or_rows(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        S.read_delimited(spark, str(tmp_path / "empty.csv"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.read_delimited(spark, str(tmp_path / "none.csv"))
    (tmp_path / "head.csv").write_text("a,b\n")
    assert S.read_delimited(spark, str(tmp_path / "head.csv")).columns == ["a", "b"]


def test_delimiters(spark):
    df = spark.createDataFrame([("a,b", "x"), ("c", "y;z")], "p string, q string")
    for sep in (",", ";", "\t", "|"):
        path = scratch_dir(spark) + "/t"
        S.write_delimited(df, path, sep)
        assert S.detect_delimiter(spark, path) == sep
        assert rows(S.read_delimited(spark, path)) == rows(df)


def test_one_column_is_read_with_a_comma(spark):
    path = scratch_dir(spark) + "/t"
    S.write_delimited(spark.createDataFrame([("a",)], "p string"), path)
    assert S.detect_delimiter(spark, path) == ","


def test_scratch_is_below_the_shared_folder(spark):
    assert scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
