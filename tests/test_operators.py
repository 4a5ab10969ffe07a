"""Operators against plain Python on small inputs, and the paths that only large inputs take."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from veilframe.functions import values as V
from veilframe.functions.rng import KeyedNoise
from veilframe.operators import budget as B
from veilframe.operators import impute as I
from veilframe.operators import order_stats as S
from veilframe.operators import outliers as O
from veilframe.operators import policy as P
from veilframe.operators import profile as R
from veilframe.operators import quality as Q
from veilframe.operators import risk as K
from veilframe.operators import utility as U
from veilframe.plans.anonymize import preprocess_summary


def table(spark, values, name="v", kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"k int, {name} {kind}")


# --- reading cells


@pytest.mark.parametrize(
    "text, number",
    [("12", 12.0), (" -3.5 ", -3.5), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("1_000", 1000.0), ("12d", None),
     ("inf", None), ("nan", None), ("", None), ("1__0", None), ("0x10", None), (None, None), ("+7", 7.0)],
)
def test_numbers_in_text(spark, text, number):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(V.to_number(F.col("c"), df.schema["c"].dataType)).first()[0] == number


@pytest.mark.parametrize("text, missing", [(t, True) for t in ("", " ", "None", "NULL", "n/a", " NA ", "nan")] + [("0", False), ("no", False)])
def test_missing_tokens(spark, text, missing):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(V.is_missing(F.col("c"), df.schema["c"].dataType)).first()[0] is missing


def test_na_is_a_string_for_inference(spark):
    df = spark.createDataFrame([("na",), ("n/a",), ("Y",), ("1.5",)], "c string")
    got = [r[0] for r in df.select(V.value_class(F.col("c"), df.schema["c"].dataType)).collect()]
    assert got == ["string", "null", "boolean", "numeric"]


# --- profile


def test_estimates_agree_with_exact_profile(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    exact = {r["column"]: r for r in R.profile(df).collect()}
    rough = {r["column"]: r for r in R.profile(df, distinct="approx").collect()}
    for c in df.columns:
        for f in ("ord", "total_count", "numeric_ratio", "string_ratio", "num_min", "num_max", "is_integer"):
            assert exact[c][f] == rough[c][f], (c, f)
        assert rough[c]["unique_count"] == pytest.approx(exact[c]["unique_count"], rel=0.2)


def test_numbers_written_differently_count_once(spark):
    df = table(spark, ["2.0", "2.00", " 2.0", "3"], kind="string")
    r = R.profile(df, ["v"]).first()
    assert (r["unique_count"], r["num_unique_ratio"]) == (3, 0.5)


def test_empty_column_is_string(spark):
    df = table(spark, [None, " ", ""], kind="string")
    r = R.infer_types(R.profile(df, ["v"])).first()
    assert (r["total_count"], r["semantic_type"]) == (0, "string")


def test_override_must_be_a_known_type(spark):
    df = table(spark, [1.0])
    with pytest.raises(ValueError):
        R.collect_profiles(df, R.infer_types(R.profile(df)), {"v": "colour"})


# --- order statistics


@pytest.mark.parametrize("seed", range(3))
def test_histogram_search_finds_exact_elements(spark, seed):
    rng = random.Random(seed)
    hot = [7.25] * 700  # a third of the rows share one value
    values = hot + [float(rng.choice([rng.gauss(0, 1), rng.uniform(-1e9, 1e9), rng.randint(0, 5), 1e300])) for _ in range(1400)]
    df = table(spark, values + [None, float("nan")])
    n = len(values)
    ranks = [0, n // 4, n // 2, 3 * n // 4, n - 1]
    bounds = {"v": (n, min(values), max(values))}
    ordered = sorted(values)
    assert S.order_statistics(df, {"v": ranks}, bounds)["v"] == [ordered[k] for k in ranks]


def test_order_of_the_smallest_numbers(spark):
    values = [5e-324, 1e-323, 1e-323, 1.5e-323, 1e300, -5e-324]
    found = S.order_statistics(table(spark, values), {"v": list(range(6))}, {"v": (6, min(values), max(values))})
    assert found["v"] == sorted(values)


def test_rank_outside_the_column_is_refused(spark):
    with pytest.raises(ValueError):
        S.order_statistics(table(spark, [1.0]), {"v": [1]}, {"v": (1, 1.0, 1.0)})


# --- outliers


@pytest.mark.parametrize("n", [2, 3, 4, 5, 50])
def test_outliers_against_python(spark, n):
    rng = random.Random(n)
    values = [rng.gauss(10, 2) for _ in range(n - 1)] + [90.0]
    df = table(spark, values)
    limits = O.fit_limits(df, ["v"])
    row = O.outlier_summary(df, limits).first()
    assert row["analysis_performed"] == (n >= 3)
    if n < 3:
        assert row["reason"] == "insufficient_data" and row["total_outliers"] == 0
        return
    mean, std = statistics.mean(values), statistics.stdev(values)
    z = {i for i, v in enumerate(values) if abs(v - mean) / std > 3}
    s = sorted(values)
    q1, q3 = s[n // 4], s[3 * n // 4]
    iqr = {i for i, v in enumerate(values) if n >= 4 and not q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)}
    assert (row["zscore_outliers"], row["iqr_outliers"], row["total_outliers"]) == (len(z), len(iqr), len(z | iqr))
    assert row["median"] == pytest.approx(statistics.median(values))


def test_constant_column_has_no_outliers(spark):
    df = table(spark, [5.0] * 20)
    row = O.outlier_summary(df, O.fit_limits(df, ["v"])).first()
    assert row["total_outliers"] == 0 and row["std"] == 0


# --- imputation


def test_mode_ties_go_to_the_first_seen(spark):
    df = table(spark, ["b", "a", None, "a", "b", "N/A"], kind="string")
    for key in (["k"], ["v", "k"], ["k", "v"]):
        row = I.mode_imputation(df, ["v"], key).first()
        first = "a" if key[0] == "v" else "b"
        assert (row["method"], row["missing_count"], row["text"], row["mode_frequency"]) == ("mode", 2, first, 2)


def test_mode_without_ties_needs_no_order(spark):
    df = table(spark, ["b", "a", None, "a"], kind="string").withColumn("k", F.col("k").cast("string"))
    assert I.mode_imputation(df, ["v"], ["k"]).first()["text"] == "a"


def test_mode_of_nothing_is_unknown(spark):
    row = I.mode_imputation(table(spark, [None, ""], kind="string"), ["v"], ["k"]).first()
    assert (row["method"], row["text"]) == ("unknown_fallback", "unknown")


@pytest.mark.parametrize("values, method", [([1.0, 2.0], "none"), ([None, None], "zero_fallback"),
                                            ([None] + [1.0, 5.0, 2.0], "dp_median"), ([None] + [float(i) for i in range(10)], "dp_mean")])
def test_numeric_methods(spark, values, method):
    row = I.numeric_imputation(table(spark, values), ["v"], 0.1, KeyedNoise("s", "k")).first()
    assert row["method"] == method
    assert row["epsilon_used"] == (0.1 if method in ("dp_mean", "dp_median") else 0.0)
    if method == "dp_median":
        assert row["number"] is not None and row["number"] != 2.0
        exact = I.numeric_imputation(table(spark, values), ["v"], 0.1, KeyedNoise("s", "k"), exact_median=True).first()
        assert (exact["method"], exact["number"], exact["epsilon_used"]) == ("median", 2.0, 0.0)
    if method == "dp_mean":  # the published value is noisy
        assert row["number"] is not None and row["number"] != 4.5


def test_strategies(spark, users):
    types = dict.fromkeys(users.columns, "string") | {"age": "age", "last_login_days": "count"}
    typed = I.fit_imputation(users, types, ["user_id"], 0.1, KeyedNoise("s", "user_id"))
    assert typed["age"].method == "dp_mean" and typed["age"].missing_count == 1
    assert typed["last_login_days"].missing_count == 2
    modes = I.fit_imputation(users.withColumn("k", F.col("user_id").cast("int")), types, ["k"], 0.1, KeyedNoise("s", "k"), users.columns, "mode")
    assert modes["last_login_days"].method == "mode" and modes["last_login_days"].text == "2"
    assert modes["gender"].method == "none"


# --- quality


def test_empty_table_is_critical(spark):
    row = Q.quality_report(table(spark, []), ["k"]).first()
    assert (row["critical"], row["quality_score"], row["quality_assessment"]) == (1, 50, "critical")


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    for digest in (False, True):
        row = Q.duplicate_report(df, digest=digest).first()
        assert (row["rows"], row["unique_rows"], row["duplicate_rows"]) == (3, 2, 1)


def test_type_mix_of_the_first_rows(spark):
    df = table(spark, ["1", "2", "x", "yes", "0", None, ""], kind="string")
    row = Q.type_mix(df, ["k"]).first()
    assert (row["column"], row["expected_class"], row["differing"]) == ("v", "numeric", 2)


# --- policy and budget


def test_explicit_epsilon_wins(spark):
    schema = "dataset string, purpose string, explicit_epsilon double, global_epsilon double"
    rows = [("d", "analytics", 2.0, 1.0), ("d", "analytics", None, 1.0), ("d", "general", None, 3.0), ("d", "other", None, None)]
    got = [(r["epsilon"], r["epsilon_source"]) for r in P.resolve_epsilon(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got) == sorted([(2.0, "explicit"), (0.8, "standard"), (3.0, "global"), (1.0, "global")])


def test_full_mask_is_valid(spark):
    schema = "dataset string, column string, method string, epsilon double, min double, max double, sensitivity double, mask_type string"
    rows = [("d", "a", None, None, None, None, None, "full"), ("d", "b", "bounded_laplace", 1.0, 5.0, 5.0, 0.0, None)]
    got = {(r["column"], r["violation"]) for r in P.policy_violations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("b", "max_not_above_min"), ("b", "sensitivity_not_positive")}


@pytest.mark.parametrize("seed", range(3))
def test_ledger_is_greedy(spark, seed):
    rng = random.Random(seed)
    entries, totals, expected = [], [], {}
    for d in range(40):
        total = rng.randint(1, 30)
        totals.append((f"d{d}", total / 10))
        used = 0
        for o in range(rng.randint(1, 12)):
            e = rng.randint(1, 12)
            admitted = used + e <= total
            used += e if admitted else 0
            entries.append((f"d{d}", o, f"c{o}", "laplace", e / 10))
            expected[f"d{d}", o] = (admitted, used / 10)
    rng.shuffle(entries)
    charged = B.folded_ledger(
        spark.createDataFrame(entries, "dataset string, ord int, column string, operation string, epsilon double"),
        spark.createDataFrame(totals, "dataset string, total_epsilon double"),
    )
    assert {(r["dataset"], r["ord"]): (r["admitted"], r["used_after"]) for r in charged.collect()} == expected
    report = B.budget_report(charged).collect()
    assert all(r["used_epsilon"] <= r["total_epsilon"] for r in report)


@pytest.mark.parametrize("seed", range(2))
def test_long_ledger_is_greedy(spark, seed):
    rng = random.Random(seed)
    entries, totals, expected = [], [], {}
    shapes = {
        "even": lambda i: rng.randint(1, 1000), "small": lambda i: 1, "large": lambda i: rng.randint(10**6, 10**7),
        "falling": lambda i: 400 - i, "heavy": lambda i: int(rng.paretovariate(0.7)), "short": lambda i: 5,
    }
    for name, shape in shapes.items():
        n = 3 if name == "short" else 300
        total = rng.choice([7, 4096, 50_000, 10**6])
        totals.append((name, total / 1e9))
        used = 0
        for o in range(n):
            e = shape(o)
            admitted = used + e <= total
            used += e if admitted else 0
            entries.append((name, o, f"c{o}", "laplace", e / 1e9))
            expected[name, o] = (admitted, used)
    for name, n in (("few", 3), ("many", 30)):  # datasets without a total
        for o in range(n):
            entries.append((name, o, f"c{o}", "laplace", 1e-9))
            expected[name, o] = (False, 0)
    rng.shuffle(entries)
    charged = B.ledger(
        spark.createDataFrame(entries, "dataset string, ord int, column string, operation string, epsilon double"),
        spark.createDataFrame(totals, "dataset string, total_epsilon double"),
    ).collect()
    assert len(charged) == len(expected)
    assert {(r["dataset"], r["ord"]): (r["admitted"], round(r["used_after"] * 1e9)) for r in charged} == expected


@pytest.mark.parametrize("way", [B.ledger, B.folded_ledger])
def test_tenths_add_up(spark, way):
    schema = "dataset string, ord int, column string, operation string, epsilon double"

    def charge(epsilons, total):
        entries = [("d", i, f"c{i}", "laplace", e) for i, e in enumerate(epsilons)]
        totals = spark.createDataFrame([("d", total)], "dataset string, total_epsilon double")
        return sorted(way(spark.createDataFrame(entries, schema), totals).collect(), key=lambda r: r["ord"])

    assert [r["admitted"] for r in charge([0.1, 0.2], 0.3)] == [True, True]
    # what rounds to nothing costs 1e-9
    assert [r["admitted"] for r in charge([1e-12, 1e-12], 1e-9)] == [True, False]
    for bad in (0.0, -0.5, None, float("nan")):
        with pytest.raises(Exception, match="epsilon must be above zero"):
            charge([0.1, bad], 1.0)


# --- utility and risk


def pairs(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, v double, v__noisy double")


def test_utility_edge_cases(spark):
    constant = U.utility_metrics(pairs(spark, [(0.0, 0.5), (0.0, -0.5), (None, 1.0)]), ["v"]).first()
    assert (constant["sample_size"], constant["relative_error"], constant["std_change_pct"]) == (2, 0.0, 0.0)
    assert constant["utility_score"] == pytest.approx(50 + 30 + 20 * 0.5)
    assert U.utility_metrics(pairs(spark, [(1.0, 1.0), (None, 2.0)]), ["v"]).count() == 0
    assert U.utility_summary(U.utility_metrics(pairs(spark, [(1.0, 1.0)]), ["v"])).first()["grade"] is None


def test_too_few_rows_have_unknown_outlier_risk(spark):
    assert K.outlier_preservation(pairs(spark, [(1.0, 1.0), (2.0, 2.0)]), "v").first()["outlier_risk"] == "UNKNOWN"


def test_k_anonymity_levels(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3, "q string")
    row = K.k_anonymity(df, ["q"]).first()
    assert (row["k_estimate"], row["anonymity_level"], row["max_frequency"]) == (3, "WEAKLY_ANONYMOUS", 5)
    assert K.k_anonymity(df.where("false"), ["q"]).first()["k_risk"] == "UNKNOWN"


@pytest.mark.parametrize("seed, scale", [(0, 0.001), (1, 0.05), (2, 5.0)])
def test_linkage_against_brute_force(spark, seed, scale):
    rng = random.Random(seed)
    rows = []
    for i in range(700):
        x = 3.0 if i % 3 == 0 else rng.uniform(-50, 50)  # a third of the rows are copies
        y = None if i % 10 == 9 else float(rng.randint(0, 4))
        rows.append((i, x, y, x + rng.gauss(0, scale), None if y is None else y + rng.gauss(0, scale)))
    df = spark.createDataFrame(rows, "k int, x double, y double, x__noisy double, y__noisy double").repartition(5)
    mx = max(abs(r[1]) for r in rows)
    my = max(abs(r[2] or 0) for r in rows)
    original = [(r[1] / mx, (r[2] or 0.0) / my) for r in rows]
    linked, first = 0, 0
    for r in rows:
        p = (r[3] / mx, (r[4] or 0.0) / my)
        nearest = min(range(700), key=lambda j: ((original[j][0] - p[0]) ** 2 + (original[j][1] - p[1]) ** 2, j))
        linked += nearest == r[0]
        first += nearest == r[0] and r[0] < 500
    row = K.linkage_attack(df, ["x", "y"], ["k"]).first()
    assert (row["probes"], row["linked"]) == (700, linked)
    row = K.linkage_attack(df, ["x", "y"], ["k"], probes=500).first()
    assert (row["probes"], row["linked"]) == (500, first)


def test_linkage_of_odd_tables(spark):
    schema = "k int, x double, x__noisy double"
    # all rows alike: only the earliest key is found; far noise stays outside the grid of the originals
    alike = spark.createDataFrame([(i, 1.0, 1.0) for i in range(300)], schema)
    assert K.linkage_attack(alike, ["x"], ["k"]).first()[:2] == (300, 1)
    far = spark.createDataFrame([(i, float(i), 1e9) for i in range(300)] + [(300, 0.0, -1e12)], schema)
    assert K.linkage_attack(far, ["x"], ["k"]).first()[:2] == (301, 1)
    # equal keys with other values are different rows
    twice = spark.createDataFrame([(1, 1.0, 1.0), (1, 5.0, 5.0), (1, 9.0, 5.1)], schema)
    assert K.linkage_attack(twice, ["x"], ["k"]).first()[:2] == (3, 2)
    empty = spark.createDataFrame([], schema)
    assert K.linkage_attack(empty, ["x"], ["k"]).first()[:3] == (0, 0, 0.0)


def test_uniqueness_estimate(spark):
    df = spark.range(5000).select((F.col("id") % 100).alias("v"))
    exact = K.uniqueness(df, ["v"]).first()["uniqueness"]
    assert exact == 0.02
    assert K.uniqueness(df, ["v"], "approx").first()["uniqueness"] == pytest.approx(exact, rel=0.2)


def test_quality_report_reads_a_table_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, "x" if i else "12", 1e11 if i == 3 else 1.0) for i in range(9)], "k int, t string, v double").write.parquet(path)
    df = spark.read.parquet(path)
    report = Q.quality_report(df, ["k"])
    assert report._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 2
    assert (report.first()["warnings"], report.first()["errors"]) == (9, 0)  # eight mixed cells and an extreme one
    structure = spark.createDataFrame([("error", "column_count", "r", 1)], "severity string, check string, row_key string, found int")
    fills = {c: I.Imputation(c, "none", 0) for c in df.columns}
    types = {"k": "count", "t": "string", "v": "numeric"}
    scores = [preprocess_summary(df, ["k"], types, fills, s).first()["quality_score"] for s in (None, structure)]
    assert scores == [55, 35]
