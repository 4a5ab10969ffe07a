"""Fit a release plan on a table, then apply it as one shuffle-free projection.

`fit` reads the table: profile, imputation values, policy, budget. What it learns is as
wide as the schema and lives on the driver. `AnonymizationPlan.transform` is a projection
without a shuffle, an action or a Python function, so it serves batches and streams alike.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import mechanisms as M
from veilframe.functions import values as V
from veilframe.functions.rng import KeyedNoise, TaskNoise, hashed_row_key, row_key
from veilframe.operators import budget as B
from veilframe.operators import policy as P
from veilframe.operators import quality as Q
from veilframe.operators.cells import one_row
from veilframe.operators.impute import Imputation, count_gaps, fit_imputation, imputed
from veilframe.operators.outliers import fit_limits, outlier_summary, outlier_totals
from veilframe.operators.profile import (
    MAX_CATEGORIES,
    NUMERIC_TYPES,
    collect_profiles,
    first_rows,
    infer_types,
    profile,
)
from veilframe.operators.profile_state import merged_profile
from veilframe.operators.risk import risk_report
from veilframe.operators.utility import NOISY, utility_metrics, utility_summary

DATASET = "dataset"
KEY = "__key"
LEDGER_SCHEMA = (
    "dataset string, stage string, ord int, column string, operation string, epsilon double, "
    "admitted boolean, used_after double, total_epsilon double, formal boolean"
)


@dataclass(frozen=True)
class ColumnPlan:
    """One column of a plan. `released` is `noisy`, `raw` (excluded), `kept` or `null` (over budget)."""

    column: str
    ord: int
    mechanism: M.Mechanism
    imputation: Imputation
    released: str

    @property
    def semantic_type(self) -> str:
        return self.mechanism.semantic_type

    @property
    def streams(self) -> int:
        return self.mechanism.streams if self.released == "noisy" else 0


@dataclass(frozen=True)
class AnonymizationPlan:
    """Everything a release needs; carries no data beyond statistics of the columns."""

    columns: tuple[ColumnPlan, ...]
    key: tuple[str, ...]
    noise: KeyedNoise | TaskNoise
    rows: int
    total_epsilon: float
    preprocessing_epsilon: float
    column_budget: float
    ledger_rows: tuple[tuple, ...]
    keep_unreadable: bool = False
    overridden: bool = False
    release_id: str = ""

    @property
    def numeric_columns(self) -> list[str]:
        """Released numeric columns, for the audit."""
        return [p.column for p in self.columns if p.semantic_type in NUMERIC_TYPES and p.released != "null"]

    def types(self) -> dict[str, str]:
        return {p.column: p.semantic_type for p in self.columns}

    def transform(self, df: DataFrame) -> DataFrame:
        """The released table, with the columns in their order."""
        ready = self._with_draws(df)
        return ready.select(*[self._released(df, p).alias(p.column) for p in self.columns])

    def paired(self, df: DataFrame) -> DataFrame:
        """Original (imputed) and released values side by side, plus the row key."""
        ready = self._with_draws(df)
        original = [imputed(df, p.column, p.imputation).alias(p.column) for p in self.columns]
        noisy = [self._released(df, p).alias(p.column + NOISY) for p in self.columns]
        return ready.select(F.col(KEY), *original, *noisy)

    def preprocessed(self, df: DataFrame) -> DataFrame:
        """The table with missing cells filled and nothing else changed."""
        return df.select(*[imputed(df, p.column, p.imputation).alias(p.column) for p in self.columns])

    def _with_draws(self, df: DataFrame) -> DataFrame:
        """Add the key and every uniform as columns, so that each is computed once per row."""
        key = row_key(self.key) if len(self.key) == 1 else hashed_row_key(self.key)
        noise = self.noise
        if isinstance(noise, KeyedNoise):
            noise = KeyedNoise(noise.secret, KEY, noise.digest)
        draws = [
            M.draw(p.mechanism, noise, f"{self.release_id}/{p.column}", s, _filled_type(df, p)).alias(_draw(p.ord, s))
            for p in self.columns for s in range(p.streams)
        ]
        return df.select("*", key.alias(KEY)).select("*", *draws)

    def _released(self, df: DataFrame, p: ColumnPlan) -> Column:
        dtype = df.schema[p.column].dataType
        if p.released == "raw":
            return F.col(p.column)
        value, filled = imputed(df, p.column, p.imputation), _filled_type(df, p)
        if p.released == "kept":
            return value
        if p.released == "null":
            return F.lit(None).cast(out_type(p, dtype))
        draws = [F.col(_draw(p.ord, s)) for s in range(p.streams)]
        out = M.apply(p.mechanism, value, filled, draws)
        if self.keep_unreadable and p.semantic_type == "boolean" and V.is_text(dtype):
            return F.coalesce(out.cast("string"), value)
        return out

    def ledger(self, spark: SparkSession) -> DataFrame:
        """What was charged, column by column, and what imputation spent of its reserve."""
        return spark.createDataFrame(list(self.ledger_rows), LEDGER_SCHEMA)

    def budget_report(self, spark: SparkSession) -> DataFrame:
        return B.budget_report(self.ledger(spark).where("stage = 'release'"))

    def describe(self, spark: SparkSession) -> DataFrame:
        """One row per column: type, method and parameters."""
        rows = [
            (
                p.ord, p.column, p.semantic_type, p.mechanism.method, p.mechanism.epsilon,
                p.mechanism.sensitivity, p.mechanism.lower, p.mechanism.upper, p.mechanism.mask_type,
                list(p.mechanism.categories), p.released, p.imputation.method,
                p.imputation.missing_count, p.mechanism.formal,
            )
            for p in self.columns
        ]
        return spark.createDataFrame(
            rows,
            "ord int, column string, semantic_type string, method string, epsilon double, "
            "sensitivity double, min double, max double, mask_type string, categories array<string>, "
            "released string, imputation string, missing_count bigint, formal boolean",
        )


def _filled_type(df: DataFrame, p: ColumnPlan) -> T.DataType:
    """The type of a column once its gaps are filled."""
    return T.DoubleType() if p.imputation.number is not None else df.schema[p.column].dataType


def _draw(ord_: int, stream: int) -> str:
    return f"__u_{ord_}_{stream}"


def out_type(p: ColumnPlan, dtype: T.DataType) -> T.DataType:
    if p.semantic_type in NUMERIC_TYPES:
        return T.LongType() if p.mechanism.method == "discrete_laplace" else T.DoubleType()
    return T.BooleanType() if p.semantic_type == "boolean" else T.StringType()


def _kept_profile(states: DataFrame, profiled: Sequence[str]) -> DataFrame:
    known = {r["column"] for r in states.select("column").distinct().collect()}  # as wide as the schema
    if lacking := [c for c in profiled if c not in known]:
        raise ValueError(f"no state of the columns: {lacking}")
    return merged_profile(states.where(F.col("column").isin(list(profiled))))


def fit(
    df: DataFrame,
    key: Sequence[str],
    secret: str | None = None,
    epsilon: float | None = None,
    purpose: str = "general",
    global_epsilon: float = 1.0,
    policy: Mapping[str, Mapping] | DataFrame | None = None,
    overrides: Mapping[str, str] | None = None,
    exclude: Sequence[str] = (),
    release: Sequence[str] | None = None,
    sample_rows: int | None = None,
    distinct: str = "exact",
    impute: str = "typed",
    charge_categorical: bool = True,
    on_exhausted: str = "null",
    adjust_small: bool = False,
    salt: str | None = None,
    digest: str = "md5",
    delta: float = M.DEFAULT_DELTA,
    noise: KeyedNoise | TaskNoise | None = None,
    keep_unreadable: bool = False,
    release_id: str | None = None,
    states: DataFrame | None = None,
) -> AnonymizationPlan:
    """Learn a release plan from a table.

    `key` names the columns that identify a row; for a table without a key name all of them,
    or add one with `sources.tables.with_file_key`. `release` names the columns to release
    (by default all), so that a key need not be among them; `exclude` those that pass as they are.
    `policy` maps column names to settings (method, epsilon, min, max, sensitivity,
    mask_type) or is a policy table; without one the budget is split equally.
    `sample_rows` infers types from the first rows only. `distinct` says how the profile counts
    distinct values, `exact` or `approx`, at every size. `adjust_small` raises an epsilon below 2 to 4
    where a table has fewer than 500 rows. A column that no longer fits the
    budget becomes NULL, stays as it is (`keep`) or stops the run (`error`).
    `states` are kept profiles of the parts of the table (`profile_state`): types are inferred from them, and
    the table is not read for its profile; they go before `sample_rows` and `distinct`.
    `release_id` enters every draw; by default it is a fingerprint of the mechanisms, so that the same plan
    repeats its noise and plans that differ anywhere are independent of each other.
    """
    if on_exhausted not in ("null", "keep", "error"):
        raise ValueError(f"on_exhausted must be 'null', 'keep' or 'error', got {on_exhausted!r}")
    if noise is None:
        if not secret:
            raise ValueError("fit needs a secret for keyed noise, or a noise source")
        noise = KeyedNoise(secret, KEY, digest)
    for name, value in (("epsilon", epsilon), ("global_epsilon", global_epsilon)):
        if value is not None and not value > 0:
            raise ValueError(f"{name} must be positive, got {value}")
    key, names = tuple(key), list(release or df.columns)
    missing = [c for c in [*key, *names] if c not in df.columns]
    missing += [c for c in [*exclude, *(overrides or {})] if c not in names]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    spark = df.sparkSession
    policy = _policy_table(spark, policy)

    sample = df if sample_rows is None else first_rows(df, key, sample_rows)
    # an identifier is hashed whatever it holds
    profiled = [c for c in names if (overrides or {}).get(c) != "id"]
    typed = None
    if profiled:
        measured = profile(sample, profiled, distinct=distinct) if states is None else _kept_profile(states, profiled)
        typed = infer_types(measured)
    profiles = collect_profiles(sample, typed, overrides, names)
    types = {c: p.semantic_type for c, p in profiles.items()}

    fills = {c: Imputation(c, "none", 0) for c in names}
    filled = [c for c in names if c not in exclude]
    if impute == "none":
        rows, gaps = df.count(), {}
    else:
        rows, gaps = count_gaps(df, types, filled, impute)
    budget = _budget(spark, rows, epsilon, purpose, global_epsilon, adjust_small)
    if any(gaps.values()):
        fills.update(fit_imputation(
            df, types, key, budget["preprocessing_epsilon"], noise, filled, impute, (rows, gaps)
        ))
    settings = _settings(spark, names, types, policy, budget["column_budget"])

    chosen: dict[str, M.Mechanism] = {}
    for c in names:
        s, p = settings[c], profiles[c]
        chosen[c] = M.choose(
            c,
            p.semantic_type,
            method=s["method"] if s["from_policy"] and p.semantic_type in M.TYPE_METHODS else None,
            epsilon=s["epsilon"] if s["from_policy"] or policy is None or p.semantic_type != "string" else None,
            minimum=s["min"],
            maximum=s["max"],
            sensitivity=s["sensitivity"],
            mask_type=s["mask_type"],
            num_range=p.num_range,
            non_negative=p.all_non_negative,
            categories=p.categories,
            max_categories=MAX_CATEGORIES,
            delta=delta,
            salt=salt,
        )

    entries = [
        (DATASET, i, c, chosen[c].method, chosen[c].epsilon)
        for i, c in enumerate(names)
        if c not in exclude and chosen[c].private
        and (charge_categorical or chosen[c].method != "categorical_response")
    ]
    decisions = _charge(spark, entries, budget["column_budget"])
    skipped = {r["column"] for r in decisions if not r["admitted"]}
    if skipped and on_exhausted == "error":
        raise ValueError(f"the budget does not reach for {sorted(skipped, key=names.index)}")

    ledger_rows = [
        (DATASET, "imputation", names.index(c), c, f.method, f.epsilon_used, True, None,
         budget["preprocessing_epsilon"], False)
        for c, f in fills.items() if f.epsilon_used > 0
    ] + [
        (DATASET, "release", r["ord"], r["column"], r["operation"], r["epsilon"], r["admitted"],
         r["used_after"], r["total_epsilon"], chosen[r["column"]].formal)
        for r in decisions
    ]
    plans = []
    for i, c in enumerate(names):
        released = "noisy"
        if c in exclude:
            released = "raw"
        elif c in skipped:
            released = "kept" if on_exhausted == "keep" else "null"
        plans.append(ColumnPlan(c, i, chosen[c], fills[c], released))
    return AnonymizationPlan(
        tuple(plans), key, noise, rows, budget["total_epsilon"], budget["preprocessing_epsilon"],
        budget["column_budget"], tuple(ledger_rows), keep_unreadable, bool(overrides),
        _fingerprint(plans) if release_id is None else release_id,
    )


def _fingerprint(plans: Sequence[ColumnPlan]) -> str:
    settings = repr([(p.column, p.mechanism, p.imputation, p.released) for p in plans])
    return hashlib.sha256(settings.encode()).hexdigest()[:16]


def _policy_table(spark: SparkSession, policy) -> DataFrame | None:
    if policy is None:
        return None
    if not isinstance(policy, DataFrame):
        if not policy:
            return None
        unknown = {f for s in policy.values() for f in s} - set(P.POLICY_FIELDS)
        if unknown:
            raise ValueError(f"unknown policy settings: {sorted(unknown)}")
        rows = [
            (DATASET, c, *[_setting(s.get(f), kind) for f, kind in P.POLICY_FIELDS.items()])
            for c, s in policy.items()
        ]
        fields = ", ".join(f"{f} {kind}" for f, kind in P.POLICY_FIELDS.items())
        policy = spark.createDataFrame(rows, f"dataset string, column string, {fields}")
    broken = P.policy_violations(policy).orderBy("column", "violation").take(20)
    if broken:
        raise ValueError("invalid policy: " + ", ".join(f"{r['column']}: {r['violation']}" for r in broken))
    return policy.withColumn("dataset", F.lit(DATASET))


def _setting(value, kind: str):
    return float(value) if kind == "double" and value is not None else value


def _budget(spark, rows, epsilon, purpose, global_epsilon, adjust_small) -> dict[str, float]:
    """Effective epsilon and its split: explicit value, then purpose, then global; size rule last."""
    schema = "dataset string, rows bigint, purpose string, explicit_epsilon double, global_epsilon double"
    explicit = None if epsilon is None else float(epsilon)
    request = spark.createDataFrame([(DATASET, rows, purpose, explicit, float(global_epsilon))], schema)
    counted = F.col("rows") if adjust_small else F.lit(P.SMALL_ROWS)
    resolved = P.resolve_epsilon(request).withColumn("rows", counted)
    return P.split_budget(resolved).first().asDict()


def _settings(spark, names, types, policy, column_budget) -> dict[str, dict]:
    schema = "dataset string, column string, ord int, semantic_type string"
    columns = spark.createDataFrame([(DATASET, c, i, types[c]) for i, c in enumerate(names)], schema)
    settled = {r["column"]: r.asDict() for r in P.column_policy(columns, policy).collect()}
    if policy is None:
        # an equal share of what is left after the reserve, so that the last column still fits,
        # rounded down to the ledger's nine digits
        share = math.floor(column_budget / len(names) * 1e9) / 1e9
        for c in names:
            settled[c]["epsilon"] = share
    return settled


def _charge(spark, entries, column_budget) -> list:
    if not entries:
        return []
    table = spark.createDataFrame(
        entries, "dataset string, ord int, column string, operation string, epsilon double"
    )
    totals = spark.createDataFrame([(DATASET, float(column_budget))], "dataset string, total_epsilon double")
    return sorted(B.folded_ledger(table, totals).collect(), key=lambda r: r["ord"])


def impact_view(df: DataFrame, plan: AnonymizationPlan, key: Sequence[str], n: int = 5) -> DataFrame:
    """The first rows before and after, as two structs."""
    ready = plan._with_draws(first_rows(df, key, n))
    names = [p.column for p in plan.columns]
    return ready.select(
        *[F.col(c).alias(f"key_{c}") for c in key],
        F.struct(*names).alias("original"),
        F.struct(*[plan._released(df, p).alias(p.column) for p in plan.columns]).alias("anonymised"),
    )


def preprocess_summary(
    df: DataFrame,
    key: Sequence[str],
    types: Mapping[str, str],
    fills: Mapping[str, Imputation],
    structure: DataFrame | None = None,
) -> DataFrame:
    """One row for the whole preprocessing: quality, imputation, outliers and the advice."""
    report = Q.quality_report(df, key, structure)
    numeric = [c for c in df.columns if types[c] in NUMERIC_TYPES]
    filled = df.select(*[imputed(df, c, fills[c]).alias(c) for c in df.columns])
    parts = [report]
    if numeric:
        parts.append(outlier_totals(outlier_summary(filled, fit_limits(filled, numeric))))
    wide = one_row(*parts)
    if not numeric:
        wide = wide.withColumn("columns_with_outliers", F.lit(0)).withColumn("total_outliers", F.lit(0))
        wide = wide.withColumn("columns_analyzed", F.lit(0))
    used = [f for f in fills.values() if f.missing_count > 0]
    advice = F.array_compact(F.array(
        F.when(F.col("critical") > 0, F.lit("empty_table")),
        F.when(F.col("total_outliers") > 0, F.lit("outliers_found")),
    ))
    return wide.select(
        F.col("rows").alias("original_rows"),
        F.col("rows").alias("final_rows"),
        "quality_score",
        "quality_assessment",
        "total_missing",
        "duplicate_rows",
        F.lit(len(used)).alias("columns_imputed"),
        F.lit(sum(f.missing_count for f in used)).alias("values_imputed"),
        F.lit(float(sum(f.epsilon_used for f in fills.values()))).alias("epsilon_used"),
        "columns_analyzed",
        "columns_with_outliers",
        "total_outliers",
        ((F.col("critical") > 0).cast("int") + (F.col("total_outliers") > 0).cast("int")).alias("issues_detected"),
        F.concat_ws("; ", advice).alias("recommendations"),
    )


@dataclass(frozen=True)
class Audit:
    """The reports on a release, each a DataFrame."""

    ledger: DataFrame
    budget: DataFrame
    utility: DataFrame
    utility_summary: DataFrame
    risk: DataFrame
    summary: DataFrame


def audit(
    paired: DataFrame,
    plan: AnonymizationPlan,
    quasi_identifiers: Sequence[str] | None = None,
    distinct: str = "exact",
    order: Sequence[str] = (KEY,),
) -> Audit:
    """Budget, utility and risk of a release.

    `paired` comes from `plan.paired`; for a large table write it first and pass the written
    table, so that the noise is not computed once per report.
    """
    spark = paired.sparkSession
    names = [p.column for p in plan.columns if p.released != "null"]
    numeric = plan.numeric_columns
    utility = utility_metrics(paired, numeric)
    totals = utility_summary(utility)
    risk = risk_report(paired, names, numeric, order, quasi_identifiers, distinct=distinct)
    budget = plan.budget_report(spark)
    summary = one_row(
        budget.select("used_epsilon", "remaining_epsilon", "utilization"),
        totals,
        risk.select("rows", "overall_risk", "linkage_label"),
    ).withColumn("detection_mode", F.lit("override" if plan.overridden else "heuristic"))
    return Audit(plan.ledger(spark), budget, utility, totals, risk, summary)


def with_noise(plan: AnonymizationPlan, noise: KeyedNoise | TaskNoise) -> AnonymizationPlan:
    """The same plan with another noise source, for instance a fresh secret."""
    return replace(plan, noise=noise)
