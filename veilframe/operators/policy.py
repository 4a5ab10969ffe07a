"""Privacy policy as tables: validation, purposes, column settings and budget rules.

A policy table has (dataset, column, method, epsilon, min, max, sensitivity, mask_type); it
may hold the settings of every dataset of a catalogue. A purpose table has (dataset,
purpose, epsilon, description, compliance_note).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = [
    "laplace", "bounded_laplace", "discrete_laplace", "scaled_laplace",
    "gaussian", "bounded_gaussian", "randomized_response", "exact_laplace", "exact_gaussian",
]
# Methods that the released policy format knows.
BASIC_METHODS = ["laplace", "bounded_laplace", "discrete_laplace", "randomized_response"]
MASK_TYPES = ["partial", "hash", "full"]
DEFAULT_METHOD = "laplace"
DEFAULT_EPSILON = 1.0

# The standard purposes.
STANDARD_PURPOSES = [
    ("general", 1.0, "General purpose anonymization",
     "Standard privacy protection for general use cases"),
    ("qa_testing", 1.5, "QA testing and software development",
     "Moderate privacy for testing scenarios requiring better utility"),
    ("model_retraining", 0.5, "Machine learning model training",
     "Stricter privacy guarantees for ML training data"),
    ("analytics", 0.8, "Business analytics and reporting",
     "Balanced privacy for analytical use cases"),
    ("data_sharing", 0.3, "External data sharing",
     "Maximum privacy protection for data shared with third parties"),
]
# Settings of a column that the policy does not name, by semantic type.
TYPE_DEFAULTS = {
    "age": {"method": "bounded_laplace", "epsilon": 0.2, "min": 18.0, "max": 90.0},
    "year": {"method": "bounded_laplace", "epsilon": 0.2, "min": 1900.0, "max": 2050.0},
    "monetary": {"method": "laplace", "epsilon": 0.3, "sensitivity": 1000.0},
    "numeric": {"method": "laplace", "epsilon": 0.3},
    "count": {"method": "discrete_laplace", "epsilon": 0.2},
    "boolean": {"method": "randomized_response", "epsilon": 0.5},
    "string": {"mask_type": "partial"},
}
OTHER_DEFAULT = {"method": "laplace", "epsilon": 0.2}
# What is said of a purpose that is not configured.
CUSTOM_PURPOSE = ("Custom purpose", "No specific compliance notes")

SMALL_ROWS = 500
SMALL_EPSILON_LIMIT = 2.0
SMALL_EPSILON = 4.0
PREPROCESSING_SHARE = 0.1
PREPROCESSING_MAX = 0.1

POLICY_FIELDS = {
    "method": "string", "epsilon": "double", "min": "double", "max": "double",
    "sensitivity": "double", "mask_type": "string",
}


def standard_purposes(spark: SparkSession) -> DataFrame:
    schema = "purpose string, epsilon double, description string, compliance_note string"
    return spark.createDataFrame(STANDARD_PURPOSES, schema)


def type_defaults(spark: SparkSession) -> DataFrame:
    rows = [
        (t, *[settings.get(f) for f in POLICY_FIELDS]) for t, settings in TYPE_DEFAULTS.items()
    ]
    fields = ", ".join(f"{f} {t}" for f, t in POLICY_FIELDS.items())
    return spark.createDataFrame(rows, f"semantic_type string, {fields}")


def policy_violations(policy: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """One row per broken rule: (dataset, column, violation).

    Bounds are judged only for bounded methods, numbers may come as text.
    """
    known = methods or METHODS

    def number(c: str) -> Column:
        return F.col(c).cast("string").try_cast("double")

    method = F.coalesce("method", F.lit(DEFAULT_METHOD))
    bounded = method.startswith("bounded_")
    rules = [
        (~method.isin(known), "method_unknown"),
        (_not_positive("epsilon"), "epsilon_not_positive"),
        (bounded & F.col("min").isNotNull() & number("min").isNull(), "min_not_numeric"),
        (bounded & F.col("max").isNotNull() & number("max").isNull(), "max_not_numeric"),
        (bounded & (number("max") <= number("min")), "max_not_above_min"),
        (_not_positive("sensitivity"), "sensitivity_not_positive"),
        (~F.col("mask_type").isin(MASK_TYPES), "mask_type_unknown"),
    ]
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))
    return policy.select("dataset", "column", F.explode(broken).alias("violation"))


def _not_positive(c: str) -> Column:
    """Given, but not a number above zero."""
    value = F.col(c).cast("string").try_cast("double")
    return F.col(c).isNotNull() & ~F.coalesce(value > 0, F.lit(False))


def purpose_violations(purposes: DataFrame) -> DataFrame:
    """Purposes without a name or with an epsilon that is not above zero."""
    name = F.col("purpose").isNull() | (F.trim("purpose") == "")
    rules = [(name, "purpose_not_named"), (_not_positive("epsilon"), "epsilon_not_positive")]
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(text)) for rule, text in rules]))
    return purposes.select("dataset", "purpose", F.explode(broken).alias("violation"))


def merge_purposes(purposes: DataFrame, global_epsilon: Column) -> DataFrame:
    """Configured purposes with a missing epsilon filled from the standard one, else the global."""
    standard = standard_purposes(purposes.sparkSession).select(
        "purpose", F.col("epsilon").alias("standard_epsilon")
    )
    return (
        purposes.join(F.broadcast(standard), "purpose", "left")  # five rows
        .withColumn("epsilon", F.coalesce("epsilon", "standard_epsilon", global_epsilon))
        .drop("standard_epsilon")
    )


def resolve_epsilon(requests: DataFrame, purposes: DataFrame | None = None) -> DataFrame:
    """Effective epsilon of each request: (…, dataset, purpose, explicit_epsilon, global_epsilon).

    The order is explicit, configured purpose, standard purpose, global, 1.0. The purpose
    `general` stands for the global value unless it is configured.
    """
    standard = standard_purposes(requests.sparkSession).where("purpose <> 'general'").select(
        "purpose", F.col("epsilon").alias("standard_epsilon")
    )
    out = requests.join(F.broadcast(standard), "purpose", "left")  # four rows
    configured = F.lit(None).cast("double")
    if purposes is not None:
        own = purposes.select("dataset", "purpose", F.col("epsilon").alias("configured_epsilon"))
        out = out.join(own, ["dataset", "purpose"], "left")
        configured = F.col("configured_epsilon")
    chosen = F.coalesce(
        "explicit_epsilon", configured, "standard_epsilon", "global_epsilon", F.lit(DEFAULT_EPSILON)
    )
    source = (
        F.when(F.col("explicit_epsilon").isNotNull(), F.lit("explicit"))
        .when(configured.isNotNull(), F.lit("configured"))
        .when(F.col("standard_epsilon").isNotNull(), F.lit("standard"))
        .otherwise(F.lit("global"))
    )
    out = out.withColumn("epsilon", chosen).withColumn("epsilon_source", source)
    return out.drop("standard_epsilon", "configured_epsilon")


def available_purposes(purposes: DataFrame) -> DataFrame:
    """Every purpose a dataset can name: its own, and the standard ones it does not redefine.

    (dataset, purpose, epsilon, description, compliance_note, configured)
    """
    standard = standard_purposes(purposes.sparkSession)
    datasets = purposes.select("dataset").distinct()
    offered = datasets.select(
        "dataset",
        F.inline(F.array(*[
            F.struct(
                F.lit(p).alias("purpose"), F.lit(e).alias("epsilon"),
                F.lit(d).alias("description"), F.lit(n).alias("compliance_note"),
            )
            for p, e, d, n in STANDARD_PURPOSES
        ])),
    )
    own = purposes.select(*["dataset", *standard.columns]).withColumn("configured", F.lit(True))
    rest = offered.join(purposes, ["dataset", "purpose"], "left_anti").withColumn("configured", F.lit(False))
    return own.unionByName(rest)


def purpose_info(requests: DataFrame, purposes: DataFrame, global_epsilon: float = DEFAULT_EPSILON) -> DataFrame:
    """What is known about the purpose of each request (dataset, purpose)."""
    known = available_purposes(purposes)
    joined = requests.join(known, ["dataset", "purpose"], "left")
    description, note = CUSTOM_PURPOSE
    found = F.col("configured").isNotNull()
    return (
        joined.withColumn("description", F.when(found, F.col("description")).otherwise(F.lit(description)))
        .withColumn("compliance_note", F.when(found, F.col("compliance_note")).otherwise(F.lit(note)))
        .withColumn("epsilon", F.coalesce("epsilon", F.lit(float(global_epsilon))))
    )


def column_policy(columns: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """Settings of each column (dataset, column, semantic_type, …).

    A column named in the policy takes all its settings from there; any other column takes
    the defaults of its type.
    """
    fields = list(POLICY_FIELDS)
    defaults = type_defaults(columns.sparkSession).select(
        "semantic_type", *[F.col(f).alias(f"default_{f}") for f in fields]
    )
    out = columns.join(F.broadcast(defaults), "semantic_type", "left")  # seven rows
    known = F.col("semantic_type").isin(list(TYPE_DEFAULTS))
    own = F.lit(False)
    if policy is not None:
        named = policy.select(
            "dataset", "column", *[F.col(f).alias(f"own_{f}") for f in fields], F.lit(True).alias("own")
        )
        out = out.join(named, ["dataset", "column"], "left")
        own = F.coalesce("own", F.lit(False))
    for f, kind in POLICY_FIELDS.items():
        default = F.when(known, F.col(f"default_{f}")).otherwise(F.lit(OTHER_DEFAULT.get(f)).cast(kind))
        chosen = default if policy is None else F.when(own, F.col(f"own_{f}")).otherwise(default)
        out = out.withColumn(f, chosen)
    drop = [f"default_{f}" for f in fields] + [f"own_{f}" for f in fields] + ["own"]
    return out.withColumn("from_policy", own).drop(*drop)


def auto_assign(columns: DataFrame, totals: DataFrame) -> DataFrame:
    """Equal split of a dataset's epsilon over all its columns; other settings stay.

    `columns` has (dataset, column, …, epsilon), `totals` has (dataset, total_epsilon).
    """
    counted = columns.groupBy("dataset").agg(F.count(F.lit(1)).alias("columns"))
    shares = totals.join(counted, "dataset").select(
        "dataset", (F.col("total_epsilon") / F.col("columns")).alias("share")
    )
    return columns.join(shares, "dataset").withColumn("epsilon", F.col("share")).drop("share")


def effective_epsilon(rows: Column, epsilon: Column) -> Column:
    """A small dataset gets a larger epsilon, or nothing of it would be left."""
    small = (rows < SMALL_ROWS) & (epsilon < SMALL_EPSILON_LIMIT)
    return F.when(small, F.lit(SMALL_EPSILON)).otherwise(epsilon)


def preprocessing_reserve(epsilon: Column) -> Column:
    """The part of epsilon set aside for imputation."""
    return F.least(F.lit(PREPROCESSING_MAX), epsilon * F.lit(PREPROCESSING_SHARE))


def split_budget(datasets: DataFrame) -> DataFrame:
    """(dataset, rows, epsilon) with the size rule applied and the reserve split off."""
    return (
        datasets.withColumn("total_epsilon", effective_epsilon(F.col("rows"), F.col("epsilon")))
        .withColumn("preprocessing_epsilon", preprocessing_reserve(F.col("total_epsilon")))
        .withColumn("column_budget", F.col("total_epsilon") - F.col("preprocessing_epsilon"))
    )
