"""Outliers by z-score and by interquartile range."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import values as V
from veilframe.operators.cells import stack_rows
from veilframe.operators.order_stats import order_statistics
from veilframe.operators.profile import first_rows

Z_THRESHOLD = 3.0
IQR_MULTIPLIER = 1.5
MAX_DETAILS = 10


@dataclass(frozen=True)
class OutlierLimits:
    """Statistics of one column and the limits drawn from them."""

    column: str
    n: int
    mean: float | None
    std: float | None
    low: float | None
    high: float | None
    median: float | None
    q1: float | None
    q3: float | None
    z_threshold: float
    iqr_multiplier: float

    def z_score(self, v: Column) -> Column:
        if self.n < 3 or not self.std:
            return F.lit(None).cast("double")
        return F.abs(v - F.lit(self.mean)) / F.lit(self.std)

    def is_zscore(self, v: Column) -> Column:
        return F.coalesce(self.z_score(v) > F.lit(self.z_threshold), F.lit(False))

    def iqr_side(self, v: Column) -> Column:
        """`low_outlier`, `high_outlier` or NULL."""
        if self.n < 4:
            return F.lit(None).cast("string")
        reach = self.iqr_multiplier * (self.q3 - self.q1)
        return F.when(v < F.lit(self.q1 - reach), F.lit("low_outlier")).when(
            v > F.lit(self.q3 + reach), F.lit("high_outlier")
        )


def fit_limits(
    df: DataFrame,
    columns: Sequence[str],
    z_threshold: float = Z_THRESHOLD,
    iqr_multiplier: float = IQR_MULTIPLIER,
) -> dict[str, OutlierLimits]:
    """Limits of every column: one aggregate for all, then their quartiles together.

    The quartiles are the elements at n//4 and 3n//4 of the sorted values.
    """
    aggregates = []
    for i, c in enumerate(columns):
        v = V.to_number(F.col(c), df.schema[c].dataType)
        aggregates += [
            F.count(v).alias(f"n_{i}"),
            F.avg(v).alias(f"mean_{i}"),
            F.stddev_samp(v).alias(f"std_{i}"),
            F.min(v).alias(f"low_{i}"),
            F.max(v).alias(f"high_{i}"),
        ]
    row = df.agg(*aggregates).first()
    stats = {c: [row[f"{f}_{i}"] for f in ("n", "mean", "std", "low", "high")] for i, c in enumerate(columns)}
    ranks, bounds = {}, {}
    for c, (n, _, _, low, high) in stats.items():
        if n >= 3:
            ranks[c] = [n // 4, 3 * n // 4, (n - 1) // 2, n // 2]
            bounds[c] = (n, low, high)
    found = order_statistics(df, ranks, bounds) if ranks else {}
    out = {}
    for c, (n, mean, std, low, high) in stats.items():
        q1, q3, below, above = found.get(c, [None] * 4)
        median = None if below is None else (below + above) / 2
        out[c] = OutlierLimits(c, n, mean, std, low, high, median, q1, q3, z_threshold, iqr_multiplier)
    return out


def zscore_outliers(df: DataFrame, column: str, limits: OutlierLimits, key: Sequence[str]) -> DataFrame:
    v = V.to_number(F.col(column), df.schema[column].dataType)
    return df.where(limits.is_zscore(v)).select(*key, v.alias("value"), limits.z_score(v).alias("z_score"))


def iqr_outliers(df: DataFrame, column: str, limits: OutlierLimits, key: Sequence[str]) -> DataFrame:
    v = V.to_number(F.col(column), df.schema[column].dataType)
    side = limits.iqr_side(v)
    return df.where(side.isNotNull()).select(*key, v.alias("value"), side.alias("outlier_type"))


def outlier_details(
    df: DataFrame, column: str, limits: OutlierLimits, key: Sequence[str], n: int = MAX_DETAILS
) -> DataFrame:
    """The first outliers for a report, those by z-score before the others."""
    v = V.to_number(F.col(column), df.schema[column].dataType)
    is_z = limits.is_zscore(v)
    found = df.where(is_z | limits.iqr_side(v).isNotNull()).select(
        *key,
        v.alias("value"),
        F.when(is_z, F.lit("zscore")).otherwise(F.lit("iqr")).alias("outlier_type"),
    )
    return first_rows(found, [F.desc("outlier_type"), *key], n)


def outlier_summary(df: DataFrame, limits: dict[str, OutlierLimits]) -> DataFrame:
    """One row per column: counts by either method, their union, and the statistics."""
    columns = list(limits)
    aggregates, fields = [], {"zscore_outliers": {}, "iqr_outliers": {}, "total_outliers": {}}
    for i, c in enumerate(columns):
        v = V.to_number(F.col(c), df.schema[c].dataType)
        is_z, is_iqr = limits[c].is_zscore(v), limits[c].iqr_side(v).isNotNull()
        for field, hit in (("zscore_outliers", is_z), ("iqr_outliers", is_iqr), ("total_outliers", is_z | is_iqr)):
            aggregates.append(F.count_if(hit).alias(f"{field}_{i}"))
            fields[field][c] = f"{field}_{i}"
    counted = stack_rows(df.agg(*aggregates), columns, fields)

    def constant(attribute: str, cast: str = "double") -> Column:
        values = [F.lit(getattr(limits[c], attribute)).cast(cast) for c in columns]
        return F.element_at(F.array(*values), F.col("ord") + 1)

    n = constant("n", "bigint")
    enough = n >= 3
    return counted.select(
        "column",
        "ord",
        enough.alias("analysis_performed"),
        F.when(~enough, F.lit("insufficient_data")).alias("reason"),
        n.alias("sample_size"),
        "zscore_outliers",
        "iqr_outliers",
        "total_outliers",
        F.when(enough, F.col("total_outliers") * 100.0 / n).alias("outlier_percentage"),
        constant("mean").alias("mean"),
        constant("median").alias("median"),
        constant("std").alias("std"),
        constant("low").alias("min"),
        constant("high").alias("max"),
    )


def outlier_totals(summary: DataFrame) -> DataFrame:
    """One row over all columns of a summary."""
    return summary.agg(
        F.count_if("analysis_performed").alias("columns_analyzed"),
        F.count_if(F.col("total_outliers") > 0).alias("columns_with_outliers"),
        F.coalesce(F.sum("total_outliers"), F.lit(0)).alias("total_outliers"),
    )
