"""Utility of a release: how far means, deviations and single values moved.

The operators read a paired table, in which column c has its released value in c__noisy.
Every column is measured in the same pass, over the rows where both values are numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import values as V
from veilframe.operators.cells import stack_rows

NOISY = "__noisy"
STATISTICS = ("n", "mean_o", "mean_n", "std_o", "std_n", "mae", "low", "high")


def pair_statistics(paired: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with the raw aggregates."""
    aggregates = []
    for i, c in enumerate(columns):
        o = V.to_number(F.col(c), paired.schema[c].dataType)
        n = V.to_number(F.col(c + NOISY), paired.schema[c + NOISY].dataType)
        both = o.isNotNull() & n.isNotNull()
        o, n = F.when(both, o), F.when(both, n)
        measures = (
            F.count(o), F.avg(o), F.avg(n), F.stddev_samp(o), F.stddev_samp(n), F.avg(F.abs(o - n)),
            F.min(o), F.max(o),
        )
        aggregates += [m.alias(f"{name}_{i}") for name, m in zip(STATISTICS, measures)]
    fields = {name: {c: f"{name}_{i}" for i, c in enumerate(columns)} for name in STATISTICS}
    return stack_rows(paired.agg(*aggregates), columns, fields)


def utility_score(relative_error: Column, std_change_pct: Column, mae: Column, max_error: Column) -> Column:
    """0 to 100: half for the mean, 30 % for the deviation, 20 % for single values."""

    def part(loss: Column) -> Column:
        return F.greatest(F.lit(0.0), F.lit(1.0) - loss)

    score = 50.0 * part(relative_error) + 30.0 * part(F.abs(std_change_pct) / 50.0) + 20.0 * part(mae / max_error)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), score))


def error_band(relative_error_pct: Column) -> Column:
    return (
        F.when(relative_error_pct < 10, F.lit("good"))
        .when(relative_error_pct <= 25, F.lit("moderate"))
        .otherwise(F.lit("significant"))
    )


def utility_metrics(paired: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column; columns with fewer than two complete pairs are left out."""
    stats = pair_statistics(paired, columns).where(F.col("n") >= 2)
    mean_o, std_o = F.col("mean_o"), F.col("std_o")
    absolute = F.abs(mean_o - F.col("mean_n"))
    relative = F.when(mean_o == 0, F.lit(0.0)).otherwise(absolute / F.abs(mean_o))
    std_pct = F.when(std_o == 0, F.lit(0.0)).otherwise((F.col("std_n") - std_o) / std_o * 100.0)
    spread = F.col("high") - F.col("low")
    max_error = F.when(spread > 0, spread * 0.1).otherwise(F.lit(1.0))
    return stats.select(
        "column",
        "ord",
        F.col("n").alias("sample_size"),
        mean_o.alias("original_mean"),
        F.col("mean_n").alias("noisy_mean"),
        absolute.alias("absolute_error"),
        (relative * 100.0).alias("relative_error"),
        std_o.alias("original_std"),
        F.col("std_n").alias("noisy_std"),
        (F.col("std_n") - std_o).alias("std_change"),
        std_pct.alias("std_change_pct"),
        "mae",
        utility_score(relative, std_pct, F.col("mae"), max_error).alias("utility_score"),
        error_band(relative * 100.0).alias("error_band"),
    )


def utility_summary(metrics: DataFrame) -> DataFrame:
    """One row: analysed columns, their average score and its grade."""
    average = F.avg("utility_score")
    return metrics.agg(
        F.count(F.lit(1)).alias("columns_analyzed"), average.alias("average_score")
    ).withColumn("grade", grade(F.col("average_score")))


def grade(score: Column) -> Column:
    return (
        F.when(score >= 80, F.lit("EXCELLENT")).when(score >= 60, F.lit("GOOD"))
        .when(score >= 40, F.lit("FAIR")).when(score.isNotNull(), F.lit("POOR"))
    )


def chart_data(metrics: DataFrame) -> DataFrame:
    """What a bar chart of a release shows: score and relative error of each column."""
    return metrics.select("column", "utility_score", "relative_error")
