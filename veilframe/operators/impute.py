"""Missing-value imputation: a noisy mean for numbers, the mode for text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import values as V
from veilframe.functions.noise import laplace_sample
from veilframe.functions.rng import KeyedNoise, TaskNoise
from veilframe.operators.profile import NUMERIC_TYPES

MEDIAN_BELOW = 10
MIN_SENSITIVITY = 0.1
ALL_MISSING_TEXT = "unknown"


@dataclass(frozen=True)
class Imputation:
    """What replaces the missing cells of one column."""

    column: str
    method: str
    missing_count: int
    number: float | None = None
    text: str | None = None
    epsilon_used: float = 0.0


def numeric_imputation(
    df: DataFrame,
    columns: Sequence[str],
    epsilon: float,
    noise: KeyedNoise | TaskNoise,
    exact_median: bool = False,
) -> DataFrame:
    """One row per column: method, missing cells and the value to put there.

    Ten values and more give the mean with Laplace noise of scale max(range / n, 0.1) / epsilon
    (`dp_mean`), fewer their median with noise of scale max(range, 0.1) / epsilon (`dp_median`).
    `exact_median` fills in the median as it is (`median`): that is a cell, or the mean of two, of the
    table, and no epsilon makes it private. True means are not part of the result.
    """
    if not epsilon > 0:
        raise ValueError(f"epsilon must be positive, got {epsilon}")
    numbers = {c: V.to_number(F.col(c), df.schema[c].dataType) for c in columns}
    counts = {}
    for i, c in enumerate(columns):
        v = numbers[c]
        n = F.count(v)
        counts[i] = [
            n.alias(f"n_{i}"), (F.count(F.lit(1)) - n).alias(f"missing_{i}"), F.avg(v).alias(f"centre_{i}"),
            (F.max(v) - F.min(v)).alias(f"range_{i}"),
        ]
    found = df.agg(*[a for several in counts.values() for a in several]).first()
    few = [i for i in counts if 0 < found[f"n_{i}"] < MEDIAN_BELOW and found[f"missing_{i}"]]
    # at most nine values of each of these columns are held by the aggregate
    medians = df.agg(*[F.percentile(numbers[columns[i]], 0.5).alias(f"m_{i}") for i in few]).first() if few else {}
    draws, rows = noise.dataset_level(), []
    for i, c in enumerate(columns):
        n, missing, width = found[f"n_{i}"], found[f"missing_{i}"], found[f"range_{i}"]
        method, number, scale = "none", None, None
        if missing and n == 0:
            method, number = "zero_fallback", 0.0
        elif missing and i in few:
            method, number, scale = "dp_median", medians[f"m_{i}"], max(width, MIN_SENSITIVITY) / epsilon
            if exact_median:
                method, scale = "median", None
        elif missing:
            method, number, scale = "dp_mean", found[f"centre_{i}"], max(width / n, MIN_SENSITIVITY) / epsilon
        value = F.lit(number).cast("double")
        if scale is not None:
            # the epsilon names the draw, so that fills of two budgets cannot be solved for the mean
            value = value + laplace_sample(draws.uniform(c, f"impute/{float(epsilon)!r}"), scale)
        rows.append(F.struct(
            F.lit(c).alias("column"), F.lit(i).alias("ord"), F.lit(method).alias("method"),
            F.lit(missing).cast("bigint").alias("missing_count"), value.alias("number"),
            F.lit(0.0 if scale is None else float(epsilon)).alias("epsilon_used"),
        ))
    return df.sparkSession.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def mode_imputation(df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """One row per column: missing cells and the most frequent value, ties to the one whose
    first row comes first in `key` order."""
    slots = [f"v_{i}" for i in range(len(columns))]
    present = [
        F.when(~V.is_missing(F.col(c), df.schema[c].dataType), F.col(c).cast("string")).alias(slot)
        for c, slot in zip(columns, slots)
    ]
    order = F.col(key[0]) if len(key) == 1 else F.struct(*key)
    cells = df.select(order.alias("order"), *present).unpivot(["order"], slots, "slot", "value")
    # a minimum of plain numbers is kept by a hash aggregate; of anything else it would sort
    # every cell, so there the first rows are looked up later, for tied values only
    cheap = len(key) == 1 and V.is_number(df.schema[key[0]].dataType)
    first = [F.min("order").alias("first")] if cheap else []
    counted = cells.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"), *first)
    per_column = counted.groupBy("slot").agg(
        F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("mode_frequency"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing_count"),
        F.count("value").alias("unique_values"),
    )
    wanted = per_column.where("missing_count > 0").select("slot", F.col("mode_frequency").alias("n"))
    ties = counted.where("value IS NOT NULL").join(F.broadcast(wanted), ["slot", "n"])  # a row per column
    if cheap:
        modes = ties.groupBy("slot").agg(F.min_by("value", "first").alias("mode"))
    else:
        tied = ties.groupBy("slot").agg(F.count(F.lit(1)).alias("tied"), F.max("value").alias("only"))
        several = ties.join(F.broadcast(tied.where("tied > 1").select("slot")), "slot", "left_semi")
        earliest = (
            cells.join(several, ["slot", "value"], "left_semi")
            .groupBy("slot").agg(F.min_by("value", "order").alias("earliest"))
        )
        modes = tied.join(earliest, "slot", "left").select("slot", F.coalesce("earliest", "only").alias("mode"))
    names = F.array(*[F.lit(c) for c in columns])
    ord_ = F.substring_index("slot", "_", -1).cast("int")
    missing = F.col("missing_count")
    method = (
        F.when(missing == 0, F.lit("none")).when(F.col("unique_values") == 0, F.lit("unknown_fallback"))
        .otherwise(F.lit("mode"))
    )
    return (
        per_column.join(modes, "slot", "left")
        .select(
            F.element_at(names, ord_ + 1).alias("column"),
            ord_.alias("ord"),
            method.alias("method"),
            missing,
            F.when(method == "mode", F.col("mode"))
            .when(method == "unknown_fallback", F.lit(ALL_MISSING_TEXT)).alias("text"),
            F.when(method == "mode", F.col("mode_frequency")).alias("mode_frequency"),
        )
    )


def _by_kind(types: Mapping[str, str], columns: Sequence[str], strategy: str) -> tuple[list[str], list[str]]:
    """Columns that are filled with a number, and those filled with a text."""
    if strategy not in ("typed", "mode"):
        raise ValueError(f"strategy must be 'typed' or 'mode', got {strategy!r}")
    if strategy == "mode":
        return [], [c for c in columns if types[c] != "id"]
    return (
        [c for c in columns if types[c] in NUMERIC_TYPES],
        [c for c in columns if types[c] in ("string", "boolean")],
    )


def count_gaps(
    df: DataFrame, types: Mapping[str, str], columns: Sequence[str], strategy: str = "typed"
) -> tuple[int, dict[str, int]]:
    """Rows of the table and the missing cells of each column that can be filled, in one pass."""
    numeric, texts = _by_kind(types, columns, strategy)
    found = df.agg(F.count(F.lit(1)).alias("__rows"), *[
        F.count_if(
            V.to_number(F.col(c), df.schema[c].dataType).isNull() if c in numeric
            else V.is_missing(F.col(c), df.schema[c].dataType)
        ).alias(c)
        for c in numeric + texts
    ]).first().asDict()
    return found.pop("__rows"), found


def fit_imputation(
    df: DataFrame,
    types: Mapping[str, str],
    key: Sequence[str],
    epsilon: float,
    noise: KeyedNoise | TaskNoise,
    columns: Sequence[str] | None = None,
    strategy: str = "typed",
    gaps: tuple[int, Mapping[str, int]] | None = None,
    exact_median: bool = False,
) -> dict[str, Imputation]:
    """Imputation of every column, by its semantic type.

    Each column may spend an equal share of `epsilon`; only a noisy mean or median spends it.
    `strategy="mode"` fills every column with its mode; `id` columns are never filled.
    Statistics are read only for the columns that have `gaps`, the result of `count_gaps`.
    """
    columns = list(columns or df.columns)
    _, missing = gaps or count_gaps(df, types, columns, strategy)
    numeric, texts = (
        [c for c in kind if missing.get(c)] for kind in _by_kind(types, columns, strategy)
    )
    out = {c: Imputation(c, "none", 0) for c in columns}
    if numeric:
        for r in numeric_imputation(df, numeric, epsilon / len(columns), noise, exact_median).collect():
            out[r["column"]] = Imputation(
                r["column"], r["method"], r["missing_count"], r["number"], None, r["epsilon_used"]
            )
    if texts:
        for r in mode_imputation(df, texts, key).collect():
            out[r["column"]] = Imputation(r["column"], r["method"], r["missing_count"], None, r["text"])
    return out


def imputed(df: DataFrame, column: str, imputation: Imputation) -> Column:
    """The column with its missing cells filled."""
    dtype = df.schema[column].dataType
    c = F.col(column)
    if imputation.number is not None:
        return F.coalesce(V.to_number(c, dtype), F.lit(imputation.number))
    if imputation.text is not None:
        fill = F.lit(imputation.text)
        if not V.is_text(dtype):
            fill = fill.try_cast(dtype)
        return F.when(V.is_missing(c, dtype), fill).otherwise(c)
    return c
