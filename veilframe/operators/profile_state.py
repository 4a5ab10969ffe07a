"""Column profiles that are kept per file or day and merged without the table.

A state has one row per part and column: exact counts, limits and sums, a sketch of the distinct
values and of the distinct numbers, a sketch of the ranks and a summary of the frequent values. Each is
mergeable, so the state of a table is the merged state of its parts, in any order, and a new
part costs one scan of that part. A state row is a few kilobytes, whatever the part holds.

Exact in the merged profile: counts, shares, limits, lengths, whole numbers; the mean up to rounding.
Estimates: distinct counts (relative deviation 1.6 % with 2^12 registers) and quantiles (ranks off
by 1.3 % at k = 200; figures of the sketches' documentation). Frequent values are exact while a
column has not more than TRACKED distinct values, otherwise their counts are estimates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import values as V
from veilframe.operators import profile as P

REGISTERS_LOG2 = 12
RANKS_K = 200
TRACKED = 1000

# How each measure of a state row is taken from a part and how it is merged; {i} is the column.
_COUNTED = "count(case when class_{i} = '%s' then 1 end)"
_NUMBER = "case when class_{i} = 'numeric' then raw_{i} end"
_TEXT = "case when class_{i} is not null then value_{i} end"
MEASURES = {
    "rows": ("count(1)", "sum(rows)"),
    "total_count": ("count(class_{i})", "sum(total_count)"),
    "n_numeric": (_COUNTED % "numeric", "sum(n_numeric)"),
    "n_boolean": (_COUNTED % "boolean", "sum(n_boolean)"),
    "n_string": (_COUNTED % "string", "sum(n_string)"),
    "num_min": (f"min({_NUMBER})", "min(num_min)"),
    "num_max": (f"max({_NUMBER})", "max(num_max)"),
    "num_sum": (f"sum({_NUMBER})", "sum(num_sum)"),
    "is_integer": ("bool_and(case when class_{i} = 'numeric' then raw_{i} = rint(raw_{i}) end)", "bool_and(is_integer)"),
    "sum_length": ("sum(case when class_{i} = 'string' then char_length(value_{i}) end)", "sum(sum_length)"),
    "numbers": (f"hll_sketch_agg({_NUMBER.replace('raw', 'key')}, {REGISTERS_LOG2})", "hll_union_agg(numbers)"),
    "texts": (f"hll_sketch_agg({_TEXT}, {REGISTERS_LOG2})", "hll_union_agg(texts)"),
    "ranks": (f"kll_sketch_agg_double({_NUMBER}, {RANKS_K})", "kll_merge_agg_double(ranks)"),
    "frequent": (f"approx_top_k_accumulate({_TEXT}, {TRACKED})", f"approx_top_k_combine(frequent, {TRACKED})"),
}


def profile_state(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, column, ord, measures): one row per part and column, from one scan.

    `by` names the columns that tell the parts apart; without it the whole table is one part. An empty
    table without `by` has one part with zero rows, an empty part does not appear.
    """
    columns = list(columns or [c for c in df.columns if c not in by])
    typed: list[Column] = [F.col(c) for c in by]
    for i, c in enumerate(columns):
        dtype = df.schema[c].dataType
        raw = V.to_number(F.col(c), dtype)
        text = F.trim(F.col(c)) if V.is_text(dtype) else F.col(c).cast("string")
        # numbers are told apart by their text, 0.0 and -0.0 being one
        typed += [V.value_class(F.col(c), dtype).alias(f"class_{i}"), raw.alias(f"raw_{i}"),
                  (raw + F.lit(0.0)).cast("string").alias(f"key_{i}"), text.alias(f"value_{i}")]
    parts = df.select(*typed).groupBy(*by).agg(*[
        F.expr(taken.format(i=i)).alias(f"{name}_{i}") for i in range(len(columns)) for name, (taken, _) in MEASURES.items()
    ])
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("ord"), *[F.col(f"{name}_{i}").alias(name) for name in MEASURES])
        for i, c in enumerate(columns)
    ]
    return parts.select(*by, F.inline(F.array(*rows)))


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States with the parts of each `by` merged into one; without `by`, of each column."""
    return states.groupBy(*by, "column").agg(
        F.min("ord").alias("ord"), *[F.expr(merged).alias(name) for name, (_, merged) in MEASURES.items()]
    )


def merged_profile(states: DataFrame) -> DataFrame:
    """The rows of `profile` for the union of the parts; distinct counts are estimates."""
    merged = merge_states(states)
    total = F.col("total_count")
    estimates = merged.withColumns({
        "num_unique": F.least(F.hll_sketch_estimate("numbers"), "n_numeric"),
        "unique_count": F.least(F.hll_sketch_estimate("texts"), "total_count"),
    })
    return estimates.select("column", "ord", "total_count", *P.measures_of(total))


def merged_uniqueness(states: DataFrame) -> DataFrame:
    """The rows of `uniqueness` by estimates, a missing value being one value more."""
    unique = F.least(F.hll_sketch_estimate("texts"), "total_count") + (F.col("rows") > F.col("total_count")).cast("bigint")
    return merge_states(states).select(
        "column", "ord", "rows", unique.alias("unique_values"), F.try_divide(unique, "rows").alias("uniqueness")
    )


def merged_quantiles(states: DataFrame, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, share, value): quantiles of the numeric columns of the union."""
    merged = merge_states(states).where("n_numeric > 0")
    wanted = [F.struct(F.lit(float(s)).alias("share"),
                       F.kll_sketch_get_quantile_double("ranks", F.lit(float(s))).alias("value")) for s in shares]
    return merged.select("column", F.inline(F.array(*wanted)))


def merged_frequent(states: DataFrame, k: int = 15) -> DataFrame:
    """(column, item, count): the k most frequent values of each column of the union."""
    found = F.explode(F.expr(f"approx_top_k_estimate(frequent, {int(k)})")).alias("found")
    return merge_states(states).where("total_count > 0").select("column", found).select(
        "column", F.col("found.item").alias("item"), F.col("found.count").alias("count")
    )
