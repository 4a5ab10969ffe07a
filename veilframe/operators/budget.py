"""The privacy budget: which columns of a dataset may spend their epsilon.

Admission is greedy in column order. An entry that does not fit is skipped and does not
count, and a later, smaller one may still fit; a running sum cannot express that. The
columns of a table are folded as an array as wide as its schema (`folded_ledger`); entries of
any number are charged by `ledger`. Which of the two is meant is for the caller to say.
Epsilons are summed as decimals of nine digits: 0.1 + 0.2 fits into 0.3, and a positive epsilon
costs at least 1e-9. One that is missing or not above zero stops the charge; `ledger_violations`
lists such entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.long_ledger import EPSILON_TYPE, charged_epsilon, long_ledger, ranked


def ledger(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """Admit or skip each entry, however many a dataset has.

    `entries` has (dataset, ord, column, operation, epsilon), `totals` (dataset,
    total_epsilon). The result adds admitted and used_after.
    """
    return long_ledger(entries, totals)


def folded_ledger(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """`ledger` for entries that are known to be the columns of tables: one job, nothing written."""
    entry = F.struct("ord", "column", "operation", charged_epsilon("epsilon").alias("epsilon"))
    per_dataset = entries.groupBy("dataset").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    limits = totals.select("dataset", F.col("total_epsilon").cast(EPSILON_TYPE).alias("total_epsilon"))
    joined = per_dataset.join(limits, "dataset", "left").withColumn("total_epsilon", no_total_is_zero("total_epsilon"))
    spent = F.aggregate(
        "entries",
        F.struct(F.lit(0).cast(EPSILON_TYPE).alias("used"), _no_decisions().alias("decisions")),
        lambda state, e: _decide(state, e, F.col("total_epsilon")),
    )
    decisions = joined.select("dataset", "total_epsilon", "entries", spent["decisions"].alias("decisions"))
    rows = decisions.select(
        "dataset", "total_epsilon", F.inline(F.arrays_zip("entries", "decisions"))
    )
    return rows.select(
        "dataset",
        "entries.ord",
        "entries.column",
        "entries.operation",
        F.col("entries.epsilon").cast("double").alias("epsilon"),
        F.col("decisions.admitted").alias("admitted"),
        F.col("decisions.used_after").cast("double").alias("used_after"),
        F.col("total_epsilon").cast("double").alias("total_epsilon"),
    )


def no_total_is_zero(total: str) -> Column:
    """A dataset without a total may spend nothing; its entries are all skipped."""
    return F.coalesce(total, F.lit(0)).cast(EPSILON_TYPE)


def _no_decisions() -> Column:
    return F.array().cast(f"array<struct<admitted:boolean,used_after:{EPSILON_TYPE}>>")


def _decide(state: Column, e: Column, total: Column) -> Column:
    after = state["used"] + e["epsilon"]
    admitted = after <= total
    used = F.when(admitted, after).otherwise(state["used"]).cast(EPSILON_TYPE)
    decision = F.struct(admitted.alias("admitted"), used.alias("used_after"))
    return F.struct(used.alias("used"), F.array_append(state["decisions"], decision).alias("decisions"))


def ledger_violations(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """Totals and entries that are not above zero; such a ledger must not be charged."""
    bad_totals = totals.where(~F.coalesce(F.col("total_epsilon") > 0, F.lit(False))).select(
        "dataset", F.lit(None).cast("string").alias("column"), F.lit("total_not_positive").alias("violation")
    )
    bad_entries = entries.where(~F.coalesce(F.col("epsilon") > 0, F.lit(False))).select(
        "dataset", "column", F.lit("epsilon_not_positive").alias("violation")
    )
    return bad_totals.unionByName(bad_entries)


def budget_report(charged: DataFrame) -> DataFrame:
    """One row per dataset: total, used, remaining and utilisation."""
    admitted = F.col("admitted")
    used = F.coalesce(
        F.sum(F.when(admitted, F.col("epsilon").cast(EPSILON_TYPE))), F.lit(0).cast(EPSILON_TYPE)
    ).cast("double")
    return (
        charged.groupBy("dataset", "total_epsilon")
        .agg(
            used.alias("used_epsilon"),
            F.count_if(admitted).alias("admitted"),
            F.count_if(~admitted).alias("skipped"),
        )
        .withColumn("remaining_epsilon", F.col("total_epsilon") - F.col("used_epsilon"))
        .withColumn(
            "utilization",
            F.coalesce(F.try_divide(F.col("used_epsilon"), F.col("total_epsilon")) * 100.0, F.lit(0.0)),
        )
    )


def can_consume(report: DataFrame, epsilon: Column) -> DataFrame:
    """Whether `epsilon` would still fit into each dataset of a report, without charging it."""
    wanted = F.col("used_epsilon").cast(EPSILON_TYPE) + epsilon.cast(EPSILON_TYPE)
    return report.withColumn("can_consume", wanted <= F.col("total_epsilon").cast(EPSILON_TYPE))


def consumptions(charged: DataFrame) -> DataFrame:
    """The admitted entries of each dataset, numbered in order of charging. No task holds a whole dataset."""
    admitted = charged.where("admitted").select("dataset", "ord", "column", "operation", "epsilon")
    return ranked(admitted, ["ord", "column", "operation"]).select(
        "dataset", (F.col("idx") + 1).alias("number"), "column", "operation", "epsilon"
    )
