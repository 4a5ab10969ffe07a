"""Greedy admission for a dataset with more entries than one task should hold.

While at least h of the budget is left, every entry of at most h fits. Let h be the largest
power of two that is left. Then all small entries (up to h) are admitted until the first
point where either less than h is left, or a larger entry fits and is admitted, after which
less than h is left as well. Both points follow from prefix sums of the small entries, so a
round decides everything up to that point, and h at least halves from round to round: some
sixty rounds at the very most, whatever the number of entries.

Prefix sums are taken in chunks of the entry order: sums per chunk, a running sum over the
chunks, and a running sum inside each, so no task holds a whole dataset. The numbered
entries and the state after each round are written tables, which the loss of an executor
cannot change; the decisions follow from all states in one last pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.session import table_store

EPSILON_TYPE = "decimal(18,9)"
NANO = 1_000_000_000
ORDER = ["ord", "column", "operation", "nano"]


def long_ledger(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """(dataset, ord, column, operation, epsilon, admitted, used_after, total_epsilon)."""
    stored = table_store(entries.sparkSession)
    ordered = entries.select("dataset", "ord", "column", "operation", _nano(charged_epsilon("epsilon")).alias("nano"))
    rows = ranked(ordered, ORDER, stored)
    chunks = stored(
        rows.groupBy("dataset", "chunk").agg(F.min("idx").alias("first"), F.max("idx").alias("last")), "chunks"
    )
    limits = totals.select("dataset", _nano(F.col("total_epsilon").cast(EPSILON_TYPE)).alias("total"))
    state = stored(
        chunks.select("dataset").distinct().join(limits, "dataset", "left")
        .withColumn("total", F.coalesce("total", F.lit(0).cast("bigint")))  # no total, no budget
        .select(
            "dataset", F.lit(0).alias("round"), "total", F.col("total").alias("left"),
            F.lit(-1).cast("bigint").alias("position"),
        ),
        "state_0",
    )
    states = []
    while not state.isEmpty():
        states.append(state)
        measured = _measure(rows, chunks, state.withColumn("until", F.lit(None).cast("bigint")))
        ends = measured.where("stops").groupBy("dataset").agg(
            F.min("idx").alias("end"), F.min_by("consumed", "idx").alias("spent")
        )
        state = stored(
            state.join(ends, "dataset").select(
                "dataset", (F.col("round") + 1).alias("round"), "total",
                (F.col("left") - F.col("spent")).alias("left"), F.col("end").alias("position"),
            ),
            f"state_{len(states)}",
        )
    every = states[0] if states else state  # no entries, no rounds
    for one in states[1:]:
        every = every.unionByName(one)
    following = Window.partitionBy("dataset").orderBy("round")  # one row per round
    spans = every.withColumn("until", F.lead("position").over(following))
    final = _measure(rows, chunks, spans)
    at_end = F.coalesce(F.col("idx") == F.col("until"), F.lit(False))
    used = F.col("total") - F.col("left") + F.when(at_end, F.col("consumed")).otherwise(F.col("running"))

    def back(c: Column) -> Column:
        return c.cast("double") / NANO

    return final.select(
        "dataset", "ord", "column", "operation", back(F.col("nano")).alias("epsilon"),
        (F.col("small") | at_end).alias("admitted"), back(used).alias("used_after"),
        back(F.col("total")).alias("total_epsilon"),
    )


def charged_epsilon(column: str) -> Column:
    """What an entry costs: nine digits, at least 1e-9. The charge stops at what is missing or not above zero."""
    e = F.col(column).cast("double")
    cost = F.greatest(F.col(column).cast(EPSILON_TYPE), F.lit(1 / NANO).cast(EPSILON_TYPE)).cast(EPSILON_TYPE)
    refused = F.raise_error(F.lit("epsilon must be above zero; see ledger_violations")).cast(EPSILON_TYPE)
    return F.when((e > 0) & ~F.isnan(e), cost).otherwise(refused)


def _nano(amount: Column) -> Column:
    return F.round(amount * NANO).cast("bigint")


def ranked(df: DataFrame, order: list[str], stored=None) -> DataFrame:
    """The rows with their chunk and their position (idx, from 0) in the order of their dataset.

    The table is cut into chunks by range and written, so that positions stay as they are after a lost task.
    """
    stored = stored or table_store(df.sparkSession)
    placed = df.repartitionByRange("dataset", *order).withColumn("chunk", F.spark_partition_id())
    rows = stored(placed, "placed")
    counts = rows.groupBy("dataset", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("dataset").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("dataset", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("dataset", "chunk").orderBy(*order)
    numbered = rows.withColumn("place", F.row_number().over(inside)).join(offsets, ["dataset", "chunk"])
    return stored(
        numbered.select("dataset", "chunk", *[c for c in df.columns if c != "dataset"],
                        (F.col("offset") + F.col("place") - 1).alias("idx")),
        "numbered",
    )


def _measure(rows: DataFrame, chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """The entries of each round with the running sum of the small ones, and where it may end.

    `spans` has (dataset, round, total, left, position, until): a round holds the entries
    after `position`, up to `until` where that is known. It reaches its entries by chunk, so
    that those of one dataset need not meet in one task.
    """
    reach = (F.col("last") > F.col("position")) & (F.col("until").isNull() | (F.col("first") <= F.col("until")))
    by_chunk = chunks.join(spans, "dataset").where(reach).drop("first", "last")
    inside = (F.col("idx") > F.col("position")) & (F.col("until").isNull() | (F.col("idx") <= F.col("until")))
    # the largest power of two that is left; nothing is small once nothing is left
    power = F.expr("shiftleft(cast(1 as bigint), length(bin(left)) - 1)")
    open_rows = (
        rows.join(by_chunk, ["dataset", "chunk"])
        .where(inside)
        .withColumn("power", power)
        .withColumn("small", (F.col("nano") <= F.col("power")) & (F.col("left") >= F.col("power")))
    )
    part = F.when(F.col("small"), F.col("nano")).otherwise(F.lit(0))
    keys = ["dataset", "round", "chunk"]
    sums = open_rows.groupBy(*keys).agg(F.sum(part).alias("chunk_sum"))
    before = Window.partitionBy("dataset", "round").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*keys, F.coalesce(F.sum("chunk_sum").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    summed = (
        open_rows.withColumn("inner", F.sum(part).over(within))
        .join(bases, keys)
        .withColumn("running", F.col("base") + F.col("inner"))
    )
    left = F.col("left") - F.col("running")
    stops = F.when(F.col("small"), left < F.col("power")).otherwise(F.col("nano") <= left)
    consumed = F.col("running") + F.when(F.col("small"), F.lit(0)).otherwise(F.col("nano"))
    return summed.withColumn("stops", stops).withColumn("consumed", consumed)
