"""Charging a budget over time: requests arrive as a stream, and a dataset refuses what no longer fits.

A micro-batch is decided by the same exact ledger as a table, against what earlier batches left; so one
dataset may send any number of requests and no task holds them all, which state kept per
dataset inside one operator could not promise. Requests are taken in the order of their batch, within
a batch by `ord`.

The state, what each column of each dataset has spent, is a table below `path` with one snapshot for
each batch. Batch n reads the newest snapshot before n and overwrites its own decisions and snapshot,
so a batch that is replayed, after a failure at any point, charges once. Totals are read anew by each
batch and may be raised between two runs. One stream at a time may write to a path; older snapshots
than the newest two are not read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe.operators.budget import ledger
from veilframe.operators.long_ledger import EPSILON_TYPE

SPENT_SCHEMA = f"dataset string, column string, spent {EPSILON_TYPE}, admitted bigint, skipped bigint"
DECISION_SCHEMA = (
    "dataset string, ord bigint, column string, operation string, epsilon double, admitted boolean, "
    "used_after double, total_epsilon double"
)
Decide = Callable[[DataFrame, DataFrame], DataFrame]


def ledger_stream(
    entries: DataFrame, totals: DataFrame, path: str, checkpoint: str, available_now: bool = False, decide: Decide = ledger
) -> StreamingQuery:
    """Charge a stream of (dataset, ord, column, operation, epsilon) against (dataset, total_epsilon).

    `decide` is `ledger`, or `folded_ledger` where a batch holds few requests of a dataset.
    """
    prepare(entries.sparkSession, path)
    writer = (
        entries.writeStream.foreachBatch(lambda batch, number: charge_batch(batch, number, totals, path, decide))
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def prepare(spark: SparkSession, path: str) -> None:
    """The snapshot before the first batch: nothing is spent."""
    spark.createDataFrame([], SPENT_SCHEMA).write.mode("ignore").parquet(f"{path}/state/batch=-1")


def charge_batch(batch: DataFrame, number: int, totals: DataFrame, path: str, decide: Decide = ledger) -> None:
    """Decide the requests of one batch and write its decisions and its snapshot."""
    if batch.isEmpty():
        return
    spark = batch.sparkSession
    before = _snapshot(spark, path, number)
    used = before.groupBy("dataset").agg(F.sum("spent").cast(EPSILON_TYPE).alias("used"))
    nothing = F.lit(0).cast(EPSILON_TYPE)
    known = totals.select("dataset", F.col("total_epsilon").cast(EPSILON_TYPE).alias("total")).join(used, "dataset", "left")
    known = known.select("dataset", "total", F.coalesce("used", nothing).alias("used"))
    open_ = known.select("dataset", F.greatest(F.col("total") - F.col("used"), nothing).cast(EPSILON_TYPE).alias("total_epsilon"))
    decided = decide(batch.select("dataset", "ord", "column", "operation", "epsilon"), open_)
    decided = decided.drop("total_epsilon").join(known, "dataset", "left").select(
        "dataset", F.col("ord").cast("bigint").alias("ord"), "column", "operation", "epsilon", "admitted",
        (F.coalesce("used", nothing) + F.col("used_after").cast(EPSILON_TYPE)).cast("double").alias("used_after"),
        F.coalesce("total", nothing).cast("double").alias("total_epsilon"),
    )
    here = f"{path}/decisions/batch={number}"
    decided.write.mode("overwrite").parquet(here)
    admitted = F.col("admitted")
    charged = spark.read.schema(DECISION_SCHEMA).parquet(here).select(
        "dataset", "column", F.when(admitted, F.col("epsilon").cast(EPSILON_TYPE)).otherwise(nothing).alias("spent"),
        admitted.cast("bigint").alias("admitted"), (~admitted).cast("bigint").alias("skipped"),
    )
    _summed(before.unionByName(charged), ["dataset", "column"]).write.mode("overwrite").parquet(f"{path}/state/batch={number}")


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """Every decision so far, with the batch it was taken in."""
    return spark.read.schema(DECISION_SCHEMA + ", batch bigint").parquet(f"{path}/decisions")


def spent_by_column(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, column, spent, admitted, skipped) after the last batch."""
    return _snapshot(spark, path, None).withColumn("spent", F.col("spent").cast("double"))


def stream_report(spark: SparkSession, path: str, totals: DataFrame) -> DataFrame:
    """One row per dataset with a total: used, remaining, utilisation and decisions so far."""
    used = _summed(_snapshot(spark, path, None), ["dataset"])
    total = F.col("total_epsilon").cast(EPSILON_TYPE)
    spent = F.coalesce("spent", F.lit(0).cast(EPSILON_TYPE))
    return totals.select("dataset", "total_epsilon").join(used, "dataset", "left").select(
        "dataset", F.col("total_epsilon").cast("double").alias("total_epsilon"), spent.cast("double").alias("used_epsilon"),
        (total - spent).cast("double").alias("remaining_epsilon"),
        F.coalesce("admitted", F.lit(0)).alias("admitted"), F.coalesce("skipped", F.lit(0)).alias("skipped"),
        F.coalesce(F.try_divide(spent.cast("double"), total.cast("double")) * 100.0, F.lit(0.0)).alias("utilization"),
    )


def _snapshot(spark: SparkSession, path: str, number: int | None) -> DataFrame:
    """The newest snapshot, or the newest before batch `number`."""
    states = spark.read.schema(SPENT_SCHEMA + ", batch bigint").parquet(f"{path}/state")
    if number is not None:
        states = states.where(F.col("batch") < number)
    newest = states.agg(F.max("batch")).first()[0]
    return states.where(F.col("batch") == (-1 if newest is None else newest)).drop("batch")


def _summed(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.sum("spent").cast(EPSILON_TYPE).alias("spent"), F.sum("admitted").alias("admitted"), F.sum("skipped").alias("skipped")
    )
