"""Releasing a stream with a plan that was fitted on a batch.

The release is a stateless projection, so it needs neither a watermark nor state, and a
retried micro-batch draws the same keyed noise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veilframe.plans.anonymize import AnonymizationPlan


def release_stream(
    stream: DataFrame, plan: AnonymizationPlan, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Write the released stream as parquet, each input row once."""
    writer = (
        plan.transform(stream)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
