"""A bounded sample of labelled texts, as features on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose key has this remainder are held out: labels are never learned from them.
HELD_OUT = 2


def held_out(key: str) -> Column:
    """Whether crc32 of the key as text leaves 2 when divided by 4; a NULL key is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, limit: int) -> DataFrame:
    """key, text and label (0 or 1) of at most about limit labelled rows outside the held-out part.

    The rows are those of least hash of the key. Labels other than 0 and 1 are left out. The list of keys is
    broadcast: it has at most limit rows.
    """
    chosen = (
        labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("k").isNotNull() & ~held_out("k"))
        .groupBy("k").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("k"), "k").limit(limit)
    )
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), F.col("key") == F.col("k")).select("key", "text", F.col("label").cast("double").alias("label"))
