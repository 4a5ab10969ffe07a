"""Connected components of a table of links, in rounds of joins; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) of every node that has a link to another one.

    Large and small stars in turn (Kiveris et al., 2014): each node ties its larger neighbours to the smallest node it knows,
    then its smaller ones, until nothing changes; the number of rounds grows with the logarithm of the longest chain.
    A node with very many links is one key of a join. The least neighbours are written before each join, so that both its sides are plain
    scans below their shuffles: only then does Spark split a skewed key. Their aggregation is combined before its shuffle.
    """
    now = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "links")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        tied = large.join(least, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        small = written(small.where("u <> v").distinct(), "links")
        if _mark(small) == _mark(now):
            return small.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                small.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        now = small


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and sums of two hashes of them."""
    hashes = [F.sum(F.xxhash64("u", "v", F.lit(k)).cast("decimal(38,0)")) for k in (1, 2)]
    return tuple(edges.agg(F.count("*"), *hashes).first())
