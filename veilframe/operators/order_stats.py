"""Exact order statistics (the k-th smallest value) of many columns at once.

`percentile` would gather a column in one task, and may interpolate. Here the ranks are narrowed by
histograms at any size: each pass counts the rows of the current intervals in equal bins, which shuffles at most
bins x intervals rows per task, and keeps the one bin that holds the rank. The observed
minimum and maximum of that bin are the next interval, and the search ends when they meet.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import values as V

BINS = 1024


def order_statistics(
    df: DataFrame,
    ranks: Mapping[str, Sequence[int]],
    bounds: Mapping[str, tuple[int, float, float]],
) -> dict[str, list[float]]:
    """Values at zero-based `ranks` per column, over the column's finite numbers.

    `bounds` holds (count, min, max) of each column, which callers have from their statistics.
    """
    numbers = df.select([V.to_number(F.col(c), df.schema[c].dataType).alias(c) for c in ranks])
    for c, wanted in ranks.items():
        for k in wanted:
            if not 0 <= k < bounds[c][0]:
                raise ValueError(f"rank {k} is outside the {bounds[c][0]} values of {c}")
    out: dict[str, list[float]] = {c: [] for c in ranks}
    wanted = {c: r for c, r in ranks.items() if r}
    if wanted:
        out.update(_by_histogram(numbers, wanted, bounds))
    return out


def _by_histogram(numbers, ranks, bounds) -> dict[str, list[float]]:
    # target (column, rank) -> (low, high, rows below low)
    open_targets = {}
    done: dict[tuple[str, int], float] = {}
    for c, wanted in ranks.items():
        _, low, high = bounds[c]
        for k in set(wanted):
            if low == high:
                done[c, k] = low
            else:
                open_targets[c, k] = (low, high, 0)
    while open_targets:
        intervals = sorted({(c, lo, hi) for (c, _), (lo, hi, _) in open_targets.items()})
        histograms = _histograms(numbers, intervals)
        following = {}
        for (c, k), (low, high, below) in open_targets.items():
            for n, bin_low, bin_high in histograms[c, low, high]:
                if k < below + n:
                    if bin_low == bin_high:
                        done[c, k] = bin_low
                    else:
                        following[c, k] = (bin_low, bin_high, below)
                    break
                below += n
        open_targets = following
    return {c: [done[c, k] for k in wanted] for c, wanted in ranks.items()}


def _histograms(numbers: DataFrame, intervals) -> dict[tuple, list[tuple[int, float, float]]]:
    cells, wanted = [], F.lit(False)
    for i, (c, low, high) in enumerate(intervals):
        v = F.col(c)
        inside = v.between(F.lit(low), F.lit(high))
        wanted = wanted | inside
        # both halves are taken on their own, so that a very wide interval cannot overflow
        width = high / 2 - low / 2
        if width < 1e-300:  # neighbouring tiny numbers cannot be halved: scaled up they can
            scale = 2.0**1000
            position = (v * scale - F.lit(low * scale)) / F.lit(high * scale - low * scale)
        else:
            position = (v / 2 - F.lit(low / 2)) / F.lit(width)
        slot = F.least(F.floor(position * F.lit(float(BINS))), F.lit(BINS - 1)).cast("int")
        cells += [F.lit(i), F.when(inside, slot), v]
    counted = (
        numbers.where(wanted)
        .select(F.stack(F.lit(len(intervals)), *cells).alias("interval", "slot", "v"))
        .where("slot IS NOT NULL")
        .groupBy("interval", "slot")
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    )
    out: dict[tuple, list[tuple[int, float, float]]] = {interval: [] for interval in intervals}
    for r in sorted(counted.collect(), key=lambda r: (r["interval"], r["slot"])):
        out[intervals[r["interval"]]].append((r["n"], r["low"], r["high"]))
    return out
