"""A k-d tree as tables of cuts: every row belongs to one leaf, a ball to the leaves it may reach.

A level of the tree is a table (node, axis, cuts). Leaf `n` of one level is split into
`n * FANOUT` .. `n * FANOUT + FANOUT - 1`, so a leaf is a number and needs no path. Cuts lie halfway between
quantiles of one axis, so leaves hold like many rows wherever the values lie, and a place between two values
belongs to the nearer one; where many values are equal, fewer cuts remain. The axis of a node is the one
with the largest product of spread, without the outermost rows, and number of cuts. Both come from one aggregate with mergeable quantile summaries.
A level is as large as its number of nodes: the first is one row, and whether a later one is broadcast is
left to the optimizer, which knows the size of the written table. A tree has at most MAX_LEVELS levels, so that leaves stay longs.
A node that no row was seen of has no cuts and passes everything to its first child.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FANOUT = 64  # a power of two
# Quantiles are off by at most one in so many rows of their node.
ACCURACY = 1000
MAX_LEVELS = 10


def root(rows: DataFrame) -> DataFrame:
    """The rows in the only leaf of a tree without levels."""
    return rows.withColumn("leaf", F.lit(0).cast("bigint"))


def split(dealt: DataFrame, coordinates: Sequence[str]) -> DataFrame:
    """The next level: (node, axis, cuts) for each leaf of `dealt`."""
    shares = F.array(*[F.lit((i + 0.5) / FANOUT) for i in range(FANOUT)])
    dims = range(len(coordinates))
    quantiles = [F.array_distinct(F.percentile_approx(c, shares, F.lit(ACCURACY))).alias(f"at{i}") for i, c in enumerate(coordinates)]
    nodes = dealt.groupBy(F.col("leaf").alias("node")).agg(*quantiles)
    worth = [
        F.coalesce((F.element_at(f"at{i}", -1) - F.element_at(f"at{i}", 1)) * F.size(f"at{i}"), F.lit(0.0)) for i in dims
    ]
    best = F.greatest(*worth) if len(worth) > 1 else worth[0]
    axis = F.coalesce(*[F.when(w == best, F.lit(i)) for i, w in enumerate(worth)])
    nodes = nodes.withColumn("axis", axis).select("node", "axis", _chosen("axis", [F.col(f"at{i}") for i in dims]).alias("at"))
    halfway = F.transform(F.slice("at", 2, FANOUT), lambda high, i: F.get("at", i) / 2 + high / 2)
    return nodes.select("node", "axis", F.coalesce(halfway, F.array().cast("array<double>")).alias("cuts"))


def leaves(level: DataFrame) -> int:
    """How many leaves a level makes, as far as rows were seen in its nodes."""
    return level.agg(F.coalesce(F.sum(F.size("cuts") + 1), F.lit(0))).first()[0]


def deal(rows: DataFrame, levels: Sequence[DataFrame], coordinates: Sequence[str]) -> DataFrame:
    """Rows with the leaf each belongs to, one row each."""
    dealt = root(rows)
    for level in levels:
        at = _chosen("axis", [F.col(c) for c in coordinates])
        dealt = _met(dealt, level).select(*rows.columns, (F.col("leaf") * FANOUT + _cuts_up_to(at)).alias("leaf"))
    return dealt


def boxes(dealt: DataFrame, coordinates: Sequence[str]) -> DataFrame:
    """(inner, lows and highs) of the nodes right above the leaves: where their rows lie."""
    inner = F.shiftright("leaf", FANOUT.bit_length() - 1)
    return dealt.groupBy(inner.alias("inner")).agg(*_limits([(c, c) for c in coordinates]))


def outer(within: DataFrame, dimensions: int) -> DataFrame:
    """The boxes one level further up."""
    inner = F.shiftright("inner", FANOUT.bit_length() - 1)
    return within.groupBy(inner.alias("inner")).agg(*_limits([(f"low{i}", f"high{i}") for i in range(dimensions)]))


def _limits(ends: Sequence[tuple[str, str]]) -> list[Column]:
    return [e for i, (low, high) in enumerate(ends) for e in (F.min(low).alias(f"low{i}"), F.max(high).alias(f"high{i}"))]


def reach(
    balls: DataFrame, levels: Sequence[DataFrame], centre: Sequence[str], radius: str, within: Sequence[DataFrame] = ()
) -> DataFrame:
    """Balls with every leaf that may hold a row within `radius` of the centre.

    The slabs a ball enters are followed along every axis, and a leaf is left out as soon as the gaps
    to its slabs, one for each axis, are together farther than the radius. `within` has the boxes of the
    nodes below the first levels: a gap is then counted up to the rows of a node and not to its slab,
    which is far wider where a column has few values or columns depend on each other.
    """
    gaps = [f"__gap{i}" for i in range(len(centre))]
    out = root(balls).select("*", *[F.lit(0.0).alias(g) for g in gaps])
    at, r = _chosen("axis", [F.col(c) for c in centre]), F.col(radius)
    for depth, level in enumerate(levels):
        first, last = _cuts_up_to(at - r), _cuts_up_to(at + r)
        entered = _met(out, level).withColumn("child", F.explode(F.sequence(first, F.greatest(first, last))))
        low = F.get("cuts", F.col("child") - 1) - at  # NULL where the slab is open
        high = at - F.get("cuts", F.col("child"))
        gap = F.greatest(F.coalesce(low, F.lit(0.0)), F.coalesce(high, F.lit(0.0)), F.lit(0.0))
        widened = [F.when(F.col("axis") == i, F.greatest(gap, F.col(g))).otherwise(F.col(g)).alias(g) for i, g in enumerate(gaps)]
        out = entered.select(*balls.columns, (F.col("leaf") * FANOUT + F.col("child")).alias("leaf"), *widened)
        out = out.where(_near(gaps, r))
        if depth < len(within):
            # a node without rows has no box; a side that is no number bounds nothing
            sides = [
                F.greatest(F.col(g), F.nanvl(F.col(f"low{i}") - F.col(c), F.lit(0.0)), F.nanvl(F.col(c) - F.col(f"high{i}"), F.lit(0.0))).alias(g)
                for i, (g, c) in enumerate(zip(gaps, centre))
            ]
            out = out.join(within[depth], F.col("leaf") == F.col("inner")).select(*balls.columns, "leaf", *sides).where(_near(gaps, r))
    return out.drop(*gaps)


def _near(gaps: Sequence[str], r: Column) -> Column:
    """Whether the gaps are together within the radius, with a margin far above rounding; NULL and NaN keep the leaf."""
    squares = [F.col(g) * F.col(g) for g in gaps]
    beyond = sum(squares[1:], squares[0]) > r * r * (1 + 1e-9)
    return ~F.coalesce(beyond, F.lit(False)) | F.isnan(r)


def _met(rows: DataFrame, level: DataFrame) -> DataFrame:
    return rows.join(level, rows["leaf"] == level["node"], "left")


def _chosen(axis: str, candidates: Sequence[Column]) -> Column:
    out = F.when(F.col(axis) == 0, candidates[0])
    for i, c in enumerate(candidates[1:], 1):
        out = out.when(F.col(axis) == i, c)
    return out


def _cuts_up_to(value: Column) -> Column:
    """How many cuts are not above the value, by binary search; 0 where there are no cuts."""
    steps = F.array(*[F.lit(FANOUT >> i) for i in range(1, FANOUT.bit_length())])
    return F.aggregate(
        steps, F.lit(0), lambda n, step: n + F.when(F.get("cuts", n + step - 1) <= value, step).otherwise(F.lit(0))
    )
