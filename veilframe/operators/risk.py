"""Re-identification risk: uniqueness, k-anonymity, preserved outliers, nearest-neighbour linking."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import values as V
from veilframe.operators import kd_tree
from veilframe.operators.cells import column_position, one_row, unpivot_text, value_counts
from veilframe.operators.profile import first_rows
from veilframe.operators.utility import NOISY
from veilframe.session import table_store

K_THRESHOLD = 5
OUTLIER_THRESHOLD = 2.0
# The linkage attack: points a leaf of the tree holds, how many of them place one cut, and the
# share of the leaves planned that a level must reach, or else another one follows.
LEAF_POINTS = 64
POINTS_PER_CUT = 16
FEW_LEAVES = 8
_SLOTS = 2**62
# Quasi-identifiers looked for where the caller names none.
QUASI_IDENTIFIERS = ["age", "location", "gender", "occupation"]


def uniqueness(df: DataFrame, columns: Sequence[str] | None = None, distinct: str = "exact") -> DataFrame:
    """(column, ord, rows, unique_values, uniqueness): distinct values over rows, NULL being a value."""
    columns = list(columns or df.columns)
    rows, unique = F.col("rows"), F.col("unique_values")
    if distinct == "exact":
        counted = value_counts(df, columns).groupBy("column").agg(
            F.sum("n").alias("rows"), F.count(F.lit(1)).alias("unique_values")
        )
    elif distinct == "approx":
        counted = unpivot_text(df, columns).groupBy("column").agg(
            F.count(F.lit(1)).alias("rows"),
            (F.approx_count_distinct("value") + F.max(F.col("value").isNull().cast("int"))).alias("unique_values"),
        )
    else:
        raise ValueError(f"distinct must be 'exact' or 'approx', got {distinct!r}")
    return counted.select("column", column_position(columns).alias("ord"), "rows", "unique_values",
                          (unique / rows).alias("uniqueness"))


def uniqueness_reduction(paired: DataFrame, columns: Sequence[str], distinct: str = "exact") -> DataFrame:
    """One row: rows, mean uniqueness before and after, and the percentage by which it fell."""
    both = [c for c in columns] + [c + NOISY for c in columns]
    scores = uniqueness(paired, both, distinct)
    noisy = F.col("column").endswith(NOISY)
    totals = scores.agg(
        F.coalesce(F.max("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.avg(F.when(~noisy, F.col("uniqueness"))), F.lit(0.0)).alias("original_uniqueness"),
        F.coalesce(F.avg(F.when(noisy, F.col("uniqueness"))), F.lit(0.0)).alias("noisy_uniqueness"),
    )
    before, after = F.col("original_uniqueness"), F.col("noisy_uniqueness")
    fall = F.coalesce(F.try_divide(before - after, before) * 100.0, F.lit(0.0))
    return totals.withColumn("uniqueness_reduction", F.greatest(fall, F.lit(0.0)))


def k_anonymity(df: DataFrame, quasi_identifiers: Sequence[str], threshold: int = K_THRESHOLD) -> DataFrame:
    """One row: the smallest and largest group of equal quasi-identifiers, and what it means."""
    groups = df.groupBy(*quasi_identifiers).agg(F.count(F.lit(1)).alias("n"))
    sizes = groups.agg(
        F.coalesce(F.min("n"), F.lit(0)).alias("k_estimate"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_frequency"),
        F.count(F.lit(1)).alias("unique_combinations"),
    )
    k = F.col("k_estimate")

    def label(none: str, strong: str, weak: str, open_: str) -> Column:
        return (
            F.when(k == 0, F.lit(none)).when(k >= threshold, F.lit(strong))
            .when(k >= 2, F.lit(weak)).otherwise(F.lit(open_))
        )

    return sizes.select(
        "k_estimate",
        label("UNKNOWN", "ANONYMOUS", "WEAKLY_ANONYMOUS", "NOT_ANONYMOUS").alias("anonymity_level"),
        label("UNKNOWN", "LOW", "MEDIUM", "HIGH").alias("k_risk"),
        "max_frequency",
        "unique_combinations",
    )


def default_quasi_identifiers(columns: Sequence[str]) -> list[str]:
    return [c for c in QUASI_IDENTIFIERS if c in columns]


def outlier_preservation(paired: DataFrame, column: str, threshold: float = OUTLIER_THRESHOLD) -> DataFrame:
    """One row: outliers of the original, and how many are still outliers after the noise.

    Both values are judged by the mean and population deviation of the original.
    """
    o = V.to_number(F.col(column), paired.schema[column].dataType)
    n = V.to_number(F.col(column + NOISY), paired.schema[column + NOISY].dataType)
    pairs = paired.select(o.alias("o"), n.alias("n")).where("o IS NOT NULL AND n IS NOT NULL")
    stats = pairs.agg(F.avg("o").alias("mean"), F.stddev_pop("o").alias("std")).first()
    if stats["std"]:
        def beyond(v: str) -> Column:
            return F.abs(F.col(v) - F.lit(stats["mean"])) / F.lit(stats["std"]) > F.lit(threshold)
        was, still = beyond("o"), beyond("o") & beyond("n")
    else:
        was = still = F.lit(False)
    counted = pairs.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(was).alias("original_outliers"),
        F.count_if(still).alias("preserved_outliers"),
    )
    rate = F.coalesce(F.try_divide(F.col("preserved_outliers"), F.col("original_outliers")), F.lit(0.0))
    risk = (
        F.when(F.col("total_records") < 3, F.lit("UNKNOWN")).when(rate > 0.5, F.lit("HIGH"))
        .when(rate > 0.2, F.lit("MEDIUM")).otherwise(F.lit("LOW"))
    )
    return counted.select(
        F.lit(column).alias("column"), "total_records", "original_outliers", "preserved_outliers",
        rate.alias("preservation_rate"), risk.alias("outlier_risk"),
    )


def linkage_attack(
    paired: DataFrame, columns: Sequence[str], key: Sequence[str], probes: int | None = None
) -> DataFrame:
    """One row: how many released rows are nearest to their own original; with `probes`, of the first so many.

    Values are divided by the largest original of their column, a missing one counts as 0.
    A probe fails as soon as any other original is closer than its own, or as close and earlier in
    `key` order: an existence test inside the ball around the probe whose radius is its own distance.
    Of equal originals only the earliest can matter, so they become one point.

    The probes meet a keyed sample of the points, those that are left a larger one, and the last of
    them every point. A point that many rows share is sampled early, so its probes do not stay. A k-d tree
    over the sample (`kd_tree`) gains a level each round, more where columns of few values allow few cuts, so
    a leaf always holds about as many points; every point is dealt to one leaf. A probe first meets the leaf
    it lies in, which beats most; the others go to the leaves their ball may reach. A ball that holds none of
    m sampled points is expected to hold few of the next sample, and its gaps are counted to where the points
    of a node lie, so it reaches few leaves. Rows of equal keys are told apart by their values; a row without
    a key is never beaten.
    """
    if not columns:
        raise ValueError("the attack needs at least one numeric column")
    dims = range(len(columns))
    o = {c: _filled(paired, c) for c in columns}
    # one key is a plain column, whose minimum a hash aggregate keeps
    order = F.col(key[0]) if len(key) == 1 else F.struct(*key)
    sizes = [F.count(F.lit(1)).alias("rows"), F.count(order).alias("keyed")]
    row = paired.agg(*sizes, *[F.max(F.abs(o[c])).alias(f"max_{i}") for i, c in enumerate(columns)]).first()
    scale = [row[f"max_{i}"] or 1.0 for i in dims]

    stored = table_store(paired.sparkSession)
    x_names, p_names = [f"x{i}" for i in dims], [f"p{i}" for i in dims]
    xs = [(o[c] / F.lit(s)).alias(x) for x, c, s in zip(x_names, columns, scale)]
    ps = [(_filled(paired, c + NOISY) / F.lit(s)).alias(p) for p, c, s in zip(p_names, columns, scale)]
    located = paired.select(order.alias("row"), *xs)
    points = stored(located.groupBy(*x_names).agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies")), "points")
    total = points.count()  # from the footers of the written table
    usual = row["rows"] / max(total, 1)
    chosen = paired if probes is None else first_rows(paired, key, probes)
    asked = row if probes is None else chosen.agg(*sizes).first()
    identity = ["probe", *p_names, "own"]
    left = (
        chosen.select(order.alias("probe"), *xs, *ps).withColumn("own", _squared(len(columns)))
        .select(*identity).where(F.col("probe").isNotNull())
    )
    closer = _closer(len(columns))
    levels: list[DataFrame] = []
    size, leaves = LEAF_POINTS, 1
    for turn in itertools.count(0):
        finished = total <= 2 * size
        size = min(size, total) if finished else size
        sample = points if finished else _sampled(points, x_names, size / total, usual)
        if turn == 0:
            # some LEAF_POINTS points, which go to every task
            left = stored(left.join(F.broadcast(sample), closer, "left_anti"), "probes_0")
        else:
            # a few points per cut are enough to place it
            few = _sampled(points, x_names, POINTS_PER_CUT / LEAF_POINTS * size / total, usual)
            before = 0
            # one level a round, more where columns of few values allow few cuts
            while not levels or leaves * FEW_LEAVES * LEAF_POINTS < size and leaves >= 2 * before and len(levels) < kd_tree.MAX_LEVELS:
                levels.append(stored(kd_tree.split(kd_tree.deal(few, levels, x_names), x_names), f"level_{len(levels)}"))
                leaves, before = kd_tree.leaves(levels[-1]), leaves
            placed = stored(kd_tree.deal(sample.drop("copies"), levels, x_names), f"points_{turn}")
            if not finished:
                left = stored(_unbeaten_at_home(left, placed, levels, p_names), f"home_{turn}")
            within = _boxes(placed, len(levels), x_names, stored, turn)
            left = stored(left.join(_beaten(left, placed, levels, p_names, within), identity, "left_anti"), f"probes_{turn}")
        if finished or left.isEmpty():
            break
        size *= kd_tree.FANOUT
    counts = left.agg(
        F.lit(asked["rows"]).cast("bigint").alias("probes"),
        (F.count(F.lit(1)) + F.lit(asked["rows"] - asked["keyed"])).alias("linked"),
    )
    rate = F.coalesce(F.try_divide(F.col("linked") * 100.0, F.col("probes")), F.lit(0.0))
    return counts.select(
        "probes",
        "linked",
        rate.alias("success_rate"),
        linking_risk(rate).alias("link_risk"),
        F.lit(len(columns)).alias("columns_exploited"),
    )


def _sampled(points: DataFrame, x_names: Sequence[str], share: float, usual: float) -> DataFrame:
    """A keyed sample of about this share of the points, more of those with more copies than usual; the smaller one lies within the larger."""
    if share >= 1:
        return points
    slot = F.pmod(F.xxhash64("row", *x_names), F.lit(_SLOTS))
    return points.where(slot < F.lit(share * _SLOTS) * F.greatest(F.lit(1.0), F.col("copies") / F.lit(usual)))


def _boxes(placed: DataFrame, depth: int, x_names: Sequence[str], stored, turn: int) -> list[DataFrame]:
    """The boxes of the nodes below each level but the last, the first level first."""
    out: list[DataFrame] = []
    for above in range(1, depth):
        up = kd_tree.outer(out[0], len(x_names)) if out else kd_tree.boxes(placed, x_names)
        out.insert(0, stored(up, f"boxes_{turn}_{above}"))
    return out


def _closer(dimensions: int) -> Column:
    """Whether a point is nearer to a probe than its own, or as near and earlier."""
    distance = _squared(dimensions)
    return (distance < F.col("own")) | ((distance == F.col("own")) & (F.col("row") < F.col("probe")))


def _unbeaten_at_home(probes: DataFrame, placed: DataFrame, levels: Sequence[DataFrame], p_names: Sequence[str]) -> DataFrame:
    """The probes that no point of the leaf they lie in beats; no probe is copied."""
    home = kd_tree.deal(probes, levels, p_names)
    cell = placed.withColumnRenamed("leaf", "cell")
    return home.join(cell, (F.col("leaf") == F.col("cell")) & _closer(len(p_names)), "left_anti").drop("leaf")


def _beaten(
    probes: DataFrame, placed: DataFrame, levels: Sequence[DataFrame], p_names: Sequence[str], within: Sequence[DataFrame]
) -> DataFrame:
    """The probes whose ball holds a point that is nearer than their own, or as near and earlier."""
    radius = F.least(F.sqrt("own") * (1 + 1e-9) + 1e-12, F.lit(1e150))  # a margin far above rounding
    balls = kd_tree.reach(probes.withColumn("radius", radius), levels, p_names, "radius", within)
    cell = placed.withColumnRenamed("leaf", "cell")
    # a semi join leaves a leaf at the first point that beats the probe
    return balls.join(cell, (F.col("leaf") == F.col("cell")) & _closer(len(p_names)), "left_semi").select(probes.columns)


def _filled(df: DataFrame, column: str) -> Column:
    return F.coalesce(V.to_number(F.col(column), df.schema[column].dataType), F.lit(0.0))


def _squared(dimensions: int) -> Column:
    terms = [(F.col(f"x{i}") - F.col(f"p{i}")) * (F.col(f"x{i}") - F.col(f"p{i}")) for i in range(dimensions)]
    return sum(terms[1:], terms[0])


def linking_risk(rate: Column) -> Column:
    return F.when(rate > 40, F.lit("HIGH")).when(rate > 15, F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def risk_report(
    paired: DataFrame,
    columns: Sequence[str],
    numeric: Sequence[str],
    key: Sequence[str],
    quasi_identifiers: Sequence[str] | None = None,
    probes: int | None = None,
    distinct: str = "exact",
) -> DataFrame:
    """One row with the three measures, their score and the overall category; `probes` as in `linkage_attack`."""
    named = quasi_identifiers if quasi_identifiers is not None else QUASI_IDENTIFIERS
    qi = [c for c in named if c in columns]
    parts = [uniqueness_reduction(paired, columns, distinct)]
    if qi:
        parts.append(k_anonymity(paired, [c + NOISY for c in qi]))
    if numeric:
        parts.append(linkage_attack(paired, numeric, key, probes))
    wide = one_row(*parts)
    if not qi:
        wide = wide.withColumn("k_estimate", F.lit(0).cast("bigint")).withColumn("k_risk", F.lit("UNKNOWN"))
        wide = wide.withColumn("anonymity_level", F.lit("UNKNOWN"))
    if not numeric:
        wide = wide.withColumn("success_rate", F.lit(0.0)).withColumn("link_risk", F.lit("LOW"))
        wide = wide.withColumn("probes", F.lit(0).cast("bigint"))
    score = (
        F.when(F.col("link_risk") == "HIGH", 4).when(F.col("link_risk") == "MEDIUM", 2).otherwise(0)
        + F.when((F.col("k_risk") == "HIGH") & (F.col("rows") > 100), 2)
        .when(F.col("k_risk").isin("HIGH", "MEDIUM"), 1).otherwise(0)
        + F.when(F.col("uniqueness_reduction") < 5, 1).otherwise(0)
    )
    overall = F.when(score >= 6, F.lit("CRITICAL")).when(score >= 3, F.lit("MODERATE")).otherwise(F.lit("LOW"))
    return wide.select(
        "rows", "uniqueness_reduction", "probes", "success_rate", "link_risk", "k_estimate", "anonymity_level", "k_risk",
        score.alias("risk_score"), overall.alias("overall_risk"), linkage_label(overall).alias("linkage_label"),
    )


def linkage_label(overall: Column) -> Column:
    return F.when(overall == "LOW", F.lit("Safe")).when(overall == "MODERATE", F.lit("Protected")).otherwise(
        F.lit("Exposed")
    )
