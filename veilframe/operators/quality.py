"""Data quality: structure, types, ranges, missing cells, duplicates and the score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import values as V
from veilframe.functions.rng import row_key
from veilframe.operators.cells import one_row, stack_rows, unpivot_numbers
from veilframe.operators.profile import first_rows

EXTREME_VALUE = 1e10
MAX_DETAILS = 20
TEXT_CLASSES = ("boolean", "numeric", "string")


def number_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    return [c for c in (columns or df.columns) if V.is_number(df.schema[c].dataType)]


def type_mix(
    df: DataFrame,
    key: Sequence[str],
    columns: Sequence[str] | None = None,
    sample_rows: int | None = None,
) -> DataFrame:
    """Text columns whose values are not all of the class that the first value has.

    The classes are numbers, boolean words and other text; blank and null values have none.
    Other columns have a declared type. Every row counts unless `sample_rows` is given. The first
    class comes from an aggregate over the key, not from a sort.
    """
    columns = [c for c in (columns or df.columns) if V.is_text(df.schema[c].dataType)]
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, ord int, expected_class string, differing bigint"
        )
    rows = df if sample_rows is None else first_rows(df, key, sample_rows)
    wide = rows.agg(*[measure.alias(name) for name, measure in _mix_measures(df, key, columns).items()])
    fields = {kind: {c: f"{kind}_{i}" for i, c in enumerate(columns)} for kind in ("first", *TEXT_CLASSES)}
    long = stack_rows(wide, columns, fields)
    return long.select("column", "ord", F.col("first").alias("expected_class"), _differing("").alias("differing")).where(
        "differing > 0"
    )


def _mix_measures(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> dict[str, Column]:
    """Aggregates of each text column: the class of its first value, and how many values each class has."""
    ordered, measures = F.struct(*key), {}
    for i, c in enumerate(columns):
        kind = _text_class(df, c)
        measures[f"first_{i}"] = F.min_by(kind, F.when(kind.isNotNull(), ordered))
        for name in TEXT_CLASSES:
            measures[f"{name}_{i}"] = F.count_if(kind == name)
    return measures


def _differing(suffix: str) -> Column:
    """Values of another class than the first one."""
    counts = [F.when(F.col(f"first{suffix}") != name, F.col(f"{name}{suffix}")).otherwise(F.lit(0)) for name in TEXT_CLASSES]
    return F.coalesce(F.when(F.col(f"first{suffix}").isNotNull(), sum(counts[1:], counts[0])), F.lit(0)).cast("bigint")


def _text_class(df: DataFrame, c: str) -> Column:
    kind = V.value_class(F.col(c), df.schema[c].dataType)
    return F.when(V.is_number_text(F.col(c)), F.lit("numeric")).when(kind != "null", kind)


def mixed_cells(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """(row_key, column) of every text cell that is not of the class of its column's first value."""
    columns = [c for c in (columns or df.columns) if V.is_text(df.schema[c].dataType)]
    expected = type_mix(df, key, columns).select(F.col("column").alias("name"), "expected_class")
    if not columns:
        return expected.select(F.lit("").alias("row_key"), F.col("name").alias("column"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _text_class(df, c).alias("kind")) for c in columns])
    rows = df.select(row_key(key).alias("row_key"), F.inline(cells)).where("kind IS NOT NULL")
    # one row per mixed column: as wide as the schema
    met = rows.join(F.broadcast(expected), (F.col("column") == F.col("name")) & (F.col("kind") != F.col("expected_class")))
    return met.select("row_key", "column")


def extreme_values(
    df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, limit: float = EXTREME_VALUE
) -> DataFrame:
    """(row_key, column, value) of every number beyond +-limit."""
    wanted = number_columns(df, columns)
    keyed = df.select(row_key(key).alias("row_key"), *wanted)
    return unpivot_numbers(keyed, wanted, ["row_key"]).where(F.abs("value") > limit)


def missing_counts(
    df: DataFrame, columns: Sequence[str] | None = None, extra: Sequence[Column] = ()
) -> DataFrame:
    """One wide row: `rows` and the missing cells of each column as `missing_<position>`.

    `extra` aggregates share the pass.
    """
    columns = list(columns or df.columns)
    counts = [
        F.count_if(V.is_missing(F.col(c), df.schema[c].dataType)).alias(f"missing_{i}")
        for i, c in enumerate(columns)
    ]
    return df.agg(F.count(F.lit(1)).alias("rows"), *counts, *extra)


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing cells per column and their share of the rows."""
    columns = list(columns or df.columns)
    fields = {
        "missing": {c: f"missing_{i}" for i, c in enumerate(columns)},
        "rows": {c: "rows" for c in columns},
    }
    return stack_rows(missing_counts(df, columns), columns, fields).withColumn(
        "missing_percentage",
        F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("rows")), F.lit(0.0)),
    )


def missing_totals(
    df: DataFrame, columns: Sequence[str] | None = None, extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row: cells, missing cells and the percentage, over the whole table."""
    columns, extra = list(columns or df.columns), dict(extra or {})
    total = sum((F.col(f"missing_{i}") for i in range(len(columns))), F.lit(0).cast("bigint"))
    cells = F.col("rows") * F.lit(len(columns))
    counted = missing_counts(df, columns, [c.alias(name) for name, c in extra.items()])
    return counted.select(
        F.col("rows"),
        *extra,
        cells.alias("total_cells"),
        total.alias("total_missing"),
        F.coalesce(F.try_divide(total * 100.0, cells), F.lit(0.0)).alias("missing_percentage"),
    )


def duplicate_report(
    df: DataFrame, columns: Sequence[str] | None = None, digest: bool = False
) -> DataFrame:
    """One row: rows, distinct rows and surplus copies. NULL equals NULL.

    Copies are counted on the map side first, so a row that fills a third of the table
    reaches the shuffle once per task. With `digest` rows are compared by their SHA-256, so
    that long texts are not shuffled.
    """
    names = list(columns or df.columns)
    if digest:
        row = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
        grouped = df.groupBy(F.sha2(row, 256).alias("digest"))
    else:
        grouped = df.groupBy(*names)
    copies = grouped.agg(F.count(F.lit(1)).alias("copies"))
    rows = F.coalesce(F.sum("copies"), F.lit(0))
    unique = F.count(F.lit(1))
    return copies.agg(
        rows.alias("rows"),
        unique.alias("unique_rows"),
        (rows - unique).alias("duplicate_rows"),
        F.coalesce(F.try_divide((rows - unique) * 100.0, rows), F.lit(0.0)).alias("duplicate_percentage"),
    )


def quality_score(critical: Column, errors: Column, warnings: Column) -> Column:
    """100 less a penalty per class of issue, never below 0."""
    penalty = (
        F.when(critical > 0, F.lit(50)).otherwise(F.lit(0))
        + F.least(errors, F.lit(3)) * 20
        + F.least(warnings, F.lit(10)) * 5
    )
    return F.greatest(F.lit(100) - penalty, F.lit(0)).cast("int")


def assess(score: Column) -> Column:
    return (
        F.when(score >= 90, "excellent").when(score >= 80, "good").when(score >= 70, "fair")
        .when(score >= 60, "poor").otherwise("critical")
    )


def issue_scores(issues: DataFrame, by: Sequence[str]) -> DataFrame:
    """Score of each group of an issue table (`by`..., severity)."""
    counted = issues.groupBy(*by).agg(
        *[F.count_if(F.col("severity") == s).alias(n) for s, n in
          (("critical", "critical"), ("error", "errors"), ("warning", "warnings"))]
    )
    score = quality_score(F.col("critical"), F.col("errors"), F.col("warnings"))
    return counted.withColumn("quality_score", score).withColumn(
        "quality_assessment", assess(F.col("quality_score"))
    )


def issues(
    df: DataFrame,
    key: Sequence[str],
    structure: DataFrame | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Issue table (severity, check, row_key, column, value).

    `structure` is the ragged-row report of a text source; a typed table has none.
    """
    extreme = extreme_values(df, key, columns).select(
        F.lit("warning").alias("severity"),
        F.lit("extreme_value").alias("check"),
        "row_key",
        "column",
        "value",
    )
    mixed = mixed_cells(df, key, columns).select(
        F.lit("warning").alias("severity"), F.lit("type_mix").alias("check"), "row_key", "column"
    )
    out = extreme.unionByName(mixed, allowMissingColumns=True)
    empty = df.agg(F.count(F.lit(1)).alias("rows")).where("rows = 0").select(
        F.lit("critical").alias("severity"), F.lit("empty_dataset").alias("check")
    )
    out = out.unionByName(empty, allowMissingColumns=True)
    if structure is not None:
        ragged = structure.select("severity", "check", "row_key")
        out = out.unionByName(ragged, allowMissingColumns=True)
    return out


def issue_details(found: DataFrame) -> DataFrame:
    """The first issues, worst first."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "error", 1).otherwise(2)
    return first_rows(found, [rank, "check", "column", "row_key"], MAX_DETAILS)


def quality_report(
    df: DataFrame,
    key: Sequence[str],
    structure: DataFrame | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row with the score and what it rests on: one aggregate over the cells, one over whole rows."""
    columns = list(columns or df.columns)
    numbers = number_columns(df, columns)
    extremes = sum(
        (F.count_if(F.abs(V.to_number(F.col(c), df.schema[c].dataType)) > EXTREME_VALUE) for c in numbers),
        F.lit(0).cast("bigint"),
    )
    texts = [c for c in columns if V.is_text(df.schema[c].dataType)]
    mixed = sum((_differing(f"_{i}") for i in range(len(texts))), F.lit(0).cast("bigint"))
    cells = missing_totals(df, columns, {"extreme": extremes, **_mix_measures(df, key, texts)})
    parts = [cells.withColumn("mixed", mixed), duplicate_report(df, columns).drop("rows")]
    if structure is not None:
        parts.append(
            structure.agg(
                F.count_if(F.col("severity") == "error").alias("errors"),
                F.count_if(F.col("severity") == "warning").alias("ragged_warnings"),
            )
        )
    wide = one_row(*parts).withColumn("critical", (F.col("rows") == 0).cast("int"))
    errors = F.col("errors") if structure is not None else F.lit(0).cast("bigint")
    ragged = F.col("ragged_warnings") if structure is not None else F.lit(0)
    warnings = F.col("extreme") + F.col("mixed") + ragged
    score = quality_score(F.col("critical"), errors, warnings)
    return wide.select(
        "rows",
        F.lit(len(columns)).alias("columns"),
        "total_cells",
        "critical",
        errors.alias("errors"),
        warnings.alias("warnings"),
        score.alias("quality_score"),
        assess(score).alias("quality_assessment"),
        "total_missing",
        "missing_percentage",
        "unique_rows",
        "duplicate_rows",
        "duplicate_percentage",
    )
