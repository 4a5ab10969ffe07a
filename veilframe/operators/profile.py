"""Column profile and inference of the privacy type of each column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import values as V
from veilframe.operators.cells import column_position, stack_rows, value_counts

SEMANTIC_TYPES = ["age", "year", "monetary", "numeric", "count", "boolean", "id", "string"]
NUMERIC_TYPES = ["age", "year", "monetary", "numeric", "count"]
MAX_CATEGORIES = 15

# Words in a column name that decide the type of a numeric column, tried in
# this order. A word counts only between word boundaries, and "_" is part of a word.
NAME_WORDS = {
    "age": ["age", "birth"],
    "year": ["year"],
    "count": ["count", "number", "num_", "total", "cylinder", "smog", "level", "login", "visit", "click", "score"],
    "monetary": ["price", "cost", "salary", "income", "amount", "purchase", "payment"],
    "id": ["id", "guid", "uid", "identifier", "key", "index", "pk"],
    "numeric": ["size", "consumption", "emission", "co2", "fuel", "percentage", "rate", "ratio", "co2_emissions"],
}
# Parts of a name that let a column of mixed text and numbers count as numeric.
MIXED_NAME_PARTS = ["age", "year", "count", "price", "cost", "size", "consumption", "emission"]


def first_rows(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first n rows in an order, found as a top-k.

    Projections that a caller adds would be pushed below the limit and turn the top-k into a
    sort of the whole table. The coalesce keeps them above it, and moves nothing: a top-k
    has one partition.
    """
    return df.orderBy(*order).limit(n).coalesce(1)


def profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    key: Sequence[str] | None = None,
    sample_rows: int | None = None,
    distinct: str = "exact",
) -> DataFrame:
    """One row per column: value classes, numeric statistics and distinct counts.

    `sample_rows` profiles the first rows in `key` order; by default every row counts.
    `distinct="approx"` estimates the distinct counts and so needs no shuffle of values.
    """
    columns = list(columns or df.columns)
    if distinct not in ("exact", "approx"):
        raise ValueError(f"distinct must be 'exact' or 'approx', got {distinct!r}")
    if sample_rows is not None:
        if not key:
            raise ValueError("sample_rows needs a key that orders the rows")
        df = first_rows(df, key, sample_rows)
    grouped = _exact_groups(df, columns) if distinct == "exact" else _estimated_groups(df, columns)
    total = F.col("total_count")
    return grouped.select(
        "column",
        column_position(columns).alias("ord"),
        "total_count",
        *measures_of(total),
    )


def measures_of(total: Column) -> list[Column]:
    """The shares, numeric statistics and distinct counts of a profile, from counts, limits and sums."""
    return [
        _share("n_numeric", total).alias("numeric_ratio"),
        _share("n_boolean", total).alias("boolean_ratio"),
        _share("n_string", total).alias("string_ratio"),
        "num_min",
        "num_max",
        F.try_divide("num_sum", "n_numeric").alias("num_mean"),
        "is_integer",
        (F.col("num_max") - F.col("num_min")).alias("num_range"),
        F.try_divide("num_unique", "n_numeric").alias("num_unique_ratio"),
        (F.col("num_min") >= 0).alias("all_non_negative"),
        "unique_count",
        _share("unique_count", total).alias("unique_ratio"),
        F.coalesce(F.try_divide("sum_length", "n_string"), F.lit(0.0)).alias("avg_string_length"),
    ]


def class_shares(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, ord, total_count, numeric_ratio, boolean_ratio, string_ratio): the part of `profile` that needs no
    distinct values, as one aggregate that shuffles one row per task."""
    columns = list(columns or df.columns)
    classes = df.select([V.value_class(F.col(c), df.schema[c].dataType).alias(f"class_{i}") for i, c in enumerate(columns)])
    kinds = ("numeric", "boolean", "string")
    wide = classes.agg(*[
        F.count_if(F.col(f"class_{i}") == kind).alias(f"{kind}_{i}") for i in range(len(columns)) for kind in kinds
    ], *[F.count(f"class_{i}").alias(f"total_{i}") for i in range(len(columns))])
    fields = {f: {c: f"{f}_{i}" for i, c in enumerate(columns)} for f in ("total", *kinds)}
    long = stack_rows(wide, columns, fields)
    return long.select(
        "column", "ord", F.col("total").alias("total_count"),
        *[_share(kind, F.col("total")).alias(f"{kind}_ratio") for kind in kinds],
    )


def _exact_groups(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Statistics from the distinct values of each column, so that each is parsed once.

    In a typed column every number has one text; only in a text column may several texts
    be the same number, so only those are counted distinct.
    """
    cells = value_counts(df, columns, trim=True)
    cells = cells.withColumn("class", _class_of_text(df, columns))
    cells = cells.withColumn("number", F.when(F.col("class") == "numeric", _number("value")))

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    number, kind = F.col("number"), F.col("class")
    texts = [c for c in columns if V.is_text(df.schema[c].dataType)]
    from_text = F.col("column").isin(texts) if texts else F.lit(False)
    return cells.groupBy("column").agg(
        rows(F.col("value").isNotNull()).alias("total_count"),
        rows(kind == "numeric").alias("n_numeric"),
        rows(kind == "boolean").alias("n_boolean"),
        rows(kind == "string").alias("n_string"),
        F.min(number).alias("num_min"),
        F.max(number).alias("num_max"),
        F.sum(number * F.col("n")).alias("num_sum"),
        F.bool_and(number == F.rint(number)).alias("is_integer"),
        (F.count(F.when(~from_text, number)) + F.count_distinct(F.when(from_text, number))).alias("num_unique"),
        F.count("value").alias("unique_count"),
        F.sum(F.when(kind == "string", F.char_length("value") * F.col("n"))).alias("sum_length"),
    )


def _estimated_groups(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same statistics from two wide aggregates over typed columns: no value is shuffled.

    The sketches of the distinct counts are kept apart from the plain aggregates, which
    otherwise could not be compiled.
    """
    typed = []
    for i, c in enumerate(columns):
        dtype = df.schema[c].dataType
        kind = V.value_class(F.col(c), dtype)
        typed += [kind.alias(f"class_{i}"), V.to_number(F.col(c), dtype).alias(f"raw_{i}")]
        typed.append((F.trim(F.col(c)) if V.is_text(dtype) else F.col(c)).alias(f"value_{i}"))
    base = df.select(*typed)
    plain = {
        "total_count": "count(class_{i})",
        "n_numeric": "count(case when class_{i} = 'numeric' then 1 end)",
        "n_boolean": "count(case when class_{i} = 'boolean' then 1 end)",
        "n_string": "count(case when class_{i} = 'string' then 1 end)",
        "num_min": "min(case when class_{i} = 'numeric' then raw_{i} end)",
        "num_max": "max(case when class_{i} = 'numeric' then raw_{i} end)",
        "num_sum": "sum(case when class_{i} = 'numeric' then raw_{i} end)",
        "is_integer": "bool_and(case when class_{i} = 'numeric' then raw_{i} = rint(raw_{i}) end)",
        "sum_length": "sum(case when class_{i} = 'string' then char_length(cast(value_{i} as string)) end)",
    }
    sketches = {
        "num_unique": "approx_count_distinct(case when class_{i} = 'numeric' then raw_{i} end)",
        "unique_count": "approx_count_distinct(case when class_{i} is not null then value_{i} end)",
    }
    long = []
    for measures in (plain, sketches):
        wide = base.agg(*[
            F.expr(e.format(i=i)).alias(f"{name}_{i}") for i in range(len(columns)) for name, e in measures.items()
        ])
        fields = {name: {c: f"{name}_{i}" for i, c in enumerate(columns)} for name in measures}
        long.append(stack_rows(wide, columns, fields).drop("ord"))
    return long[0].join(long[1], "column")


def _share(part: str, total: Column) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), total.cast("double")), F.lit(0.0))


def _number(column: str) -> Column:
    return F.translate(F.col(column), "_", "").try_cast("double")


def _class_of_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """Class of `value`, using the declared type of its column where there is one."""
    text = [c for c in columns if V.is_text(df.schema[c].dataType)]
    integral = [c for c in columns if V.is_integral(df.schema[c].dataType)]
    number = [c for c in columns if V.is_number(df.schema[c].dataType) and c not in integral]
    boolean = [c for c in columns if df.schema[c].dataType.typeName() == "boolean"]
    value, name = F.col("value"), F.col("column")
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    if text:
        out = out.when(name.isin(text), V.value_class(value, df.schema[text[0]].dataType))
    if integral:
        bit = value.isin("0", "1")
        out = out.when(name.isin(integral), F.when(bit, F.lit("boolean")).otherwise(F.lit("numeric")))
    if number:
        special = (
            F.when(value == "NaN", F.lit("null"))
            .when(value.isin("Infinity", "-Infinity"), F.lit("string"))
            .otherwise(F.lit("numeric"))
        )
        out = out.when(name.isin(number), special)
    if boolean:
        out = out.when(name.isin(boolean), F.lit("boolean"))
    return out.otherwise(F.lit("string"))


def infer_types(profiles: DataFrame) -> DataFrame:
    """Add `semantic_type` to a profile."""
    name = F.lower("column")
    has_stats = F.col("num_min").isNotNull()
    named = F.lit(False)
    for part in MIXED_NAME_PARTS:
        named = named | name.contains(part)
    numeric = has_stats & (
        (F.col("numeric_ratio") > 0.5)
        | ((F.col("string_ratio") <= 0.5) & (F.col("numeric_ratio") > 0.3) & named)
    )
    inferred = (
        F.when(F.col("boolean_ratio") > 0.8, F.lit("boolean"))
        .when(numeric, _numeric_type(name))
        .otherwise(F.lit("string"))
    )
    return profiles.withColumn("semantic_type", inferred)


def _numeric_type(name: Column) -> Column:
    """Name words first, then what the numbers look like."""
    out = None
    for semantic, words in NAME_WORDS.items():
        hit = name.rlike(r"\b(" + "|".join(words) + r")\b")
        out = F.when(hit, F.lit(semantic)) if out is None else out.when(hit, F.lit(semantic))
    low, high, spread = F.col("num_min"), F.col("num_max"), F.col("num_range")
    unique = F.col("num_unique_ratio")
    small = (low >= 0) & (high <= 150) & (spread < 100)
    age_like = name.contains("age") | name.contains("birth") | ((unique >= 0.5) & (high > 100))
    repeated = (high <= 50) & (unique < 0.3)
    id_like = name.contains("id") | name.contains("pk")
    integer_type = (
        F.when((low >= 1900) & (high <= 2100), F.lit("year"))
        .when(small, F.when(age_like, F.lit("age")).otherwise(F.lit("count")))
        .when(~repeated & id_like, F.lit("id"))
        .otherwise(F.lit("count"))
    )
    money = name.contains("price") | name.contains("cost") | name.contains("amount")
    decimal_type = F.when((spread > 1000) & money, F.lit("monetary")).otherwise(F.lit("numeric"))
    return out.when(F.col("is_integer"), integer_type).otherwise(decimal_type)


def apply_overrides(profiles: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace the inferred type where `overrides` (column, semantic_type) names one."""
    chosen = overrides.select("column", F.col("semantic_type").alias("override_type"))
    return (
        profiles.join(chosen, "column", "left")
        .withColumn("semantic_type", F.coalesce("override_type", "semantic_type"))
        .drop("override_type")
    )


def column_groups(profiles: DataFrame) -> DataFrame:
    """Split of the columns into quantitative and categorical ones."""
    quantitative = F.col("semantic_type").isin(NUMERIC_TYPES)
    return profiles.select(
        "column",
        "semantic_type",
        F.when(quantitative, F.lit("quantitative")).otherwise(F.lit("categorical")).alias("group"),
    )


@dataclass(frozen=True)
class ColumnProfile:
    """Driver copy of one profile row; a table has as many as it has columns."""

    column: str
    semantic_type: str
    unique_count: int
    num_min: float | None = None
    num_max: float | None = None
    num_range: float | None = None
    all_non_negative: bool | None = None
    categories: tuple[str, ...] = ()


def collect_profiles(
    df: DataFrame,
    profiles: DataFrame | None,
    overrides: Mapping[str, str] | None = None,
    columns: Sequence[str] | None = None,
) -> dict[str, ColumnProfile]:
    """Bring a typed profile to the driver and fetch the categories of low-cardinality columns.

    `df` is the table (or sample) the profile was taken from. A column's categories are read
    only if the profile counted few of them.
    """
    overrides = dict(overrides or {})
    unknown = set(overrides.values()) - set(SEMANTIC_TYPES)
    if unknown:
        raise ValueError(f"unknown semantic types in overrides: {sorted(unknown)}")
    rows = {} if profiles is None else {r["column"]: r for r in profiles.collect()}
    types = {c: overrides.get(c, r["semantic_type"]) for c, r in rows.items()}
    # an approximate count may be off by a few percent, hence the margin; the set is exact
    small = [
        c for c, r in rows.items()
        if types[c] == "string" and 1 < r["unique_count"] <= MAX_CATEGORIES + 5
    ]
    categories: dict[str, tuple[str, ...]] = {}
    if small:
        found = (
            value_counts(df, small, trim=True)
            .where("value IS NOT NULL")
            .groupBy("column")
            .agg(F.sort_array(F.collect_set("value")).alias("values"))
        )
        categories = {r["column"]: tuple(r["values"]) for r in found.collect()}
    out = {}
    for c in columns or df.columns:
        if c not in rows:  # not profiled, or an empty table
            out[c] = ColumnProfile(c, overrides.get(c, "string"), 0)
            continue
        r = rows[c]
        out[c] = ColumnProfile(
            c,
            types[c],
            len(categories[c]) if c in categories else r["unique_count"],
            r["num_min"],
            r["num_max"],
            r["num_range"],
            r["all_non_negative"],
            categories.get(c, ()),
        )
    return out
