"""Long form of a table: one row per cell, grouped to one row per distinct value.

The unpivot is an Expand inside whole-stage codegen. Grouping by (column, value) first
combines on the map side, so a value that fills a third of the table shuffles as one row
per task, and nothing downstream sees more than the distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import values as V


def unpivot_text(df: DataFrame, columns: Sequence[str], value: str = "value", trim: bool = False) -> DataFrame:
    """(column, value) with every value as text; trimmed, a blank text is NULL."""
    texts = []
    for c in columns:
        text = F.col(c).cast("string")
        if trim and V.is_text(df.schema[c].dataType):
            text = F.nullif(F.trim(text), F.lit(""))
        texts.append(text.alias(c))
    return df.select(texts).unpivot([], list(columns), "column", value)


def unpivot_numbers(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """(ids, column, value) with every value as a finite double or NULL."""
    narrow = df.select(
        *ids, *[V.to_number(F.col(c), df.schema[c].dataType).alias(c) for c in columns]
    )
    return narrow.unpivot(list(ids), list(columns), "column", "value")


def value_counts(df: DataFrame, columns: Sequence[str], trim: bool = False) -> DataFrame:
    """(column, value, n): how often each text occurs in each column; NULL is a value."""
    cells = unpivot_text(df, columns, trim=trim)
    return cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def column_position(columns: Sequence[str]) -> Column:
    """Header position of the name in `column`."""
    names = F.array(*[F.lit(c) for c in columns])
    return (F.array_position(names, F.col("column")) - F.lit(1)).cast("int")


def one_row(*frames: DataFrame) -> DataFrame:
    """Put single-row reports side by side without a join."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def stack_rows(df: DataFrame, names: Sequence[str], fields: dict[str, dict[str, str]]) -> DataFrame:
    """Turn one wide aggregate row into one row per name.

    `fields` maps an output field to the aggregate column that holds it for each name.
    """
    rows = []
    for i, name in enumerate(names):
        text = name.replace("\\", "\\\\").replace("'", "\\'")
        parts = "".join(f", '{field}', `{source[name]}`" for field, source in fields.items())
        rows.append(f"named_struct('column', '{text}', 'ord', {i}{parts})")
    return df.selectExpr(f"inline(array({', '.join(rows)}))")
