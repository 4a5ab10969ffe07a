"""How a cell is read: missing, numeric, boolean or text.

Typed columns take a short path: an integer or double column needs no parsing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens that stand for a missing cell in quality checks and imputation.
MISSING_TOKENS = ["", "none", "null", "nan", "n/a", "na"]
# Tokens counted as null while a type is inferred ("na" is not one of them).
NULL_TOKENS = ["", "null", "none", "nan", "n/a"]
# Tokens of class boolean while a type is inferred.
BOOLEAN_TOKENS = ["true", "false", "1", "0", "yes", "no", "y", "n"]
TRUE_TOKENS = ["true", "1", "yes", "y"]
FALSE_TOKENS = ["false", "0", "no", "n"]

# Spark alone would read '12d' as a number; infinities have no use here.
NUMBER_PATTERN = r"^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$"


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_fraction(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def clean(c: Column) -> Column:
    return F.lower(F.trim(c))


def is_missing(c: Column, dtype: T.DataType) -> Column:
    """Missing for quality checks and imputation."""
    if is_text(dtype):
        return c.isNull() | clean(c).isin(MISSING_TOKENS)
    if is_fraction(dtype):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def is_number_text(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(NUMBER_PATTERN), F.lit(False))


def to_number(c: Column, dtype: T.DataType) -> Column:
    """Double, or NULL where the cell is no finite number."""
    if is_text(dtype):
        digits = F.translate(F.trim(c), "_", "")
        return F.when(is_number_text(c), digits.try_cast("double"))
    if is_fraction(dtype):
        v = c.cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)
    if isinstance(dtype, T.BooleanType) or is_number(dtype):
        return c.cast("double")
    return F.lit(None).cast("double")


def to_boolean(c: Column, dtype: T.DataType) -> Column:
    """Boolean, or NULL where the cell says neither."""
    if isinstance(dtype, T.BooleanType):
        return c
    if is_number(dtype):
        return F.when(c == 1, F.lit(True)).when(c == 0, F.lit(False))
    token = clean(c.cast("string"))
    return F.when(token.isin(TRUE_TOKENS), F.lit(True)).when(token.isin(FALSE_TOKENS), F.lit(False))


def value_class(c: Column, dtype: T.DataType) -> Column:
    """`null`, `boolean`, `numeric` or `string`; NULL for a blank cell, which is not counted.

    An integer 0 or 1 is of class boolean, as it is when the table comes from text.
    """
    if is_text(dtype):
        token = clean(c)
        return (
            F.when(c.isNull() | (token == ""), F.lit(None))
            .when(token.isin(NULL_TOKENS), F.lit("null"))
            .when(token.isin(BOOLEAN_TOKENS), F.lit("boolean"))
            .when(is_number_text(c), F.lit("numeric"))
            .otherwise(F.lit("string"))
        )
    present = c.isNotNull()
    if isinstance(dtype, T.BooleanType):
        return F.when(present, F.lit("boolean"))
    if is_integral(dtype):
        return F.when(c.isin(0, 1), F.lit("boolean")).when(present, F.lit("numeric"))
    if is_fraction(dtype):
        return (
            F.when(F.isnan(c), F.lit("null"))
            .when(F.abs(c) == F.lit(float("inf")), F.lit("string"))
            .when(present, F.lit("numeric"))
        )
    if is_number(dtype):
        return F.when(present, F.lit("numeric"))
    return F.when(present, F.lit("string"))
