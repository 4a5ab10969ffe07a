"""Registry of the queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.rng import KeyedNoise
from veilframe.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# A public secret: the checks must be able to repeat the noise.
SECRET = "public-test-secret"


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) under a name, with its SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(column: str) -> KeyedNoise:
    return KeyedNoise(SECRET, column)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded; adding 0 removes the sign of a zero."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        out.append((F.round(c, digits) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else c)
    return df.select(*out)


def rnd(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


# --- the same arithmetic in SQL ---------------------------------------------------------


def r(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0e0)"


def u_sql(column: str, key: str, stream: int | str = 0) -> str:
    block, half = divmod(stream, 2) if isinstance(stream, int) else (stream, 0)
    text = f"'{SECRET}|{column}|{block}|' || cast({key} as varchar)"
    digits = f"substr(md5({text}), {1 + 13 * half}, 13)"
    return f"((cast(cast('0x' || {digits} as bigint) as double) + 5e-1) / 4503599627370496e0)"


def laplace_sql(u: str, scale: str) -> str:
    return f"(-({scale}) * sign({u} - 5e-1) * ln(1e0 - 2e0 * abs({u} - 5e-1)))"


def gaussian_sql(column: str, key: str, sigma: str) -> str:
    u0, u1 = u_sql(column, key, 0), u_sql(column, key, 1)
    return f"(({sigma}) * sqrt(-2e0 * ln({u0})) * cos(2e0 * pi() * {u1}))"


def boolean_rr_sql(value: str, u: str, epsilon: str) -> str:
    return f"case when {u} < exp({epsilon}) / (exp({epsilon}) + 1) then {value} else not {value} end"


def categorical_rr_sql(value: str, column: str, key: str, categories: str, epsilon: str) -> str:
    """`categories` is a sorted list expression."""
    keep = f"exp({epsilon}) / (exp({epsilon}) + len({categories}) - 1)"
    others = f"list_filter({categories}, lambda c: c <> {value})"
    pick = f"cast(floor({u_sql(column, key, 1)} * len({others})) as bigint) + 1"
    return f"case when {u_sql(column, key, 0)} < {keep} then {value} else list_extract({others}, {pick}) end"


def partial_mask_sql(value: str) -> str:
    return (
        f"case when length({value}) <= 4 then repeat('*', length({value})) else "
        f"substr({value}, 1, 2) || repeat('*', length({value}) - 4) || right({value}, 2) end"
    )


def hash_sql(value: str) -> str:
    return f"substr(md5(cast({value} as varchar)), 1, 12)"


def missing_text_sql(c: str) -> str:
    return f"({c} is null or lower(trim({c})) in ('', 'none', 'null', 'nan', 'n/a', 'na'))"
