"""Noise mechanisms, one query each."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from veilframe.functions import discrete as D
from veilframe.functions import exact as E
from veilframe.functions import mechanisms as M
from veilframe.functions import noise as N
from veilframe.functions import values as V
from veilframe.queries.base import (
    boolean_rr_sql, categorical_rr_sql, gaussian_sql, hash_sql, keyed, laplace_sql, partial_mask_sql,
    SECRET, query, r, rnd, table, u_sql,
)

GAPPY_BALANCE = "case when c_custkey % 7 = 0 then null else c_acctbal end"
SIGMA = math.sqrt(2.0 * math.log(1.25 / 1e-5)) / 0.5
AGE = "cast(18 + c_custkey % 60 as double)"


def _gappy(spark, sf_dir):
    """Customers of whom every seventh has no balance."""
    return table(spark, sf_dir, "customer").withColumn("c_acctbal", F.expr(GAPPY_BALANCE))


def _balance_sql(expression: str) -> str:
    return f"select c_custkey, {expression} as noisy from (select c_custkey, {GAPPY_BALANCE} as c_acctbal from customer)"


@query("laplace", _balance_sql(r(f"c_acctbal + {laplace_sql(u_sql('c_acctbal', 'c_custkey'), '1e1 / 5e-1')}")))
def laplace(spark, sf_dir):
    u = keyed("c_custkey").uniform("c_acctbal")
    return _gappy(spark, sf_dir).select("c_custkey", rnd(N.laplace(F.col("c_acctbal"), u, 10.0, 0.5)).alias("noisy"))


@query(
    "bounded_laplace",
    _balance_sql(
        "case when c_acctbal is not null then "
        + r(f"least(greatest(c_acctbal + {laplace_sql(u_sql('c_acctbal', 'c_custkey'), '1e3 / 5e-1')}, 0e0), 9e3)")
        + " end"
    ),
)
def bounded_laplace(spark, sf_dir):
    u = keyed("c_custkey").uniform("c_acctbal")
    noisy = N.bounded_laplace(F.col("c_acctbal"), u, 1000.0, 0.5, 0.0, 9000.0)
    return _gappy(spark, sf_dir).select("c_custkey", rnd(noisy).alias("noisy"))


@query(
    "discrete_laplace",
    "select p_partkey, cast(round_even(p_size + " + laplace_sql(u_sql("p_size", "p_partkey"), "1e0 / 3e-1")
    + ", 0) as bigint) as noisy from part",
)
def discrete_laplace(spark, sf_dir):
    u = keyed("p_partkey").uniform("p_size")
    noisy = N.discrete_laplace(F.col("p_size"), u, 1.0, 0.3, integral=True)
    return table(spark, sf_dir, "part").select("p_partkey", noisy.alias("noisy"))


@query(
    "scaled_laplace",
    "select o_orderkey, "
    + r(f"(o_totalprice + {laplace_sql(u_sql('o_totalprice', 'o_orderkey'), '1e3 / 3e-1')}) * 1.1e0", 4)
    + " as noisy from orders",
)
def scaled_laplace(spark, sf_dir):
    u = keyed("o_orderkey").uniform("o_totalprice")
    noisy = N.scaled_laplace(F.col("o_totalprice"), u, 1000.0, 0.3, 1.1)
    return table(spark, sf_dir, "orders").select("o_orderkey", rnd(noisy, 4).alias("noisy"))


@query("gaussian", _balance_sql(r(f"c_acctbal + {gaussian_sql('c_acctbal', 'c_custkey', repr(SIGMA) + 'e0')}")))
def gaussian(spark, sf_dir):
    draws = keyed("c_custkey")
    noisy = N.gaussian(
        F.col("c_acctbal"), draws.uniform("c_acctbal", 0), draws.uniform("c_acctbal", 1), 1.0, 0.5, 1e-5
    )
    return _gappy(spark, sf_dir).select("c_custkey", rnd(noisy).alias("noisy"))


@query(
    "bounded_gaussian",
    _balance_sql(
        "case when c_acctbal is not null then "
        + r(f"least(greatest(c_acctbal + {gaussian_sql('c_acctbal', 'c_custkey', repr(SIGMA * 100) + 'e0')}, 0e0), 9e3)")
        + " end"
    ),
)
def bounded_gaussian(spark, sf_dir):
    draws = keyed("c_custkey")
    noisy = N.bounded_gaussian(
        F.col("c_acctbal"), draws.uniform("c_acctbal", 0), draws.uniform("c_acctbal", 1),
        100.0, 0.5, 1e-5, 0.0, 9000.0,
    )
    return _gappy(spark, sf_dir).select("c_custkey", rnd(noisy).alias("noisy"))


def _mechanism(df, key: str, m: M.Mechanism, digits: int = 6):
    """Key and released column, as a plan would release it."""
    draws = [keyed(key).uniform(m.column, s) for s in range(m.streams)]
    out = M.apply(m, F.col(m.column), df.schema[m.column].dataType, draws)
    if m.method in M.NUMERIC_METHODS and m.method != "discrete_laplace":
        out = rnd(out, digits)
    return df.select(key, out.alias("released"))


@query(
    "age_noise",
    f"select c_custkey, {r(f'''least(greatest(age + {laplace_sql(u_sql('age', 'c_custkey'), '1e0 / 2e-1')}, 0e0), 12e1)''')}"
    f" as released from (select c_custkey, {AGE} as age from customer)",
)
def age_noise(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("age", F.expr(AGE))
    return _mechanism(df, "c_custkey", M.choose("age", "age"))


@query(
    "year_noise",
    "select o_orderkey, "
    + r(f"least(greatest(year(o_orderdate) + {laplace_sql(u_sql('o_year', 'o_orderkey'), '1e0 / 2e-1')}, 19e2), 205e1)")
    + " as released from orders",
)
def year_noise(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("o_year", F.year("o_orderdate"))
    return _mechanism(df, "o_orderkey", M.choose("o_year", "year"))


@query(
    "numeric_noise",
    "with s as (select max(c_acctbal) - min(c_acctbal) as spread, min(c_acctbal) >= 0 as positive from customer) "
    "select c_custkey, " + r(
        "case when positive then greatest(noisy, 0e0) else noisy end"
    ) + " as released from (select c_custkey, positive, c_acctbal + "
    + laplace_sql(u_sql("c_acctbal", "c_custkey"), "least(50e0, spread) / 3e-1") + " as noisy from customer, s)",
)
def numeric_noise(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    s = df.agg((F.max("c_acctbal") - F.min("c_acctbal")).alias("spread"), (F.min("c_acctbal") >= 0).alias("p")).first()
    m = M.choose("c_acctbal", "numeric", sensitivity=50.0, num_range=s["spread"], non_negative=s["p"])
    return _mechanism(df, "c_custkey", m)


@query(
    "monetary_noise",
    "with s as (select max(p_retailprice) - min(p_retailprice) as spread, min(p_retailprice) >= 0 as positive from part) "
    "select p_partkey, " + r(
        "case when positive then greatest(noisy, 0e0) else noisy end", 5
    ) + " as released from (select p_partkey, positive, p_retailprice + "
    + laplace_sql(u_sql("p_retailprice", "p_partkey"), "least(1e3, spread) / 3e-1") + " as noisy from part, s)",
)
def monetary_noise(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    s = df.agg(
        (F.max("p_retailprice") - F.min("p_retailprice")).alias("spread"), (F.min("p_retailprice") >= 0).alias("p")
    ).first()
    m = M.choose("p_retailprice", "monetary", num_range=s["spread"], non_negative=s["p"])
    return _mechanism(df, "p_partkey", m, 5)


@query(
    "count_noise",
    "select p_partkey, greatest(cast(round_even(p_size + " + laplace_sql(u_sql("p_size", "p_partkey"), "1e0 / 1e0")
    + ", 0) as bigint), 0) as released from part",
)
def count_noise(spark, sf_dir):
    return _mechanism(table(spark, sf_dir, "part"), "p_partkey", M.choose("p_size", "count"))


@query(
    "boolean_rr",
    "select doc_id, toxic = 1 as original, "
    + boolean_rr_sql("(toxic = 1)", u_sql("toxic", "doc_id"), "5e-1") + " as released from labels",
)
def boolean_rr(spark, sf_dir):
    df = table(spark, sf_dir, "labels")
    value = V.to_boolean(F.col("toxic"), df.schema["toxic"].dataType)
    noisy = D.boolean_response(value, keyed("doc_id").uniform("toxic"), 0.5)
    return df.select("doc_id", value.alias("original"), noisy.alias("released"))


@query(
    "boolean_tokens",
    "with t as (select o_orderkey, case o_orderkey % 9 when 0 then 'Yes' when 1 then 'no' when 2 then 'TRUE' "
    "when 3 then 'False' when 4 then '1' when 5 then '0' when 6 then 'y' when 7 then ' N ' else 'maybe' end as token "
    "from orders), b as (select *, case when lower(trim(token)) in ('true', '1', 'yes', 'y') then true "
    "when lower(trim(token)) in ('false', '0', 'no', 'n') then false end as value from t) "
    "select o_orderkey, coalesce(cast(" + boolean_rr_sql("value", u_sql("token", "o_orderkey"), "1e0")
    + " as varchar), token) as released from b",
)
def boolean_tokens(spark, sf_dir):
    """Booleans written as words; a cell that says neither keeps its token."""
    token = F.expr(
        "case o_orderkey % 9 when 0 then 'Yes' when 1 then 'no' when 2 then 'TRUE' when 3 then 'False' "
        "when 4 then '1' when 5 then '0' when 6 then 'y' when 7 then ' N ' else 'maybe' end"
    )
    df = table(spark, sf_dir, "orders").select("o_orderkey", token.alias("token"))
    m = M.choose("token", "boolean", epsilon=1.0)
    noisy = M.apply(m, F.col("token"), df.schema["token"].dataType, [keyed("o_orderkey").uniform("token")])
    return df.select("o_orderkey", F.coalesce(noisy.cast("string"), "token").alias("released"))


@query(
    "categorical_rr",
    "with k as (select list_sort(list(distinct c_mktsegment)) as cats from customer) select c_custkey, "
    + categorical_rr_sql("c_mktsegment", "c_mktsegment", "c_custkey", "cats", "5e-1")
    + " as released from customer, k",
)
def categorical_rr(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    cats = [row[0] for row in df.select("c_mktsegment").distinct().limit(16).collect()]
    m = M.choose("c_mktsegment", "string", categories=cats)
    return _mechanism(df, "c_custkey", m)


@query("mask_partial", f"select c_custkey, {partial_mask_sql('c_name')} as released from customer")
def mask_partial(spark, sf_dir):
    return _mechanism(table(spark, sf_dir, "customer"), "c_custkey", M.choose("c_name", "string"))


@query("mask_partial_text", f"select doc_id, md5({partial_mask_sql('text')}) as digest, length(text) as size from documents")
def mask_partial_text(spark, sf_dir):
    """Whole documents masked; the digest keeps the result small."""
    df = table(spark, sf_dir, "documents")
    return df.select(
        "doc_id", F.md5(D.mask(F.col("text"), "partial")).alias("digest"),
        F.char_length("text").cast("bigint").alias("size"),
    )


@query("mask_full", "select c_custkey, '********' as released from customer")
def mask_full(spark, sf_dir):
    m = M.choose("c_name", "string", mask_type="full")
    return _mechanism(table(spark, sf_dir, "customer"), "c_custkey", m)


@query("hash_id", f"select c_custkey, {hash_sql('c_custkey')} as hashed, sha256('salt' || c_custkey) as salted from customer")
def hash_id(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return df.select("c_custkey", D.mask(key, "hash").alias("hashed"), D.mask(key, "hash", "salt").alias("salted"))


def bits_sql(column: str, key: str, stream: int, half: int = 0) -> str:
    return f"cast('0x' || substr(md5('{SECRET}|{column}|e{stream}|' || cast({key} as varchar)), {1 + 15 * half}, 15) as bigint)"


def exact_laplace_sql(column: str, key: str, epsilon: float, units: int) -> str:
    """The digits of two geometric numbers, one by one."""
    return " + ".join(
        f"(cast({bits_sql(column, key, j)} < {t} as bigint) - cast({bits_sql(column, key, j, 1)} < {t} as bigint)) * {1 << j}"
        for j, t in enumerate(E.digit_thresholds(epsilon, units))
    )


def exact_gaussian_sql(column: str, key: str, sigma: float) -> str:
    """How many cumulated probabilities a draw reaches."""
    table = list(E.gaussian_thresholds(sigma))
    return f"len(list_filter({table}, lambda t: t <= {bits_sql(column, key, 0)})) - {len(table) // 2}"


_STEP = E.step_of(10.0, 0.5, False)


@query(
    "laplace_exact",
    f"select c_custkey, case when c_acctbal is not null then (round_even(c_acctbal / {_STEP}, 0) + {exact_laplace_sql('c_acctbal', 'c_custkey', 0.5, E.units_of(10.0, _STEP, False))})"
    f" * {_STEP} end as noisy from (select c_custkey, {GAPPY_BALANCE} as c_acctbal from customer)",
)
def laplace_exact(spark, sf_dir):
    """Balances on a grid; nothing is rounded for the comparison."""
    return _gappy(spark, sf_dir).select("c_custkey", E.laplace(F.col("c_acctbal"), keyed("c_custkey"), "c_acctbal", 10.0, 0.5).alias("noisy"))


@query("laplace_exact_whole", f"select p_partkey, cast(p_size + {exact_laplace_sql('p_size', 'p_partkey', 0.3, 1)} as bigint) as noisy from part")
def laplace_exact_whole(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", E.laplace(F.col("p_size"), keyed("p_partkey"), "p_size", 1.0, 0.3, True).alias("noisy"))


_GRID, _SIGMA_STEPS = E.gaussian_grid(1.0, 0.5, 1e-5, False)


@query(
    "gaussian_exact",
    f"select c_custkey, case when c_acctbal is not null then (round_even(c_acctbal / {_GRID}, 0) + {exact_gaussian_sql('c_acctbal', 'c_custkey', _SIGMA_STEPS)})"
    f" * {_GRID} end as noisy from (select c_custkey, {GAPPY_BALANCE} as c_acctbal from customer)",
)
def gaussian_exact(spark, sf_dir):
    return _gappy(spark, sf_dir).select("c_custkey", E.gaussian(F.col("c_acctbal"), keyed("c_custkey"), "c_acctbal", 1.0, 0.5, 1e-5).alias("noisy"))
