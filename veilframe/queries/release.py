"""Whole releases: fit a plan on a table, apply it, audit it."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.plans import anonymize as A
from veilframe.plans.ml_compare import compare_models, split_rows
from veilframe.queries.base import (
    SECRET, boolean_rr_sql, categorical_rr_sql, hash_sql, keyed, laplace_sql, partial_mask_sql, query, r, rounded, table,
    u_sql,
)
from veilframe.queries.metrics import LINE_KEY_SQL, risk_sql, summary_sql
from veilframe.session import scratch_dir
from veilframe.streaming.release import release_stream


# The checks must be able to repeat the noise of a release.
RELEASE = "check"


def drawn(column: str) -> str:
    """The name under which a release draws for a column."""
    return f"{RELEASE}/{column}"


def budget_sql(source: str, epsilon: float, columns: int) -> str:
    """Total, column budget and equal share of a dataset, with the size rule."""
    return f"""select total, total - least(1e-1, total * 1e-1) as budget,
        floor((total - least(1e-1, total * 1e-1)) / {columns} * 1e9) / 1e9 as share from (select case when count(*) < 500
        and {epsilon}e0 < 2 then 4e0 else {epsilon}e0 end as total from {source})"""


def _number_sql(c: str, key: str, sensitivity: str, epsilon: str = "share") -> str:
    """Laplace noise, not below zero if the column never is."""
    noisy = f"{c} + {laplace_sql(u_sql(drawn(c), key), f'least({sensitivity}, max_{c} - min_{c}) / {epsilon}')}"
    return f"case when min_{c} >= 0 then greatest({noisy}, 0e0) else {noisy} end"


def _count_sql(c: str, key: str, epsilon: str = "share") -> str:
    return f"greatest(cast(round_even({c} + {laplace_sql(u_sql(drawn(c), key), f'1e0 / {epsilon}')}, 0) as bigint), 0)"


def _stats_sql(source: str, numbers: list[str], categories: list[str]) -> str:
    parts = [f"min({c}) as min_{c}, max({c}) as max_{c}" for c in numbers]
    parts += [f"list_sort(list(distinct {c})) as cats_{c}" for c in categories]
    return f"select {', '.join(parts)} from {source}"


def _category_sql(c: str, key: str, epsilon: str = "share") -> str:
    return categorical_rr_sql(c, drawn(c), key, f"cats_{c}", epsilon)


# --- customers: equal split of the budget ------------------------------------------------

_CUSTOMER_COLUMNS = {
    "c_custkey": hash_sql("c_custkey"),
    "c_name": partial_mask_sql("c_name"),
    "c_nationkey": _count_sql("c_nationkey", "c_custkey"),
    "c_acctbal": _number_sql("c_acctbal", "c_custkey", "1e0"),
    "c_mktsegment": _category_sql("c_mktsegment", "c_custkey"),
}
_CUSTOMER_FROM = (
    f"customer, ({budget_sql('customer', 1, 5)}) b, ({_stats_sql('customer', ['c_acctbal'], ['c_mktsegment'])}) s"
)
_CUSTOMER_SQL = "select " + ", ".join(
    f"{r(e)} as {c}" if c == "c_acctbal" else f"{e} as {c}" for c, e in _CUSTOMER_COLUMNS.items()
) + f" from {_CUSTOMER_FROM}"


def customer_plan(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df, A.fit(df, ["c_custkey"], secret=SECRET, release_id=RELEASE, overrides={"c_custkey": "id"}, adjust_small=True)


@query("anonymize_customer", _CUSTOMER_SQL)
def anonymize_customer(spark, sf_dir):
    df, plan = customer_plan(spark, sf_dir)
    return rounded(plan.transform(df))


@query(
    "exclude_columns",
    _CUSTOMER_SQL.replace(f"{_CUSTOMER_COLUMNS['c_name']} as c_name", "c_name")
    .replace(f"{_CUSTOMER_COLUMNS['c_mktsegment']} as c_mktsegment", "c_mktsegment"),
)
def exclude_columns(spark, sf_dir):
    """Name and segment stay as they are and cost nothing."""
    df = table(spark, sf_dir, "customer")
    plan = A.fit(
        df, ["c_custkey"], secret=SECRET, release_id=RELEASE, overrides={"c_custkey": "id"}, exclude=["c_name", "c_mktsegment"],
        adjust_small=True,
    )
    return rounded(plan.transform(df))


_VIEW_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(
    "impact_viewer",
    "select c_custkey as k, " + ", ".join(f"{c} as original_{c}" for c in _VIEW_COLUMNS) + ", " + ", ".join(
        f"{r(e)} as anonymised_{c}" if c == "c_acctbal" else f"{e} as anonymised_{c}"
        for c, e in _CUSTOMER_COLUMNS.items()
    ) + f" from {_CUSTOMER_FROM} order by k limit 5",
)
def impact_viewer(spark, sf_dir):
    """The first five customers before and after."""
    df, plan = customer_plan(spark, sf_dir)
    view = A.impact_view(df, plan, ["c_custkey"])
    flat = view.select(
        F.col("key_c_custkey").alias("k"),
        *[F.col(f"original.{c}").alias(f"original_{c}") for c in _VIEW_COLUMNS],
        *[F.col(f"anonymised.{c}").alias(f"anonymised_{c}") for c in _VIEW_COLUMNS],
    )
    return rounded(flat)


# --- orders: a policy, with a boolean and a budget that does not reach ---------------------

_ORDER_POLICY = {
    "o_totalprice": {"method": "laplace", "epsilon": 0.4, "sensitivity": 500.0},
    "o_year": {"method": "bounded_laplace", "epsilon": 0.9, "min": 1990, "max": 2005},
    "o_done": {"method": "randomized_response", "epsilon": 0.3},
    "o_orderstatus": {"epsilon": 0.2},
}
_ORDER_SOURCE = (
    "select o_orderkey, o_orderstatus, o_totalprice, cast(year(o_orderdate) as int) as o_year, "
    "o_orderstatus = 'F' as o_done, o_orderpriority from orders"
)


def order_plan(spark, sf_dir, **options):
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("o_year"),
        (F.col("o_orderstatus") == "F").alias("o_done"), "o_orderpriority",
    )
    return df, A.fit(
        df, ["o_orderkey"], secret=SECRET, release_id=RELEASE, policy=_ORDER_POLICY, overrides={"o_orderkey": "id"}, **options
    )


def _orders_sql(year: str) -> str:
    price = _number_sql("o_totalprice", "o_orderkey", "5e2", "4e-1")
    return f"""select {hash_sql('o_orderkey')} as o_orderkey,
        {_category_sql('o_orderstatus', 'o_orderkey', '2e-1')} as o_orderstatus, {r(price, 4)} as o_totalprice,
        {year} as o_year, {boolean_rr_sql('o_done', u_sql(drawn('o_done'), 'o_orderkey'), '3e-1')} as o_done, o_orderpriority
        from ({_ORDER_SOURCE}), ({_stats_sql('orders', ['o_totalprice'], ['o_orderstatus'])})"""


@query("anonymize_orders", _orders_sql("cast(null as double)"))
def anonymize_orders(spark, sf_dir):
    """The year asks for more than is left, so it is emptied; the later boolean still fits."""
    df, plan = order_plan(spark, sf_dir, exclude=["o_orderpriority"], adjust_small=False)
    return rounded(plan.transform(df), 4)


@query("anonymize_orders_keep", _orders_sql("o_year"))
def anonymize_orders_keep(spark, sf_dir):
    """The same with a column that does not fit kept as it is."""
    df, plan = order_plan(spark, sf_dir, exclude=["o_orderpriority"], adjust_small=False, on_exhausted="keep")
    return rounded(plan.transform(df), 4)


@query(
    "release_ledger",
    "select * from (values (1, 'o_orderstatus', 'categorical_response', 2e-1, true, 2e-1, false), "
    "(2, 'o_totalprice', 'laplace', 4e-1, true, 6e-1, false), (3, 'o_year', 'bounded_laplace', 9e-1, false, 6e-1, false), "
    "(4, 'o_done', 'randomized_response', 3e-1, true, 9e-1, true)) "
    "t(ord, \"column\", operation, epsilon, admitted, used_after, formal)",
)
def release_ledger(spark, sf_dir):
    _, plan = order_plan(spark, sf_dir, exclude=["o_orderpriority"], adjust_small=False)
    return plan.ledger(spark).select("ord", "column", "operation", "epsilon", "admitted", "used_after", "formal")


# --- line items: no key but the row itself ---------------------------------------------

_LINE_RELEASE = {
    "l_orderkey": hash_sql("l_orderkey"),
    "l_partkey": hash_sql("l_partkey"),
    "l_suppkey": hash_sql("l_suppkey"),
    "l_linenumber": _count_sql("l_linenumber", "k"),
    "l_quantity": _count_sql("l_quantity", "k"),
    "l_extendedprice": r(_number_sql("l_extendedprice", "k", "1e3"), 4),
    "l_discount": r(_number_sql("l_discount", "k", "1e0"), 4),
    "l_tax": r(_number_sql("l_tax", "k", "1e0"), 4),
    "l_returnflag": _category_sql("l_returnflag", "k"),
    "l_linestatus": _category_sql("l_linestatus", "k"),
    "l_shipdate": partial_mask_sql("cast(l_shipdate as varchar)"),
}


def line_plan(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    ids = {c: "id" for c in ("l_orderkey", "l_partkey", "l_suppkey")}
    return df, A.fit(df, df.columns, secret=SECRET, release_id=RELEASE, global_epsilon=5.0, overrides=ids, distinct="approx")


@query(
    "anonymize_lineitem",
    "select " + ", ".join(f"{e} as {c}" for c, e in _LINE_RELEASE.items())
    + f" from (select *, {LINE_KEY_SQL} as k from lineitem), ({budget_sql('lineitem', 5, 11)}), "
    f"({_stats_sql('lineitem', ['l_extendedprice', 'l_discount', 'l_tax'], ['l_returnflag', 'l_linestatus'])})",
)
def anonymize_lineitem(spark, sf_dir):
    df, plan = line_plan(spark, sf_dir)
    return rounded(plan.transform(df), 4)


# --- audit ------------------------------------------------------------------------------

_PAIRED_SQL = (
    "select c_custkey, cast(c_nationkey as double) as c_nationkey, c_acctbal, c_mktsegment, c_name, "
    + ", ".join(f"{e} as {c}__noisy" for c, e in _CUSTOMER_COLUMNS.items()) + f" from {_CUSTOMER_FROM}"
)


@query(
    "audit_summary",
    f"""select {r('share * 3')} as used_epsilon, {r('budget - share * 3')} as remaining_epsilon,
        {r('share * 3 / budget * 100')} as utilization, columns_analyzed, {r('average_score', 4)} as average_score, grade,
        "rows", overall_risk, linkage_label, 'override' as detection_mode from ({budget_sql('customer', 1, 5)}),
        ({summary_sql(_PAIRED_SQL, ['c_nationkey', 'c_acctbal'])}),
        ({risk_sql(_PAIRED_SQL, _VIEW_COLUMNS, ['c_nationkey', 'c_acctbal'], 'c_custkey', [])})""",
)
def audit_summary(spark, sf_dir):
    df, plan = customer_plan(spark, sf_dir)
    summary = A.audit(plan.paired(df), plan, order=["c_custkey"]).summary
    return rounded(summary.withColumn("average_score", F.round("average_score", 4)))


# --- models and streams -----------------------------------------------------------------


_SPLIT_SQL = f"select o_orderstatus, {u_sql('split', 'o_orderkey')} < 2e-1 as is_test from orders"


@query("ml_split", f"select o_orderstatus, is_test, count(*) as n from ({_SPLIT_SQL}) group by 1, 2")
def ml_split(spark, sf_dir):
    """Orders of each state on either side of the split."""
    df = table(spark, sf_dir, "orders").withColumn("__key", F.col("o_orderkey").cast("string"))
    return split_rows(df, keyed("__key")).groupBy("o_orderstatus", "is_test").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ml_compare",
    f"""select model, train_rows, test_rows, classes, true as in_range, true as grade_fits from
        (select count(*) filter (not is_test) as train_rows, count(*) filter (is_test) as test_rows,
        count(distinct o_orderstatus) as classes from ({_SPLIT_SQL})), (values ('random_forest'), ('logistic_regression')) t(model)""",
)
def ml_compare(spark, sf_dir):
    """What SQL can know of the models of an order's state: their rows and classes, and that accuracies and grade agree."""
    found = _compared(spark, sf_dir)
    accuracies = [F.col("original_accuracy"), F.col("anonymised_accuracy")]
    size = F.abs(accuracies[1] - accuracies[0])
    return found.select(
        "model", "train_rows", "test_rows", "classes",
        (accuracies[0].between(0, 1) & accuracies[1].between(0, 1)).alias("in_range"),
        ((size < 0.05) == (F.col("grade") == "Excellent")).alias("grade_fits"),
    )


def _compared(spark, sf_dir):
    """Predict the state of an order from the original and from the released columns."""
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("o_year"), "o_orderpriority"
    )
    plan = A.fit(
        df, ["o_orderkey"], secret=SECRET, release_id=RELEASE, global_epsilon=10.0, overrides={"o_orderkey": "id"},
        exclude=["o_orderstatus"],
    )
    return compare_models(df, plan, "o_orderstatus", skip=["o_orderkey"], split=keyed("__key"))


@query("release_pair", "select count(*) as orders, cast(0 as bigint) as recovered from orders")
def release_pair(spark, sf_dir):
    """Two plans under one secret: twice the second less the first must not give the original back."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    noisy = []
    for epsilon in (0.2, 0.4):
        policy = {"o_totalprice": {"method": "laplace", "epsilon": epsilon, "min": 0.0, "max": 1e6, "sensitivity": 500.0}}
        plan = A.fit(df, ["o_orderkey"], secret=SECRET, policy=policy, overrides={"o_orderkey": "id"})
        noisy.append(plan.paired(df).select("__key", F.col("o_totalprice").alias("value"), F.col("o_totalprice__noisy").alias(f"n{len(noisy)}")))
    both = noisy[0].join(noisy[1].drop("value"), "__key")
    return both.agg(
        F.count("*").alias("orders"), F.count_if(F.abs(2 * F.col("n1") - F.col("n0") - F.col("value")) < 0.01).alias("recovered")
    )


_EVENT_COLUMNS = {
    "event_id": hash_sql("event_id"),
    "user_id": hash_sql("user_id"),
    "event_type": _category_sql("event_type", "event_id"),
    "value": r(_number_sql("value", "event_id", "1e0")),
    "props": partial_mask_sql("props"),
}


@query(
    "stream_transform",
    "select " + ", ".join(f"{e} as {c}" for c, e in _EVENT_COLUMNS.items())
    + f" from events, ({budget_sql('events', 2, 5)}), ({_stats_sql('events', ['value'], ['event_type'])})",
)
def stream_transform(spark, sf_dir):
    """A plan fitted on the events at rest releases them as a stream of files."""
    names = list(_EVENT_COLUMNS)
    events = table(spark, sf_dir, "events")
    plan = A.fit(
        events.select(names), ["event_id"], secret=SECRET, release_id=RELEASE, global_epsilon=2.0,
        overrides={"event_id": "id", "user_id": "id"},
    )
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder = scratch_dir(spark)
    running = release_stream(
        stream.select(names), plan, f"{folder}/released", f"{folder}/checkpoint", available_now=True
    )
    running.awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/released"))
