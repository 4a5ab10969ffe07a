"""Policy and budget operators over catalogues derived from the tables.

Customers stand for datasets: their orders carry column settings and release requests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.operators import budget as B
from veilframe.operators import policy as P
from veilframe.queries.base import query, r, rounded, table
from veilframe.session import scratch_dir, table_store
from veilframe.streaming import ledger as SL

_DATASET = "concat('cust_', o_custkey)"

# --- settings ---------------------------------------------------------------------------

_POLICY = {
    "dataset": _DATASET,
    "column": "concat('order_', o_orderkey)",
    "method": "case o_orderkey % 6 when 0 then 'laplace' when 1 then 'bounded_laplace' when 2 then 'discrete_laplace' "
              "when 3 then 'randomized_response' when 4 then 'exponential' end",
    "epsilon": "case o_orderkey % 5 when 0 then 0 - o_totalprice when 1 then null else o_totalprice / 1000000 end",
    "min": "case when o_orderkey % 3 = 0 then cast(18 as double) end",
    "max": "case o_orderkey % 4 when 0 then cast(10 as double) when 1 then cast(90 as double) end",
    "sensitivity": "case when o_orderkey % 2 = 0 then o_totalprice - 100000 end",
    "mask_type": "case o_orderkey % 7 when 0 then 'partial' when 1 then 'hash' when 2 then 'full' when 3 then 'rot13' end",
}
_POLICY_SQL = "select " + ", ".join(f'{e} as "{c}"' for c, e in _POLICY.items()) + " from orders"


def _policy(spark, sf_dir):
    return table(spark, sf_dir, "orders").select([F.expr(e).alias(c) for c, e in _POLICY.items()])


def _violations_sql(known: str) -> str:
    rules = {
        "method_unknown": f"coalesce(method, 'laplace') not in ({known})",
        "epsilon_not_positive": "epsilon <= 0",
        "max_not_above_min": "method = 'bounded_laplace' and max <= min",
        "sensitivity_not_positive": "sensitivity <= 0",
        "mask_type_unknown": "mask_type not in ('partial', 'hash', 'full')",
    }
    return " union all ".join(
        f"select dataset, \"column\", '{name}' as violation from ({_POLICY_SQL}) where {rule}"
        for name, rule in rules.items()
    )


@query(
    "policy_violations",
    _violations_sql("'laplace', 'bounded_laplace', 'discrete_laplace', 'scaled_laplace', 'gaussian', "
                    "'bounded_gaussian', 'randomized_response'"),
)
def policy_violations(spark, sf_dir):
    return P.policy_violations(_policy(spark, sf_dir))


_TEXT_BOUND = "case o_orderkey % 4 when 0 then 'ten' when 1 then '90' end"


@query(
    "policy_violations_text",
    f"select dataset, \"column\", 'max_not_numeric' as violation from ({_POLICY_SQL.replace(_POLICY['max'], _TEXT_BOUND)}) "
    "where method = 'bounded_laplace' and try_cast(max as double) is null and max is not null",
)
def policy_violations_text(spark, sf_dir):
    """Settings that came as text: a bound that is no number."""
    policy = table(spark, sf_dir, "orders").select(
        [F.expr(_TEXT_BOUND if c == "max" else e).alias(c) for c, e in _POLICY.items()]
    )
    return P.policy_violations(policy, P.BASIC_METHODS).where("violation like '%not_numeric'")


# --- purposes ---------------------------------------------------------------------------

_PURPOSE = (
    "case o_orderpriority when '1-URGENT' then 'qa_testing' when '2-HIGH' then 'model_retraining' "
    "when '3-MEDIUM' then 'analytics' when '4-NOT SPECIFIED' then 'general' else 'audit' end"
)
_OWN_PURPOSE = (
    "case c_mktsegment when 'AUTOMOBILE' then 'qa_testing' when 'BUILDING' then 'audit' "
    "when 'FURNITURE' then 'general' when 'HOUSEHOLD' then 'data_sharing' else 'research' end"
)
_OWN_EPSILON = "case c_nationkey % 3 when 0 then null when 1 then cast(c_nationkey + 1 as double) / 10 else 0 - c_acctbal end"
_STANDARD = (
    "(values ('general', 1e0, 'General purpose anonymization', 'Standard privacy protection for general use cases'), "
    "('qa_testing', 15e-1, 'QA testing and software development', "
    "'Moderate privacy for testing scenarios requiring better utility'), "
    "('model_retraining', 5e-1, 'Machine learning model training', 'Stricter privacy guarantees for ML training data'), "
    "('analytics', 8e-1, 'Business analytics and reporting', 'Balanced privacy for analytical use cases'), "
    "('data_sharing', 3e-1, 'External data sharing', "
    "'Maximum privacy protection for data shared with third parties')) s(purpose, epsilon, description, compliance_note)"
)
_OWN_SQL = (
    f"select concat('cust_', c_custkey) as dataset, {_OWN_PURPOSE} as purpose, "
    "case when c_nationkey % 3 = 1 then cast(c_nationkey + 1 as double) / 10 end as epsilon, "
    "concat('set by ', c_name) as description, concat('nation ', c_nationkey) as compliance_note from customer"
)
_MERGED_SQL = (
    f"select o.dataset, o.purpose, coalesce(o.epsilon, s.epsilon, 7e-1) as epsilon, o.description, o.compliance_note "
    f"from ({_OWN_SQL}) o left join {_STANDARD} on o.purpose = s.purpose"
)


def _own_purposes(spark, sf_dir):
    """Each customer configures one purpose, some without an epsilon."""
    return table(spark, sf_dir, "customer").select(
        F.expr("concat('cust_', c_custkey)").alias("dataset"),
        F.expr(_OWN_PURPOSE).alias("purpose"),
        F.expr("case when c_nationkey % 3 = 1 then cast(c_nationkey + 1 as double) / 10 end").alias("epsilon"),
        F.expr("concat('set by ', c_name)").alias("description"),
        F.expr("concat('nation ', c_nationkey)").alias("compliance_note"),
    )


@query(
    "purpose_violations",
    f"select concat('cust_', c_custkey) as dataset, {_OWN_PURPOSE} as purpose, 'epsilon_not_positive' as violation "
    f"from customer where {_OWN_EPSILON} <= 0",
)
def purpose_violations(spark, sf_dir):
    own = _own_purposes(spark, sf_dir).drop("epsilon")
    epsilon = table(spark, sf_dir, "customer").select(
        F.expr("concat('cust_', c_custkey)").alias("dataset"), F.expr(_OWN_EPSILON).alias("epsilon")
    )
    return P.purpose_violations(own.join(epsilon, "dataset"))


@query("merge_purposes", _MERGED_SQL)
def merge_purposes(spark, sf_dir):
    return P.merge_purposes(_own_purposes(spark, sf_dir), F.lit(0.7))


_EXPLICIT = "case when o_orderkey % 8 = 0 then o_totalprice / 100000 end"
_GLOBAL = "case when o_orderkey % 4 <> 1 then o_totalprice / 50000 end"


@query(
    "purpose_resolution",
    f"""with q as (select o_orderkey, {_DATASET} as dataset, {_PURPOSE} as purpose, {_EXPLICIT} as explicit_epsilon,
        {_GLOBAL} as global_epsilon from orders)
        select q.*, coalesce(explicit_epsilon, m.epsilon, s.epsilon, global_epsilon, 1e0) as epsilon,
        case when explicit_epsilon is not null then 'explicit' when m.epsilon is not null then 'configured'
        when s.epsilon is not null then 'standard' else 'global' end as epsilon_source
        from q left join ({_MERGED_SQL}) m on q.dataset = m.dataset and q.purpose = m.purpose
        left join {_STANDARD} on q.purpose = s.purpose and s.purpose <> 'general'""",
)
def purpose_resolution(spark, sf_dir):
    """Each order asks for a release of its customer's dataset."""
    requests = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr(_DATASET).alias("dataset"), F.expr(_PURPOSE).alias("purpose"),
        F.expr(_EXPLICIT).alias("explicit_epsilon"), F.expr(_GLOBAL).alias("global_epsilon"),
    )
    own = P.merge_purposes(_own_purposes(spark, sf_dir), F.lit(0.7))
    return P.resolve_epsilon(requests, own)


_AVAILABLE_SQL = (
    f"select *, true as configured from ({_MERGED_SQL}) union all "
    f"select d.dataset, s.*, false from (select distinct dataset from ({_MERGED_SQL})) d, {_STANDARD} "
    f"where not exists (select 1 from ({_MERGED_SQL}) m where m.dataset = d.dataset and m.purpose = s.purpose)"
)


@query("available_purposes", _AVAILABLE_SQL)
def available_purposes(spark, sf_dir):
    return P.available_purposes(P.merge_purposes(_own_purposes(spark, sf_dir), F.lit(0.7)))


@query(
    "purpose_info",
    f"""with q as (select o_orderkey, {_DATASET} as dataset, {_PURPOSE} as purpose from orders)
        select q.*, coalesce(a.epsilon, 1e0) as epsilon,
        case when configured is null then 'Custom purpose' else description end as description,
        case when configured is null then 'No specific compliance notes' else compliance_note end as compliance_note,
        configured from q left join ({_AVAILABLE_SQL}) a on q.dataset = a.dataset and q.purpose = a.purpose""",
)
def purpose_info(spark, sf_dir):
    requests = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr(_DATASET).alias("dataset"), F.expr(_PURPOSE).alias("purpose")
    )
    return P.purpose_info(requests, P.merge_purposes(_own_purposes(spark, sf_dir), F.lit(0.7)))


# --- settings of columns ----------------------------------------------------------------

# every customer is a dataset with these columns
_COLUMNS = [
    ("age", "age"), ("since", "year"), ("spent", "monetary"), ("ratio", "numeric"), ("visits", "count"),
    ("active", "boolean"), ("ref", "id"), ("town", "string"),
]
_COLUMN_OF = (
    "case o_orderpriority when '1-URGENT' then 'age' when '2-HIGH' then 'spent' when '3-MEDIUM' then 'visits' "
    "when '4-NOT SPECIFIED' then 'town' else 'active' end"
)
_COLUMNS_SQL = (
    "select concat('cust_', c_custkey) as dataset, c as \"column\", i as ord, t as semantic_type from customer, (values "
    + ", ".join(f"({i}, '{c}', '{t}')" for i, (c, t) in enumerate(_COLUMNS)) + ") v(i, c, t)"
)
_OWN_SETTINGS_SQL = (
    f"select {_DATASET} as dataset, {_COLUMN_OF} as \"column\", 'laplace' as method, min(o_totalprice) / 1000000 as epsilon, "
    "cast(min(o_orderkey) as double) as min, cast(null as double) as max, max(o_totalprice) as sensitivity, "
    "case when min(o_orderkey) % 2 = 0 then 'hash' end as mask_type from orders group by 1, 2"
)
_DEFAULTS_SQL = (
    "(values ('age', 'bounded_laplace', 2e-1, 18e0, 90e0, null, null), "
    "('year', 'bounded_laplace', 2e-1, 19e2, 205e1, null, null), "
    "('monetary', 'laplace', 3e-1, null, null, 1e3, null), ('numeric', 'laplace', 3e-1, null, null, null, null), "
    "('count', 'discrete_laplace', 2e-1, null, null, null, null), "
    "('boolean', 'randomized_response', 5e-1, null, null, null, null), "
    "('string', null, null, null, null, null, 'partial'), ('id', 'laplace', 2e-1, null, null, null, null)) "
    "d(t, method, epsilon, min, max, sensitivity, mask_type)"
)
_SETTINGS = ["method", "epsilon", "min", "max", "sensitivity", "mask_type"]
_COLUMN_POLICY_SQL = (
    "select c.*, " + ", ".join(f"case when p.dataset is not null then p.{f} else d.{f} end as {f}" for f in _SETTINGS)
    + f", p.dataset is not null as from_policy from ({_COLUMNS_SQL}) c left join {_DEFAULTS_SQL} on d.t = c.semantic_type "
    f"left join ({_OWN_SETTINGS_SQL}) p on p.dataset = c.dataset and p.\"column\" = c.\"column\""
)


def _columns(spark, sf_dir):
    entries = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"), F.lit(t).alias("semantic_type"))
        for i, (c, t) in enumerate(_COLUMNS)
    ])
    customers = table(spark, sf_dir, "customer")
    return customers.select(F.expr("concat('cust_', c_custkey)").alias("dataset"), F.inline(entries))


def _own_settings(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    grouped = orders.groupBy(F.expr(_DATASET).alias("dataset"), F.expr(_COLUMN_OF).alias("column"))
    return grouped.agg(
        F.lit("laplace").alias("method"),
        (F.min("o_totalprice") / 1000000).alias("epsilon"),
        F.min("o_orderkey").cast("double").alias("min"),
        F.lit(None).cast("double").alias("max"),
        F.max("o_totalprice").alias("sensitivity"),
        F.when(F.min("o_orderkey") % 2 == 0, F.lit("hash")).alias("mask_type"),
    )


@query("column_policy", _COLUMN_POLICY_SQL)
def column_policy(spark, sf_dir):
    return P.column_policy(_columns(spark, sf_dir), _own_settings(spark, sf_dir))


@query(
    "auto_assign",
    f"select p.* exclude (epsilon), (1 + (c_custkey % 9) / 10e0) / 8 as epsilon from ({_COLUMN_POLICY_SQL}) p "
    "join customer on concat('cust_', c_custkey) = p.dataset",
)
def auto_assign(spark, sf_dir):
    totals = table(spark, sf_dir, "customer").select(
        F.expr("concat('cust_', c_custkey)").alias("dataset"),
        (F.lit(1.0) + (F.col("c_custkey") % 9) / F.lit(10.0)).alias("total_epsilon"),
    )
    settled = P.column_policy(_columns(spark, sf_dir), _own_settings(spark, sf_dir))
    return P.auto_assign(settled, totals)


_SUPPLIER_EPSILON = "cast(5 + l_suppkey % 30 as double) / 10"


@query(
    "small_dataset",
    f"""with d as (select concat('supp_', l_suppkey) as dataset, count(*) as "rows", any_value({_SUPPLIER_EPSILON}) as epsilon
        from lineitem group by l_suppkey), t as (select *, case when "rows" < 500 and epsilon < 2 then 4e0 else epsilon end
        as total_epsilon from d), q as (select *, least(1e-1, total_epsilon * 1e-1) as preprocessing_epsilon from t)
        select dataset, "rows", {r('epsilon')} as epsilon, {r('total_epsilon')} as total_epsilon,
        {r('preprocessing_epsilon')} as preprocessing_epsilon,
        {r('total_epsilon - preprocessing_epsilon')} as column_budget from q""",
)
def small_dataset(spark, sf_dir):
    """A supplier's line items as a dataset, some below the size rule."""
    counted = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("rows"))
    datasets = counted.select(
        F.expr("concat('supp_', l_suppkey)").alias("dataset"), "rows",
        F.expr(_SUPPLIER_EPSILON).alias("epsilon"),
    )
    return rounded(P.split_budget(datasets))


# --- budget -----------------------------------------------------------------------------

# what each column of a supplier's dataset asks for, in thousandths, from its own line items
_CHARGES = [
    ("l_quantity", "100 + cast(floor(sum(l_quantity)) as bigint) % 300"),
    ("l_extendedprice", "100 + cast(floor(max(l_extendedprice)) as bigint) % 500"),
    ("l_discount", "50 + count(*) % 200"),
    ("l_tax", "50 + cast(floor(min(l_extendedprice)) as bigint) % 400"),
    ("l_returnflag", "30 + max(l_orderkey) % 300"),
    ("l_linestatus", "10 + min(l_partkey) % 100"),
]
_TOTAL = "1 + l_suppkey % 4 * 100 / 1000"


def _charges(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        *[F.expr(e).alias(c) for c, e in _CHARGES]
    )
    entries = F.array(*[
        F.struct(
            F.lit(i).alias("ord"), F.lit(c).alias("column"), F.lit("laplace").alias("operation"),
            (F.col(c).cast("double") / 1000).alias("epsilon"),
        )
        for i, (c, _) in enumerate(_CHARGES)
    ])
    return per.select(F.expr("concat('supp_', l_suppkey)").alias("dataset"), F.inline(entries))


def _totals(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        F.expr("concat('supp_', s_suppkey)").alias("dataset"),
        ((F.lit(1000) + F.col("s_suppkey") % 4 * 100).cast("double") / 1000).alias("total_epsilon"),
    )


def _ledger_sql() -> str:
    """The greedy charge spelled out step by step, in whole thousandths."""
    steps = ["select l_suppkey, 1000 + l_suppkey % 4 * 100 as total, 0 as u0, "
             + ", ".join(f"cast({e} as bigint) as e{i}" for i, (_, e) in enumerate(_CHARGES, 1))
             + " from lineitem group by l_suppkey"]
    for i in range(1, len(_CHARGES) + 1):
        steps.append(
            f"select *, u{i - 1} + e{i} <= total as a{i}, "
            f"case when u{i - 1} + e{i} <= total then u{i - 1} + e{i} else u{i - 1} end as u{i} from ({steps[-1]})"
        )
    return " union all ".join(
        f"select concat('supp_', l_suppkey) as dataset, {i - 1} as ord, '{c}' as \"column\", 'laplace' as operation, "
        f"cast(e{i} as double) / 1000 as epsilon, a{i} as admitted, cast(u{i} as double) / 1000 as used_after, "
        f"cast(total as double) / 1000 as total_epsilon from ({steps[-1]})"
        for i, (c, _) in enumerate(_CHARGES, 1)
    )


LEDGER_SQL = _ledger_sql()


@query("budget_ledger", LEDGER_SQL)
def budget_ledger(spark, sf_dir):
    """Each supplier's dataset charges its columns; some do not fit and are skipped."""
    return B.folded_ledger(_charges(spark, sf_dir), _totals(spark, sf_dir))


_REPORT_SQL = f"""select dataset, total_epsilon, {r('used')} as used_epsilon, admitted, skipped,
    {r('total_epsilon - used')} as remaining_epsilon, {r('used / total_epsilon * 100')} as utilization from (
    select dataset, total_epsilon, max(used_after) as used, count(*) filter (admitted) as admitted,
    count(*) filter (not admitted) as skipped from ({LEDGER_SQL}) group by 1, 2)"""


@query("budget_report", _REPORT_SQL)
def budget_report(spark, sf_dir):
    return rounded(B.budget_report(B.folded_ledger(_charges(spark, sf_dir), _totals(spark, sf_dir))))


@query(
    "can_consume",
    f"select dataset, used_epsilon, total_epsilon, round(used_epsilon * 1000) + 100 <= round(total_epsilon * 1000) "
    f"as can_consume from ({_REPORT_SQL})",
)
def can_consume(spark, sf_dir):
    report = B.budget_report(B.folded_ledger(_charges(spark, sf_dir), _totals(spark, sf_dir)))
    checked = B.can_consume(report, F.lit(0.1))
    return rounded(checked.select("dataset", "used_epsilon", "total_epsilon", "can_consume"))


@query(
    "budget_consumptions",
    f"select dataset, row_number() over (partition by dataset order by ord) as number, \"column\", "
    f"operation, epsilon from ({LEDGER_SQL}) where admitted",
)
def budget_consumptions(spark, sf_dir):
    return B.consumptions(B.folded_ledger(_charges(spark, sf_dir), _totals(spark, sf_dir)))


@query(
    "ledger_violations",
    "select concat('cust_', c_custkey) as dataset, cast(null as varchar) as \"column\", 'total_not_positive' as violation "
    "from customer where c_acctbal <= 0 union all select concat('cust_', o_custkey), concat('order_', o_orderkey), "
    "'epsilon_not_positive' from orders where o_totalprice - 100000 <= 0",
)
def ledger_violations(spark, sf_dir):
    totals = table(spark, sf_dir, "customer").select(
        F.expr("concat('cust_', c_custkey)").alias("dataset"), F.col("c_acctbal").alias("total_epsilon")
    )
    entries = table(spark, sf_dir, "orders").select(
        F.expr(_DATASET).alias("dataset"), F.expr("concat('order_', o_orderkey)").alias("column"),
        (F.col("o_totalprice") - 100000).alias("epsilon"),
    )
    return B.ledger_violations(entries, totals)


LONG_LEDGER_SQL = """with e as (select concat('type_', event_type) as dataset, event_id as ord, props as "column", 'release' as operation,
        1 + cast(floor(value * 10) as bigint) as e from events),
        g as (select dataset, list(e order by ord) as es, cast(floor(count(*) * 20) as bigint) as total from e group by 1),
        f as (select dataset, total, list_slice(list_reduce(list_prepend([0::bigint], list_transform(es, lambda x: [x])),
        lambda a, x: list_append(a, case when a[len(a)] + x[1] <= total then a[len(a)] + x[1] else a[len(a)] end)),
        2, len(es) + 1) as used from g),
        n as (select *, row_number() over (partition by dataset order by ord) as i from e)
        select n.dataset, ord, "column", operation, cast(e as double) / 1000000 as epsilon,
        used[i] > case when i = 1 then 0 else used[i - 1] end as admitted, cast(used[i] as double) / 1000000 as used_after,
        cast(total as double) / 1000000 as total_epsilon from n join f on n.dataset = f.dataset"""


def _event_charges(spark, sf_dir):
    """Every event charges the dataset of its type, of which there are five; and what these may spend."""
    events = table(spark, sf_dir, "events")
    entries = events.select(
        F.expr("concat('type_', event_type)").alias("dataset"), F.col("event_id").alias("ord"),
        F.col("props").alias("column"), F.lit("release").alias("operation"),
        (F.expr("1 + cast(floor(value * 10) as bigint)").cast("double") / 1000000).alias("epsilon"),
    )
    totals = entries.groupBy("dataset").agg((F.count(F.lit(1)) * 20).alias("n")).select(
        "dataset", (F.col("n").cast("double") / 1000000).alias("total_epsilon")
    )
    return entries, totals


@query("budget_ledger_long", LONG_LEDGER_SQL)
def budget_ledger_long(spark, sf_dir):
    """Every event charges the dataset of its type, in one ledger."""
    return B.ledger(*_event_charges(spark, sf_dir))


def _charged_stream(spark, sf_dir):
    """The charges of all events, arriving in two parts; the stream is stopped between them and goes on."""
    entries, totals = _event_charges(spark, sf_dir)
    stored, folder = table_store(spark), scratch_dir(spark)
    totals = stored(totals, "totals")
    middle = entries.agg(F.percentile_approx("ord", 0.5)).first()[0]
    for name, part in (("first", F.col("ord") <= middle), ("second", F.col("ord") > middle)):
        entries.where(part).write.parquet(f"{folder}/arriving/{name}")
        arriving = spark.readStream.schema(entries.schema).parquet(f"{folder}/arriving/*")
        SL.ledger_stream(arriving, totals, f"{folder}/ledger", f"{folder}/checkpoint", available_now=True).awaitTermination()
    return f"{folder}/ledger", totals


@query("stream_ledger", LONG_LEDGER_SQL)
def stream_ledger(spark, sf_dir):
    """Charges that arrive in two parts are decided as if they had come at once."""
    path, _ = _charged_stream(spark, sf_dir)
    return SL.decisions(spark, path).drop("batch")


@query(
    "stream_ledger_report",
    f"""select dataset, total_epsilon, {r('used_epsilon')} as used_epsilon, {r('total_epsilon - used_epsilon')} as remaining_epsilon,
        admitted, skipped, {r('used_epsilon * 1e2 / total_epsilon')} as utilization from (select dataset, total_epsilon,
        max(used_after) as used_epsilon, count(*) filter (admitted) as admitted, count(*) filter (not admitted) as skipped
        from ({LONG_LEDGER_SQL}) group by 1, 2)""",
)
def stream_ledger_report(spark, sf_dir):
    """What each dataset has left after the stream."""
    path, totals = _charged_stream(spark, sf_dir)
    return rounded(SL.stream_report(spark, path, totals))
