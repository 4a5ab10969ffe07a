"""Utility and risk of releases."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.functions import discrete as D
from veilframe.functions import noise as N
from veilframe.functions.rng import KeyedNoise, hashed_row_key
from veilframe.operators import risk as R
from veilframe.operators import utility as U
from veilframe.queries.base import SECRET, categorical_rr_sql, keyed, laplace_sql, query, r, rounded, table, u_sql

# --- paired tables ----------------------------------------------------------------------

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_SEGMENTS_SQL = "[" + ", ".join(f"'{s}'" for s in SEGMENTS) + "]"
_MISSING_BALANCE = "case when c_custkey % 9 = 4 then null else c_acctbal end"

CUSTOMER_SQL = f"""select c_custkey, age, c_acctbal, nation, segment,
    least(greatest(age + {laplace_sql(u_sql('age', 'c_custkey'), '1e0 / 2e-1')}, 0e0), 12e1) as age__noisy,
    c_acctbal + {laplace_sql(u_sql('c_acctbal', 'c_custkey'), '5e1 / 3e-1')} as c_acctbal__noisy,
    greatest(round_even(nation + {laplace_sql(u_sql('nation', 'c_custkey'), '1e0 / 5e-1')}, 0) + 0e0, 0e0) as nation__noisy,
    {categorical_rr_sql('segment', 'segment', 'c_custkey', _SEGMENTS_SQL, '5e-1')} as segment__noisy
    from (select c_custkey, cast(18 + c_custkey % 60 as double) as age, {_MISSING_BALANCE} as c_acctbal,
          cast(c_nationkey as double) as nation, c_mktsegment as segment from customer)"""
CUSTOMER_COLUMNS = ["age", "c_acctbal", "nation", "segment"]
CUSTOMER_NUMBERS = ["age", "c_acctbal", "nation"]


def paired_customers(spark, sf_dir):
    """Customers before and after; every ninth has no balance."""
    draws = keyed("c_custkey")
    df = table(spark, sf_dir, "customer").select(
        "c_custkey",
        (F.lit(18) + F.col("c_custkey") % 60).cast("double").alias("age"),
        F.expr(_MISSING_BALANCE).alias("c_acctbal"),
        F.col("c_nationkey").cast("double").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
    )
    nation = N.discrete_laplace(F.col("nation"), draws.uniform("nation"), 1.0, 0.5, lower=0.0)
    return df.select(
        "*",
        N.bounded_laplace(F.col("age"), draws.uniform("age"), 1.0, 0.2, 0.0, 120.0).alias("age__noisy"),
        N.laplace(F.col("c_acctbal"), draws.uniform("c_acctbal"), 50.0, 0.3).alias("c_acctbal__noisy"),
        nation.cast("double").alias("nation__noisy"),
        D.categorical_response(
            F.col("segment"), draws.uniform("segment", 0), draws.uniform("segment", 1), SEGMENTS, 0.5
        ).alias("segment__noisy"),
    )


LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
LINE_KEY_SQL = "md5(concat_ws('|', " + ", ".join(
    f"coalesce(length(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in LINE_COLUMNS
) + "))"
_LINE_SCALES = {"l_quantity": (1.0, 0.3), "l_extendedprice": (1000.0, 0.3), "l_discount": (0.1, 0.5), "l_tax": (0.08, 0.5)}
LINE_SQL = "select k, " + ", ".join(_LINE_SCALES) + ", " + ", ".join(
    f"{c} + {laplace_sql(u_sql(c, 'k'), f'{s}e0 / {e}e0')} as {c}__noisy" for c, (s, e) in _LINE_SCALES.items()
) + f" from (select *, {LINE_KEY_SQL} as k from lineitem)"


def paired_lines(spark, sf_dir):
    """Line items before and after, keyed by the whole row."""
    df = table(spark, sf_dir, "lineitem")
    draws = KeyedNoise(SECRET, "k")
    noisy = [
        N.laplace(F.col(c), F.col(f"u_{c}"), s, e).alias(c + U.NOISY) for c, (s, e) in _LINE_SCALES.items()
    ]
    keyed_lines = df.select(*_LINE_SCALES, hashed_row_key(df.columns).alias("k"))
    return keyed_lines.select("*", *[draws.uniform(c).alias(f"u_{c}") for c in _LINE_SCALES]).select(
        "k", *_LINE_SCALES, *noisy
    )


EVENTS_SQL = f"""select event_id, value, cast(user_id as double) as user_id,
    value + {laplace_sql(u_sql('value', 'event_id'), '2e1 / 5e-1')} as value__noisy,
    user_id + {laplace_sql(u_sql('user_id', 'event_id'), '1e0 / 5e-1')} as user_id__noisy from events"""


def paired_events(spark, sf_dir):
    draws = keyed("event_id")
    df = table(spark, sf_dir, "events").select("event_id", "value", F.col("user_id").cast("double").alias("user_id"))
    return df.select(
        "*",
        N.laplace(F.col("value"), draws.uniform("value"), 20.0, 0.5).alias("value__noisy"),
        N.laplace(F.col("user_id"), draws.uniform("user_id"), 1.0, 0.5).alias("user_id__noisy"),
    )


# --- utility ----------------------------------------------------------------------------


def utility_sql(source: str, columns: list[str]) -> str:
    """Unrounded metrics of each column."""
    parts = [
        f"""select '{c}' as "column", {i} as ord, count(*) as n, avg(o) as mean_o, avg(x) as mean_n,
        stddev_samp(o) as std_o, stddev_samp(x) as std_n, avg(abs(o - x)) as mae, max(o) - min(o) as spread
        from (select {c} as o, {c}__noisy as x from ({source})) where o is not null and x is not null having count(*) >= 2"""
        for i, c in enumerate(columns)
    ]
    return f"""select "column", ord, n as sample_size, mean_o as original_mean, mean_n as noisy_mean,
        abs(mean_o - mean_n) as absolute_error, relative * 100 as relative_error, std_o as original_std,
        std_n as noisy_std, std_n - std_o as std_change, pct as std_change_pct, mae,
        least(1e2, greatest(0e0, 100 * (5e-1 * greatest(0e0, 1 - relative) + 3e-1 * greatest(0e0, 1 - abs(pct) / 50)
        + 2e-1 * greatest(0e0, 1 - mae / case when spread > 0 then spread * 1e-1 else 1e0 end)))) as utility_score,
        case when relative * 100 < 10 then 'good' when relative * 100 <= 25 then 'moderate' else 'significant' end
        as error_band from (select *, case when mean_o = 0 then 0e0 else abs(mean_o - mean_n) / abs(mean_o) end as relative,
        case when std_o = 0 then 0e0 else (std_n - std_o) / std_o * 100 end as pct from ({' union all '.join(parts)}))"""


_MEASURES = [
    "original_mean", "noisy_mean", "absolute_error", "relative_error", "original_std", "noisy_std", "std_change",
    "std_change_pct", "mae", "utility_score",
]
_ROUNDED = '"column", ord, sample_size, ' + ", ".join(f"{r(m, 4)} as {m}" for m in _MEASURES) + ", error_band"


def summary_sql(source: str, columns: list[str]) -> str:
    return f"""select columns_analyzed, average_score, case when average_score >= 80 then 'EXCELLENT'
        when average_score >= 60 then 'GOOD' when average_score >= 40 then 'FAIR' else 'POOR' end as grade
        from (select count(*) as columns_analyzed, avg(utility_score) as average_score
        from ({utility_sql(source, columns)}))"""


@query("utility_metrics", f"select {_ROUNDED} from ({utility_sql(LINE_SQL, list(_LINE_SCALES))})")
def utility_metrics(spark, sf_dir):
    return rounded(U.utility_metrics(paired_lines(spark, sf_dir), list(_LINE_SCALES)), 4)


@query("utility_missing", f"select {_ROUNDED} from ({utility_sql(CUSTOMER_SQL, CUSTOMER_NUMBERS)})")
def utility_missing(spark, sf_dir):
    """Customers, where a row without a balance counts for the other columns only."""
    return rounded(U.utility_metrics(paired_customers(spark, sf_dir), CUSTOMER_NUMBERS), 4)


@query(
    "utility_summary",
    f"select columns_analyzed, {r('average_score', 4)} as average_score, grade from ({summary_sql(CUSTOMER_SQL, CUSTOMER_NUMBERS)})",
)
def utility_summary(spark, sf_dir):
    return rounded(U.utility_summary(U.utility_metrics(paired_customers(spark, sf_dir), CUSTOMER_NUMBERS)), 4)


@query(
    "utility_chart",
    f"select \"column\", {r('utility_score', 4)} as utility_score, {r('relative_error', 4)} as relative_error "
    f"from ({utility_sql(EVENTS_SQL, ['value', 'user_id'])})",
)
def utility_chart(spark, sf_dir):
    return rounded(U.chart_data(U.utility_metrics(paired_events(spark, sf_dir), ["value", "user_id"])), 4)


@query(
    "segment_utility",
    "select segment, count(c_acctbal) as n, " + ", ".join(
        f"{r(e, 4)} as {a}" for e, a in (
            ("avg(c_acctbal)", "original_mean"), ("avg(c_acctbal__noisy)", "noisy_mean"),
            ("avg(abs(c_acctbal - c_acctbal__noisy))", "mae"),
        )
    ) + f" from ({CUSTOMER_SQL}) group by segment",
)
def segment_utility(spark, sf_dir):
    """Means and errors of the balance within each market segment."""
    grouped = paired_customers(spark, sf_dir).groupBy("segment").agg(
        F.count("c_acctbal").alias("n"),
        F.avg("c_acctbal").alias("original_mean"),
        F.avg("c_acctbal__noisy").alias("noisy_mean"),
        F.avg(F.abs(F.col("c_acctbal") - F.col("c_acctbal__noisy"))).alias("mae"),
    )
    return rounded(grouped, 4)


# --- risk -------------------------------------------------------------------------------

_EVENT_TYPES = ["event_type", "user_id", "value", "props", "sparse"]
_EVENTS_PLUS = "select *, case when event_id % 3 = 0 then null else event_id % 5 end as sparse from events"


@query(
    "uniqueness",
    " union all ".join(
        f"select '{c}' as \"column\", {i} as ord, count(*) as \"rows\", count(distinct {c}) + "
        f"max(cast({c} is null as integer)) as unique_values, "
        + r(f"(count(distinct {c}) + max(cast({c} is null as integer))) / count(*)")
        + f" as uniqueness from ({_EVENTS_PLUS})"
        for i, c in enumerate(_EVENT_TYPES)
    ),
)
def uniqueness(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn(
        "sparse", F.expr("case when event_id % 3 = 0 then null else event_id % 5 end")
    )
    return rounded(R.uniqueness(df, _EVENT_TYPES))


def reduction_sql(source: str, columns: list[str]) -> str:
    def score(c: str) -> str:
        return f"(count(distinct {c}) + max(cast({c} is null as integer))) / count(*)"

    before = "(" + " + ".join(score(c) for c in columns) + f") / {len(columns)}"
    after = "(" + " + ".join(score(c + "__noisy") for c in columns) + f") / {len(columns)}"
    return (
        "select n as \"rows\", before as original_uniqueness, after as noisy_uniqueness, "
        "greatest((before - after) / before * 100, 0e0) as uniqueness_reduction "
        f"from (select count(*) as n, {before} as before, {after} as after from ({source}))"
    )


@query(
    "uniqueness_reduction",
    "select \"rows\", " + ", ".join(
        f"{r(c)} as {c}" for c in ("original_uniqueness", "noisy_uniqueness", "uniqueness_reduction")
    ) + f" from ({reduction_sql(CUSTOMER_SQL, CUSTOMER_COLUMNS)})",
)
def uniqueness_reduction(spark, sf_dir):
    return rounded(R.uniqueness_reduction(paired_customers(spark, sf_dir), CUSTOMER_COLUMNS))


def k_sql(source: str, columns: list[str]) -> str:
    return f"""select k_estimate, case when k_estimate >= 5 then 'ANONYMOUS' when k_estimate >= 2 then 'WEAKLY_ANONYMOUS'
        else 'NOT_ANONYMOUS' end as anonymity_level, case when k_estimate >= 5 then 'LOW' when k_estimate >= 2 then 'MEDIUM'
        else 'HIGH' end as k_risk, max_frequency, unique_combinations from (select min(n) as k_estimate,
        max(n) as max_frequency, count(*) as unique_combinations from (select count(*) as n from ({source})
        group by {', '.join(columns)}))"""


@query("k_anonymity", k_sql("select * from events", ["event_type", "user_id"]))
def k_anonymity(spark, sf_dir):
    return R.k_anonymity(table(spark, sf_dir, "events"), ["event_type", "user_id"])


@query("k_anonymity_released", k_sql(CUSTOMER_SQL, ["nation__noisy", "segment__noisy"]))
def k_anonymity_released(spark, sf_dir):
    return R.k_anonymity(paired_customers(spark, sf_dir), ["nation__noisy", "segment__noisy"])


def _preservation_sql(source: str, c: str) -> str:
    return f"""select '{c}' as "column", total_records, original_outliers, preserved_outliers, {r('rate')} as preservation_rate,
        case when total_records < 3 then 'UNKNOWN' when rate > 5e-1 then 'HIGH' when rate > 2e-1 then 'MEDIUM' else 'LOW' end
        as outlier_risk from (select *, case when original_outliers > 0 then preserved_outliers / original_outliers else 0e0 end
        as rate from (select count(*) as total_records, count(*) filter (abs(o - m) / s > 2) as original_outliers,
        count(*) filter (abs(o - m) / s > 2 and abs(x - m) / s > 2) as preserved_outliers
        from (select {c} as o, {c}__noisy as x from ({source})), (select avg({c}) as m, stddev_pop({c}) as s from ({source}))))"""


@query("outlier_preservation", _preservation_sql(EVENTS_SQL, "value"))
def outlier_preservation(spark, sf_dir):
    return rounded(R.outlier_preservation(paired_events(spark, sf_dir), "value"))


def linkage_sql(source: str, columns: list[str], key: str) -> str:
    """The attack as it is defined: every probe against every original."""
    scales = ", ".join(
        f"case when max(abs({c})) > 0 then max(abs({c})) else 1e0 end as m{i}" for i, c in enumerate(columns)
    )
    xs = ", ".join(f"coalesce({c}, 0) / m{i} as x{i}" for i, c in enumerate(columns))
    ps = ", ".join(f"coalesce({c}__noisy, 0) / m{i} as p{i}" for i, c in enumerate(columns))
    d = " + ".join(f"(o.x{i} - p.p{i}) * (o.x{i} - p.p{i})" for i in range(len(columns)))
    return f"""select probes, linked, linked * 1e2 / probes as success_rate, case when linked * 1e2 / probes > 40 then 'HIGH'
        when linked * 1e2 / probes > 15 then 'MEDIUM' else 'LOW' end as link_risk, {len(columns)} as columns_exploited from (
        with t as materialized ({source}), s as (select {scales} from t),
        o as materialized (select {key} as k, {xs}, {ps} from t, s),
        p as materialized (select * from o),
        nearest as (select p.k as probe, arg_min(o.k, struct_pack(d := {d}, k := o.k)) as found from p, o group by p.k)
        select count(*) as probes, count(*) filter (probe = found) as linked from nearest)"""


@query(
    "linkage_attack",
    f"select * exclude (success_rate), {r('success_rate')} as success_rate from ({linkage_sql(CUSTOMER_SQL, CUSTOMER_NUMBERS, 'c_custkey')})",
)
def linkage_attack(spark, sf_dir):
    """Every released customer against every original, in three columns."""
    return rounded(R.linkage_attack(paired_customers(spark, sf_dir), CUSTOMER_NUMBERS, ["c_custkey"]))


@query(
    "linkage_attack_events",
    f"select * exclude (success_rate), {r('success_rate')} as success_rate from ({linkage_sql(EVENTS_SQL, ['value', 'user_id'], 'event_id')})",
)
def linkage_attack_events(spark, sf_dir):
    """Every released event against every original."""
    return rounded(R.linkage_attack(paired_events(spark, sf_dir), ["value", "user_id"], ["event_id"]))


ORDERS_SQL = f"""select o_orderkey, price, priority,
    price + {laplace_sql(u_sql('price', 'o_orderkey'), '1e3 / 5e-1')} as price__noisy,
    priority + {laplace_sql(u_sql('priority', 'o_orderkey'), '1e-1 / 5e-1')} as priority__noisy
    from (select o_orderkey, case when o_orderstatus = 'F' then 0e0 else cast(o_totalprice as double) end as price,
          cast(substr(o_orderpriority, 1, 1) as double) as priority from orders)"""


@query(
    "linkage_attack_skewed",
    f"select * exclude (success_rate), {r('success_rate')} as success_rate from ({linkage_sql(ORDERS_SQL, ['price', 'priority'], 'o_orderkey')})",
)
def linkage_attack_skewed(spark, sf_dir):
    """Every released order against every original, where many prices are one value and a column has five."""
    draws = keyed("o_orderkey")
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.expr("case when o_orderstatus = 'F' then 0e0 else cast(o_totalprice as double) end").alias("price"),
        F.expr("cast(substr(o_orderpriority, 1, 1) as double)").alias("priority"),
    )
    paired = df.select(
        "*",
        N.laplace(F.col("price"), draws.uniform("price"), 1000.0, 0.5).alias("price__noisy"),
        N.laplace(F.col("priority"), draws.uniform("priority"), 0.1, 0.5).alias("priority__noisy"),
    )
    return rounded(R.linkage_attack(paired, ["price", "priority"], ["o_orderkey"]))


def risk_sql(source: str, columns: list[str], numbers: list[str], key: str, qi: list[str]) -> str:
    """`qi` names quasi-identifiers of the release; empty where there are none."""
    k = (
        k_sql(source, [c + "__noisy" for c in qi]) if qi else
        "select cast(0 as bigint) as k_estimate, 'UNKNOWN' as anonymity_level, 'UNKNOWN' as k_risk"
    )
    return f"""select "rows", uniqueness_reduction, probes, success_rate, link_risk, k_estimate, anonymity_level, k_risk, risk_score,
        overall_risk, case overall_risk when 'LOW' then 'Safe' when 'MODERATE' then 'Protected' else 'Exposed' end
        as linkage_label from (select *, case when risk_score >= 6 then 'CRITICAL' when risk_score >= 3 then 'MODERATE'
        else 'LOW' end as overall_risk from (select *, case link_risk when 'HIGH' then 4 when 'MEDIUM' then 2 else 0 end
        + case when k_risk = 'HIGH' and "rows" > 100 then 2 when k_risk in ('HIGH', 'MEDIUM') then 1 else 0 end
        + case when uniqueness_reduction < 5 then 1 else 0 end as risk_score
        from ({reduction_sql(source, columns)}), ({linkage_sql(source, numbers, key)}), ({k})))"""


@query(
    "risk_report",
    f"select * exclude (uniqueness_reduction, success_rate), {r('uniqueness_reduction')} as uniqueness_reduction, "
    f"{r('success_rate')} as success_rate from ({risk_sql(CUSTOMER_SQL, CUSTOMER_COLUMNS, CUSTOMER_NUMBERS, 'c_custkey', ['nation', 'segment'])})",
)
def risk_report(spark, sf_dir):
    paired = paired_customers(spark, sf_dir)
    return rounded(
        R.risk_report(paired, CUSTOMER_COLUMNS, CUSTOMER_NUMBERS, ["c_custkey"], ["nation", "segment"])
    )


@query(
    "risk_report_default",
    f"select * exclude (uniqueness_reduction, success_rate), {r('uniqueness_reduction')} as uniqueness_reduction, "
    f"{r('success_rate')} as success_rate from ({risk_sql(CUSTOMER_SQL, CUSTOMER_COLUMNS, CUSTOMER_NUMBERS, 'c_custkey', ['age'])})",
)
def risk_report_default(spark, sf_dir):
    """The quasi-identifiers that are looked for by default; of them there is an age."""
    return rounded(R.risk_report(paired_customers(spark, sf_dir), CUSTOMER_COLUMNS, CUSTOMER_NUMBERS, ["c_custkey"]))
