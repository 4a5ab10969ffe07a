"""Column profiles and type inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.operators import profile as P
from veilframe.operators import profile_state as PS
from veilframe.operators.cells import value_counts
from veilframe.queries.base import query, r, rounded, table
from veilframe.session import table_store

# columns of each table by how their cells are read
CUSTOMER = {"c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "number", "c_mktsegment": "text"}
ORDERS = {
    "o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "text", "o_totalprice": "number",
    "o_orderdate": "other", "o_orderpriority": "text",
}
PART = {"p_partkey": "int", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "int", "p_retailprice": "number"}
LINEITEM = {
    "l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "number",
    "l_extendedprice": "number", "l_discount": "number", "l_tax": "number", "l_returnflag": "text",
    "l_linestatus": "text", "l_shipdate": "other",
}
DOCUMENTS = {"doc_id": "int", "text": "text", "lang": "text", "source": "text", "n_chars": "int"}
LABELS = {"doc_id": "int", "quality": "int", "toxic": "int"}

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _class_sql(kind: str) -> str:
    if kind == "int":
        return "case when v in ('0', '1') then 'boolean' else 'numeric' end"
    if kind == "number":
        return "'numeric'"
    if kind == "other":
        return "'string'"
    return (
        "case when lower(v) in ('null', 'none', 'nan', 'n/a') then 'null' "
        "when lower(v) in ('true', 'false', '1', '0', 'yes', 'no', 'y', 'n') then 'boolean' "
        f"when regexp_matches(v, '{NUMBER}') then 'numeric' else 'string' end"
    )


def profile_sql(source: str, columns: dict[str, str]) -> str:
    """A profile written as one aggregate per column."""
    parts = []
    for i, (c, kind) in enumerate(columns.items()):
        number = f"case when class = 'numeric' then {'try_cast(v as double)' if kind in ('text', 'int', 'number') else 'null'} end"
        parts.append(f"""
            select '{c}' as "column", {i} as ord, count(v) as total_count,
              count(*) filter (class = 'numeric') as n_numeric, count(*) filter (class = 'boolean') as n_boolean,
              count(*) filter (class = 'string') as n_string, min(x) as num_min, max(x) as num_max, avg(x) as num_mean,
              bool_and(x = floor(x)) as is_integer, count(distinct x) as num_unique,
              count(distinct v) as unique_count,
              coalesce(avg(length(v)) filter (class = 'string'), 0e0) as avg_string_length
            from (select v, class, cast({number} as double) as x from (select v, {_class_sql(kind)} as class
                  from (select trim(cast("{c}" as varchar)) as v from ({source})) where v <> ''))""")
    return (
        "select *, n_numeric / total_count as numeric_ratio, n_boolean / total_count as boolean_ratio, "
        "n_string / total_count as string_ratio, num_max - num_min as num_range, "
        "case when n_numeric > 0 then num_unique / n_numeric end as num_unique_ratio, "
        "num_min >= 0 as all_non_negative, unique_count / total_count as unique_ratio "
        "from (" + " union all ".join(parts) + ")"
    )


def _hint(words: str) -> str:
    return f"regexp_matches(name, '\\b({words})\\b')"


def types_sql(profile: str) -> str:
    """The type rules, applied to a profile."""
    numeric_type = f"""case
        when {_hint('age|birth')} then 'age' when {_hint('year')} then 'year'
        when {_hint('count|number|num_|total|cylinder|smog|level|login|visit|click|score')} then 'count'
        when {_hint('price|cost|salary|income|amount|purchase|payment')} then 'monetary'
        when {_hint('id|guid|uid|identifier|key|index|pk')} then 'id'
        when {_hint('size|consumption|emission|co2|fuel|percentage|rate|ratio|co2_emissions')} then 'numeric'
        when is_integer and num_min >= 1900 and num_max <= 2100 then 'year'
        when is_integer and num_min >= 0 and num_max <= 150 and num_range < 100 then
            case when contains(name, 'age') or contains(name, 'birth') then 'age'
                 when num_max <= 12 or num_unique_ratio < 0.5 or num_max <= 100 then 'count' else 'age' end
        when is_integer and num_max <= 50 and num_unique_ratio < 0.3 then 'count'
        when is_integer and (contains(name, 'id') or contains(name, 'pk')) then 'id'
        when is_integer then 'count'
        when num_range > 1000 and (contains(name, 'price') or contains(name, 'cost') or contains(name, 'amount'))
            then 'monetary'
        else 'numeric' end"""
    part = " or ".join(
        f"contains(name, '{p}')"
        for p in ("age", "year", "count", "price", "cost", "size", "consumption", "emission")
    )
    return f"""select "column", ord, case
        when boolean_ratio > 0.8 then 'boolean'
        when numeric_ratio > 0.5 then {numeric_type}
        when string_ratio > 0.5 then 'string'
        when numeric_ratio > 0.3 and ({part}) then {numeric_type}
        else 'string' end as semantic_type
        from (select *, lower("column") as name from ({profile}))"""


_CLASS_FIELDS = '"column", ord, total_count, ' + ", ".join(
    f"{r(c + '_ratio')} as {c}_ratio" for c in ("numeric", "boolean", "string")
)
_NUMBER_FIELDS = (
    '"column", ' + ", ".join(f"{r(c, 4)} as {c}" for c in ("num_min", "num_max", "num_mean", "num_range"))
    + f", is_integer, {r('num_unique_ratio')} as num_unique_ratio, all_non_negative"
)
_TEXT_FIELDS = (
    f'"column", unique_count, {r("unique_ratio")} as unique_ratio, {r("avg_string_length")} as avg_string_length'
)


@query("value_class_profile", f"select {_CLASS_FIELDS} from ({profile_sql('select * from lineitem', LINEITEM)})")
def value_class_profile(spark, sf_dir):
    return rounded(P.class_shares(table(spark, sf_dir, "lineitem")))


@query(
    "numeric_profile",
    f"select {_NUMBER_FIELDS} from ({profile_sql('select * from orders', ORDERS)})",
)
def numeric_profile(spark, sf_dir):
    found = P.profile(table(spark, sf_dir, "orders"))
    coarse = found.withColumns({c: F.round(c, 4) for c in ("num_min", "num_max", "num_mean", "num_range")})
    return rounded(
        coarse.select(
            "column", "num_min", "num_max", "num_mean", "num_range", "is_integer", "num_unique_ratio",
            "all_non_negative",
        )
    )


@query("string_profile", f"select {_TEXT_FIELDS} from ({profile_sql('select * from documents', DOCUMENTS)})")
def string_profile(spark, sf_dir):
    """Whole documents, so that their distinct count and mean length are exact."""
    found = P.profile(table(spark, sf_dir, "documents"))
    return rounded(found.select("column", "unique_count", "unique_ratio", "avg_string_length"))


@query(
    "infer_types",
    " union all ".join(
        f"select '{name}' as dataset, * from ({types_sql(profile_sql(f'select * from {name}', columns))})"
        for name, columns in (
            ("customer", CUSTOMER), ("orders", ORDERS), ("part", PART), ("lineitem", LINEITEM), ("labels", LABELS)
        )
    ),
)
def infer_types(spark, sf_dir):
    out = None
    for name in ("customer", "orders", "part", "lineitem", "labels"):
        typed = P.infer_types(P.profile(table(spark, sf_dir, name)))
        one = typed.select(F.lit(name).alias("dataset"), "column", "ord", "semantic_type")
        out = one if out is None else out.unionByName(one)
    return out


# text columns whose names and values reach the rules for names, mixtures and tokens
_TEXT_COLUMNS = {
    "age": "cast(18 + o_orderkey % 60 as string)",
    "user_age": "cast(20 + o_orderkey % 50 as string)",
    "birth-year": "cast(1950 + o_orderkey % 50 as string)",
    "founded": "cast(1950 + o_orderkey % 50 as string)",
    "price": "case when o_orderkey % 3 = 0 then 'n/a' else cast(o_totalprice as string) end",
    "cost_mix": "case when o_orderkey % 5 in (0, 1) then cast(o_orderkey % 7 + 2 as string) when o_orderkey % 5 in (2, 3) then 'text' else 'null' end",
    "word_mix": "case when o_orderkey % 5 in (0, 1) then cast(o_orderkey % 7 + 2 as string) when o_orderkey % 5 in (2, 3) then 'text' else 'null' end",
    "flag": "case o_orderkey % 4 when 0 then 'Yes' when 1 then 'no' when 2 then 'y' else '1' end",
    "paid": "case when o_orderkey % 6 = 0 then '' else ' True ' end",
    "order_pk": "cast(o_orderkey * 10 + 2 as string)",
    "uid": "cast(o_orderkey as string)",
    "code": "concat('12', case when o_orderkey % 2 = 0 then 'd' else '' end)",
    "signed": "concat(case when o_orderkey % 2 = 0 then '-' else '+' end, cast(o_totalprice as string))",
    "exponent": "concat(cast(o_orderkey % 90 + 2 as string), 'e2')",
}
_TEXT_SOURCE = "select " + ", ".join(
    f'{e.replace("as string", "as varchar")} as "{c}"' for c, e in _TEXT_COLUMNS.items()
) + " from orders"


def text_table(spark, sf_dir):
    """Orders as text cells, as a delimited file would give them."""
    return table(spark, sf_dir, "orders").select([F.expr(e).alias(c) for c, e in _TEXT_COLUMNS.items()])


@query(
    "infer_types_text",
    types_sql(profile_sql(_TEXT_SOURCE, dict.fromkeys(_TEXT_COLUMNS, "text"))),
)
def infer_types_text(spark, sf_dir):
    return P.infer_types(P.profile(text_table(spark, sf_dir))).select("column", "ord", "semantic_type")


@query(
    "infer_types_sample",
    types_sql(profile_sql("select * from orders order by o_orderkey limit 100", ORDERS)),
)
def infer_types_sample(spark, sf_dir):
    """Types from the first hundred rows, which is how the sampling mode works."""
    found = P.profile(table(spark, sf_dir, "orders"), key=["o_orderkey"], sample_rows=100)
    return P.infer_types(found).select("column", "ord", "semantic_type")


@query(
    "type_overrides",
    "with o as (select * from (values ('c_custkey', 'id'), ('c_nationkey', 'string')) t(c, t)) "
    "select \"column\", ord, coalesce(t, semantic_type) as semantic_type, "
    "case when coalesce(t, semantic_type) in ('age', 'year', 'monetary', 'numeric', 'count') "
    "then 'quantitative' else 'categorical' end as \"group\" "
    f"from ({types_sql(profile_sql('select * from customer', CUSTOMER))}) left join o on c = \"column\"",
)
def type_overrides(spark, sf_dir):
    typed = P.infer_types(P.profile(table(spark, sf_dir, "customer")))
    wanted = spark.createDataFrame(
        [("c_custkey", "id"), ("c_nationkey", "string")], "column string, semantic_type string"
    )
    chosen = P.apply_overrides(typed, wanted)
    groups = P.column_groups(chosen)
    return groups.join(chosen.select("column", "ord"), "column").select("column", "ord", "semantic_type", "group")


# --- profiles kept per part --------------------------------------------------------------

EVENTS = {"event_id": "int", "user_id": "int", "event_type": "text", "value": "number", "props": "text"}


def event_states(spark, sf_dir):
    """The states of the days of all events, written and read again."""
    days = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return table_store(spark)(PS.profile_state(days, list(EVENTS), ["day"]), "states")


@query(
    "profile_incremental",
    f"""select p.*, true as unique_close from (select "column", ord, total_count, {r('numeric_ratio')} as numeric_ratio,
        {r('string_ratio')} as string_ratio, {r('num_min', 4)} as num_min, {r('num_max', 4)} as num_max, {r('num_mean', 4)} as num_mean,
        is_integer, {r('num_range', 4)} as num_range, {r('avg_string_length')} as avg_string_length
        from ({profile_sql('select * from events', EVENTS)})) p""",
)
def profile_incremental(spark, sf_dir):
    """The profile of all events from the states of their days; estimates are held against the exact counts."""
    merged = PS.merged_profile(event_states(spark, sf_dir))
    exact = P.profile(table(spark, sf_dir, "events"), list(EVENTS)).select("column", F.col("unique_count").alias("truth"))
    close = F.abs(F.col("unique_count") - F.col("truth")) <= F.col("truth") * 0.08  # five deviations of the sketch
    return rounded(rounded(merged.join(exact, "column").select(
        "column", "ord", "total_count", "numeric_ratio", "string_ratio", "num_min", "num_max", "num_mean", "is_integer",
        "num_range", "avg_string_length", close.alias("unique_close"),
    )).withColumns({c: F.round(c, 4) for c in ("num_min", "num_max", "num_mean", "num_range")}))


@query(
    "profile_states_daily",
    f"""select cast(ts as date) as "day", count(*) as "rows", count(value) as total_count, {r('min(value)', 4)} as num_min,
        {r('max(value)', 4)} as num_max, {r('sum(value)', 2)} as num_sum from events group by 1""",
)
def profile_states_daily(spark, sf_dir):
    """What is kept of the values of each day."""
    kept = event_states(spark, sf_dir).where("column = 'value'")
    return rounded(kept.select("day", "rows", "total_count", F.round("num_min", 4).alias("num_min"),
                               F.round("num_max", 4).alias("num_max"), F.round("num_sum", 2).alias("num_sum")))


@query(
    "frequent_incremental",
    """select 'event_type' as "column", event_type as item, count(*) as "count" from events where event_type is not null group by 2""",
)
def frequent_incremental(spark, sf_dir):
    """The frequent values of a column from the states of the days; exact, since the column has few values."""
    return PS.merged_frequent(event_states(spark, sf_dir).where("column = 'event_type'"), 100)


@query(
    "quantiles_incremental",
    """select 'value' as "column", unnest([25e-2, 5e-1, 75e-2]) as share, true as within""",
)
def quantiles_incremental(spark, sf_dir):
    """Quartiles from the states of the days, and whether their exact ranks are within 3 % of the rows."""
    found = PS.merged_quantiles(event_states(spark, sf_dir).where("column = 'value'"))
    values = value_counts(table(spark, sf_dir, "events"), ["value"]).where("value IS NOT NULL")
    number = F.col("value_text").cast("double")
    wide = found.groupBy().pivot("share", [0.25, 0.5, 0.75]).agg(F.first("value"))
    wide = wide.toDF("q0", "q1", "q2")
    met = values.withColumnRenamed("value", "value_text").crossJoin(F.broadcast(wide))  # one row
    low = [F.sum(F.when(number < F.col(f"q{i}"), F.col("n")).otherwise(0)).alias(f"below{i}") for i in range(3)]
    high = [F.sum(F.when(number <= F.col(f"q{i}"), F.col("n")).otherwise(0)).alias(f"upto{i}") for i in range(3)]
    ranks = met.agg(F.sum("n").alias("n"), *low, *high)
    rows = [
        F.struct(F.lit("value").alias("column"), F.lit(s).alias("share"),
                 ((F.col(f"below{i}") <= F.col("n") * (s + 0.03)) & (F.col(f"upto{i}") >= F.col("n") * (s - 0.03))).alias("within"))
        for i, s in enumerate((0.25, 0.5, 0.75))
    ]
    return ranks.select(F.inline(F.array(*rows)))
