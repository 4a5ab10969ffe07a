"""Sources, data quality, imputation and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.operators import impute as I
from veilframe.operators import outliers as O
from veilframe.operators import quality as Q
from veilframe.operators.profile import first_rows
from veilframe.plans.anonymize import preprocess_summary as summarize
from veilframe.queries.base import (
    keyed, laplace_sql, missing_text_sql, query, r, rnd, rounded, table, u_sql,
)
from veilframe.queries.profiling import NUMBER, _TEXT_COLUMNS, _TEXT_SOURCE, text_table
from veilframe.session import scratch_dir
from veilframe.sources import tables as S

# --- sources ----------------------------------------------------------------------------


@query("scan_limit", "select * from orders order by o_orderkey limit 1000")
def scan_limit(spark, sf_dir):
    """The row limit of a scan, made repeatable by a key."""
    return first_rows(table(spark, sf_dir, "orders"), ["o_orderkey"], 1000)


CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_LINE = "concat_ws(';', c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)"


@query(
    "delimiter_detect",
    "select d as delimiter, cast(min(length(line) - length(replace(line, d, '')) + 1) as integer) as min_fields, "
    "cast(max(length(line) - length(replace(line, d, '')) + 1) as integer) as max_fields, d = ';' as chosen "
    f"from (select {_LINE} as line from customer), (values (','), (';'), (chr(9)), ('|')) t(d) group by d",
)
def delimiter_detect(spark, sf_dir):
    path = scratch_dir(spark) + "/semicolon"
    S.write_delimited(table(spark, sf_dir, "customer"), path, ";")
    chosen = S.detect_delimiter(spark, path, sample_lines=None)
    found = S.delimiter_statistics(spark, path).drop("lines")
    return found.withColumn("chosen", F.col("delimiter") == chosen)


@query("csv_roundtrip", "select * from customer")
def csv_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    path = scratch_dir(spark) + "/csv"
    S.write_delimited(df, path)
    text = S.read_delimited(spark, path)
    return text.select([F.col(f.name).cast(f.dataType) for f in df.schema.fields])


# cells with delimiters, doubled quotes and line breaks
_QUOTED = "concat('say \"', lang, '\", ', replace(text, 'e', '\"'))"


@query("csv_quoted", f"select doc_id, {_QUOTED} as cell from documents")
def csv_quoted(spark, sf_dir):
    path = scratch_dir(spark) + "/quoted"
    S.write_delimited(table(spark, sf_dir, "documents").select("doc_id", F.expr(_QUOTED).alias("cell")), path)
    return S.read_delimited(spark, path, ",").withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query("csv_multiline", "select doc_id, text, lang, source, n_chars from documents")
def csv_multiline(spark, sf_dir):
    """Whole documents as cells, read in parallel by the default of the reader."""
    df = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = scratch_dir(spark) + "/multiline"
    S.write_delimited(df, path)
    text = S.read_delimited(spark, path, ",")
    return text.select([F.col(f.name).cast(f.dataType) for f in df.schema.fields])


@query("file_position", "select o_orderkey, o_comment, row_number() over (order by o_orderkey) - 1 as position from "
    "(select o_orderkey, concat(o_orderpriority, case when o_orderkey % 5 = 0 then chr(10) else ' ' end, o_orderstatus) as o_comment from orders)")
def file_position(spark, sf_dir):
    """Orders in the order of their key, as several text files: the position is the rank of the key."""
    comment = F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, "\n").otherwise(" "), "o_orderstatus")
    df = table(spark, sf_dir, "orders").select("o_orderkey", comment.alias("o_comment"))
    path = scratch_dir(spark) + "/ordered"
    S.write_delimited(df.repartitionByRange(6, "o_orderkey").sortWithinPartitions("o_orderkey"), path)
    return S.read_delimited(spark, path, ",", position="position").withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


_RAGGED = (
    "case c_custkey % 50 when 1 then concat_ws(';', c_custkey, c_name, c_nationkey) "
    f"when 2 then concat({_LINE}, ';surplus') when 3 then '' else {_LINE} end"
)


@query(
    "structure_check",
    f"with l as (select {_RAGGED} as line from customer), f as (select line as row_key, "
    "cast(length(line) - length(replace(line, ';', '')) + 1 as integer) as found from l where line <> '') "
    "select 'error' as severity, 'column_count' as \"check\", row_key, found from f where found <> 5 "
    "union all select 'error', 'missing_columns', row_key, found from f where found < 5 "
    "union all select 'warning', 'extra_columns', row_key, found from f where found > 5",
)
def structure_check(spark, sf_dir):
    """Customers as text in which some lines are short, long or blank."""
    path = scratch_dir(spark) + "/ragged"
    lines = table(spark, sf_dir, "customer").select(F.expr(_RAGGED).alias(";".join(CUSTOMER_COLUMNS)))
    # one text column under the header of five: the writer must not quote it
    lines.write.csv(path, header=True, sep="\x01", quote="", emptyValue="")
    return S.structure_issues(spark, path, CUSTOMER_COLUMNS, ";")


@query(
    "csv_ragged",
    "select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey, "
    "case when c_custkey % 50 <> 1 then cast(c_acctbal as varchar) end as c_acctbal, case when c_custkey % 50 <> 1 then c_mktsegment end as c_mktsegment, "
    f"case when c_custkey % 50 in (1, 2) then {_RAGGED} end as reject from customer where c_custkey % 50 <> 3",
)
def csv_ragged(spark, sf_dir):
    """Short and long records are read as far as they go, and kept whole beside it; blank lines are none."""
    path = scratch_dir(spark) + "/surplus"
    lines = table(spark, sf_dir, "customer").select(F.expr(_RAGGED).alias(";".join(CUSTOMER_COLUMNS)))
    lines.write.csv(path, header=True, sep="\x01", quote="", emptyValue="")
    return S.read_delimited(spark, path, ";", reject="reject")


# --- quality ----------------------------------------------------------------------------

_GAPS = {
    "o_orderkey": "o_orderkey",
    "o_totalprice": "case when o_orderkey % 7 = 0 then null else o_totalprice end",
    "o_orderpriority": "case when o_orderkey % 11 = 0 then 'N/A' when o_orderkey % 13 = 0 then ' ' else o_orderpriority end",
    "o_orderstatus": "case when o_orderkey % 17 = 0 then 'None' else o_orderstatus end",
    "o_year": "cast(year(o_orderdate) as int)",
}
GAPS_SQL = "select " + ", ".join(f"{e} as {c}" for c, e in _GAPS.items()) + " from orders"
_GAPS_MISSING = {
    "o_orderkey": "o_orderkey is null",
    "o_totalprice": "o_totalprice is null",
    "o_orderpriority": missing_text_sql("o_orderpriority"),
    "o_orderstatus": missing_text_sql("o_orderstatus"),
    "o_year": "o_year is null",
}
GAPS_TYPES = {
    "o_orderkey": "id", "o_totalprice": "monetary", "o_orderpriority": "string", "o_orderstatus": "string",
    "o_year": "year",
}


def gaps(spark, sf_dir):
    """Orders with missing prices, priorities and states."""
    return table(spark, sf_dir, "orders").select([F.expr(e).alias(c) for c, e in _GAPS.items()])


def _mix_sql(c: str, i: int) -> str:
    v = f'lower(trim("{c}"))'
    return f"""select '{c}' as "column", {i} as ord, expected_class, count(*) as differing from (
        select class, first_value(class) over (order by o_orderkey) as expected_class from (
        select o_orderkey, case when regexp_matches({v}, '{NUMBER}') then 'numeric'
        when {v} in ('true', 'false', 'yes', 'no', 'y', 'n') then 'boolean' else 'string' end as class
        from ({_TEXT_SOURCE.replace(' from orders', ', o_orderkey from orders')})
        where {v} not in ('', 'null', 'none', 'nan', 'n/a'))) where class <> expected_class group by 1, 2, 3"""


@query("type_mix", " union all ".join(_mix_sql(c, i) for i, c in enumerate(_TEXT_COLUMNS)))
def type_mix(spark, sf_dir):
    """Text columns of orders whose cells are not all of one class, over every row."""
    orders = table(spark, sf_dir, "orders")
    df = orders.select("o_orderkey", *[F.expr(e).alias(c) for c, e in _TEXT_COLUMNS.items()])
    return Q.type_mix(df, ["o_orderkey"], list(_TEXT_COLUMNS), sample_rows=None)


_EXTREME = "value * case when event_id % 1000 = 0 then 1e12 else 1e0 end"


@query(
    "extreme_values",
    "select cast(event_id as varchar) as row_key, 'value' as \"column\", value "
    f"from (select event_id, {_EXTREME} as value from events) where abs(value) > 1e10",
)
def extreme_values(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("value", F.expr(_EXTREME))
    return Q.extreme_values(df, ["event_id"])


@query(
    "missing_report",
    " union all ".join(
        f"select '{c}' as \"column\", {i} as ord, count(*) filter ({m}) as missing, count(*) as \"rows\", "
        f"{r(f'count(*) filter ({m}) * 1e2 / count(*)')} as missing_percentage from ({GAPS_SQL})"
        for i, (c, m) in enumerate(_GAPS_MISSING.items())
    ),
)
def missing_report(spark, sf_dir):
    return rounded(Q.missing_report(gaps(spark, sf_dir)))


_MISSING_SUM = " + ".join(f"count(*) filter ({m})" for m in _GAPS_MISSING.values())


@query(
    "missing_totals",
    f"select count(*) as \"rows\", count(*) * 5 as total_cells, {_MISSING_SUM} as total_missing, "
    f"{r(f'({_MISSING_SUM}) * 1e2 / (count(*) * 5)')} as missing_percentage from ({GAPS_SQL})",
)
def missing_totals(spark, sf_dir):
    return rounded(Q.missing_totals(gaps(spark, sf_dir)))


def _duplicates_sql(source: str) -> str:
    return (
        "select n as \"rows\", u as unique_rows, n - u as duplicate_rows, "
        + r("(n - u) * 1e2 / n")
        + f" as duplicate_percentage from (select (select count(*) from ({source})) as n, "
        f"(select count(*) from (select distinct * from ({source}))) as u)"
    )


@query("duplicate_report", _duplicates_sql("select role, turn from conversations"))
def duplicate_report(spark, sf_dir):
    return rounded(Q.duplicate_report(table(spark, sf_dir, "conversations").select("role", "turn")))


@query("duplicate_texts", _duplicates_sql("select text, lang from documents"))
def duplicate_texts(spark, sf_dir):
    """Copies of whole documents."""
    return rounded(Q.duplicate_report(table(spark, sf_dir, "documents"), ["text", "lang"], digest=True))


_SEVERITY = "case when o_orderkey % 41 = 0 then 'critical' when o_orderkey % 5 = 0 then 'error' else 'warning' end"


@query(
    "quality_score",
    "with c as (select o_custkey, count(*) filter (s = 'critical') as critical, count(*) filter (s = 'error') as errors, "
    f"count(*) filter (s = 'warning') as warnings from (select o_custkey, {_SEVERITY} as s from orders) group by 1), "
    "q as (select *, cast(greatest(100 - case when critical > 0 then 50 else 0 end - 20 * least(errors, 3) "
    "- 5 * least(warnings, 10), 0) as integer) as quality_score from c) select *, case when quality_score >= 90 then "
    "'excellent' when quality_score >= 80 then 'good' when quality_score >= 70 then 'fair' when quality_score >= 60 "
    "then 'poor' else 'critical' end as quality_assessment from q",
)
def quality_score(spark, sf_dir):
    """Orders read as issues of a customer's dataset, scored per customer."""
    found = table(spark, sf_dir, "orders").select("o_custkey", F.expr(_SEVERITY).alias("severity"))
    return Q.issue_scores(found, ["o_custkey"])


@query(
    "issue_details",
    f"with e as (select cast(event_id as varchar) as row_key, {_EXTREME} as value from events) "
    "select 'warning' as severity, 'extreme_value' as \"check\", row_key, 'value' as \"column\", "
    "value from e where abs(value) > 1e10 order by row_key limit 20",
)
def issue_details(spark, sf_dir):
    """The twenty issues that a report shows."""
    df = table(spark, sf_dir, "events").withColumn("value", F.expr(_EXTREME))
    return Q.issue_details(Q.issues(df.select("event_id", "value"), ["event_id"]))


def _report_sql(source: str, missing: str, columns: int, extreme: str) -> str:
    return f"""with t as ({source}), d as (select count(*) as u from (select distinct * from t)),
        a as (select count(*) as n, {missing} as gone, count(*) filter ({extreme}) as warnings from t)
        select n as "rows", {columns} as columns, n * {columns} as total_cells, cast(0 as integer) as critical,
        cast(0 as bigint) as errors, warnings, cast(100 - 5 * least(warnings, 10) as integer) as quality_score,
        case when warnings <= 2 then 'excellent' when warnings <= 4 then 'good' when warnings <= 6 then 'fair'
        when warnings <= 8 then 'poor' else 'critical' end as quality_assessment,
        gone as total_missing, {r(f'gone * 1e2 / (n * {columns})')} as missing_percentage,
        u as unique_rows, n - u as duplicate_rows, {r('(n - u) * 1e2 / n')} as duplicate_percentage from a, d"""


@query(
    "quality_report",
    _report_sql(
        f"select event_id, user_id, event_type, {_EXTREME} as value from events", "cast(0 as bigint)", 4,
        "abs(value) > 1e10",
    ),
)
def quality_report(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("value", F.expr(_EXTREME))
    df = df.select("event_id", "user_id", "event_type", "value")
    return rounded(Q.quality_report(df, ["event_id"]))


# one short record, some long ones, names that are numbers, balances out of range
_TEXT_NAME = "case when c_custkey % 1400 = 7 then '4711' else c_name end"
_TEXT_BALANCE = "case when c_custkey % 2000 = 11 then 5e10 else c_acctbal end"
_TEXT_LINE = f"""case when c_custkey % 5000 = 1 then concat_ws(';', c_custkey, {_TEXT_NAME}, c_nationkey)
    else concat_ws(';', c_custkey, {_TEXT_NAME}, c_nationkey, {_TEXT_BALANCE}, c_mktsegment,
    case when c_custkey % 1000 = 2 then 'surplus' end) end"""


def customers_from_text(spark, sf_dir):
    """Customers written as ragged text and read again with types, and what is wrong with the text."""
    path = scratch_dir(spark) + "/customers"
    lines = table(spark, sf_dir, "customer").select(F.expr(_TEXT_LINE).alias(";".join(CUSTOMER_COLUMNS)))
    lines.write.csv(path, header=True, sep="\x01", quote="", emptyValue="")
    text = S.read_delimited(spark, path, ";")
    typed = {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double"}
    df = text.select([F.col(c).cast(typed.get(c, "string")) for c in CUSTOMER_COLUMNS])
    return df, S.structure_issues(spark, path, CUSTOMER_COLUMNS, ";")


@query(
    "quality_report_text",
    f"""with a as (select count(*) as n, 2 * count(*) filter (c_custkey % 5000 = 1) as gone,
        count(*) filter (c_custkey % 1000 = 2) as long, count(*) filter (c_custkey % 1400 = 7) as mixed,
        count(*) filter (c_custkey % 2000 = 11) as extreme from customer),
        b as (select *, gone + long as errors, long + mixed + extreme as warnings from a),
        c as (select *, cast(100 - 20 * least(errors, 3) - 5 * least(warnings, 10) as integer) as score from b)
        select n as "rows", 5 as columns, n * 5 as total_cells, cast(0 as integer) as critical, errors, warnings,
        greatest(score, 0) as quality_score, case when score >= 90 then 'excellent' when score >= 80 then 'good' when score >= 70
        then 'fair' when score >= 60 then 'poor' else 'critical' end as quality_assessment, gone as total_missing,
        {r('gone * 1e2 / (n * 5)')} as missing_percentage, n as unique_rows, cast(0 as bigint) as duplicate_rows,
        0e0 as duplicate_percentage from c""",
)
def quality_report_text(spark, sf_dir):
    """All columns of a text table with its structure findings: errors, mixed cells, extremes, gaps."""
    df, structure = customers_from_text(spark, sf_dir)
    return rounded(Q.quality_report(df, ["c_custkey"], structure))


@query(
    "quality_issues_text",
    f"""with l as (select *, {_TEXT_LINE} as line from customer)
        select 'error' as severity, 'column_count' as "check", line as row_key, cast(null as varchar) as "column", cast(null as double) as value
        from l where c_custkey % 5000 = 1 or c_custkey % 1000 = 2
        union all select 'error', 'missing_columns', line, null, null from l where c_custkey % 5000 = 1
        union all select 'warning', 'extra_columns', line, null, null from l where c_custkey % 1000 = 2
        union all select 'warning', 'type_mix', cast(c_custkey as varchar), 'c_name', null from l where c_custkey % 1400 = 7
        union all select 'warning', 'extreme_value', cast(c_custkey as varchar), 'c_acctbal', 5e10 from l where c_custkey % 2000 = 11""",
)
def quality_issues_text(spark, sf_dir):
    """Every issue of the text table by its row."""
    df, structure = customers_from_text(spark, sf_dir)
    return Q.issues(df, ["c_custkey"], structure)


# --- imputation -------------------------------------------------------------------------


def _noisy_mean_sql(c: str, epsilon: float) -> str:
    scale = f"greatest((max({c}) - min({c})) / count({c}), 1e-1) / {epsilon!r}e0"
    return f"avg({c}) + {laplace_sql(u_sql(c, chr(39) + '*' + chr(39), f'impute/{epsilon!r}'), scale)}"


@query(
    "impute_dp_mean",
    "select 'c_acctbal' as \"column\", 0 as ord, 'dp_mean' as method, count(*) - count(c_acctbal) as missing_count, "
    + r(_noisy_mean_sql("c_acctbal", 0.05), 4)
    + " as number, 5e-2 as epsilon_used from (select case when c_custkey % 7 = 0 then null else c_acctbal end as "
    "c_acctbal from customer) union all select 'c_nationkey', 1, 'none', 0, null, 0e0",
)
def impute_dp_mean(spark, sf_dir):
    balance = F.expr("case when c_custkey % 7 = 0 then null else c_acctbal end")
    df = table(spark, sf_dir, "customer").withColumn("c_acctbal", balance)
    return rounded(I.numeric_imputation(df, ["c_acctbal", "c_nationkey"], 0.05, keyed("c_custkey")), 4)


@query(
    "impute_median_small",
    "with t as (select case when o_orderkey < 7 then o_totalprice end as few, cast(null as double) as none_left "
    "from orders) select 'few' as \"column\", 0 as ord, 'median' as method, count(*) - count(few) as missing_count, "
    "median(few) as number, 0e0 as epsilon_used from t "
    "union all select 'none_left', 1, 'zero_fallback', count(*), 0e0, 0e0 from t",
)
def impute_median_small(spark, sf_dir):
    """Columns of orders with very few values left, or none."""
    return I.numeric_imputation(_few_left(spark, sf_dir), ["few", "none_left"], 0.05, keyed("few"), exact_median=True)


def _few_left(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.expr("case when o_orderkey < 7 then o_totalprice end").alias("few"),
        F.lit(None).cast("double").alias("none_left"),
    )


@query(
    "impute_dp_median",
    "with t as (select case when o_orderkey < 7 then o_totalprice end as few from orders) "
    "select 'few' as \"column\", 0 as ord, 'dp_median' as method, count(*) - count(few) as missing_count, "
    + r("median(few) + " + laplace_sql(u_sql("few", "'*'", "impute/0.05"), "greatest(max(few) - min(few), 1e-1) / 5e-2"), 4)
    + " as number, 5e-2 as epsilon_used from t",
)
def impute_dp_median(spark, sf_dir):
    """The same with the noise that a release needs."""
    return rounded(I.numeric_imputation(_few_left(spark, sf_dir), ["few"], 0.05, keyed("few")), 4)


def _mode_sql(c: str, i: int) -> str:
    gone = _GAPS_MISSING[c]
    return f"""select '{c}' as "column", {i} as ord, case when missing_count = 0 then 'none' else 'mode' end as method,
        missing_count, case when missing_count > 0 then value end as text,
        case when missing_count > 0 then n end as mode_frequency
        from (select cast({c} as varchar) as value, count(*) as n, min(o_orderkey) as first
              from ({GAPS_SQL}) where not {gone} group by 1 order by n desc, first limit 1),
             (select count(*) filter ({gone}) as missing_count from ({GAPS_SQL}))"""


@query(
    "impute_mode",
    " union all ".join(f"select * from ({_mode_sql(c, i)})" for i, c in enumerate(("o_orderpriority", "o_orderstatus", "o_year"))),
)
def impute_mode(spark, sf_dir):
    return I.mode_imputation(gaps(spark, sf_dir), ["o_orderpriority", "o_orderstatus", "o_year"], ["o_orderkey"])


def _first_mode(c: str) -> str:
    return (
        f"(select {c} from ({GAPS_SQL}) where not {_GAPS_MISSING[c]} group by 1 "
        "order by count(*) desc, min(o_orderkey) limit 1)"
    )


IMPUTED_SQL = (
    f"select o_orderkey, coalesce(o_totalprice, (select {_noisy_mean_sql('o_totalprice', 0.1 / 5)} "
    f"from ({GAPS_SQL}))) as o_totalprice, "
    f"case when {_GAPS_MISSING['o_orderpriority']} then {_first_mode('o_orderpriority')} else o_orderpriority end as o_orderpriority, "
    f"case when {_GAPS_MISSING['o_orderstatus']} then {_first_mode('o_orderstatus')} else o_orderstatus end as o_orderstatus, "
    f"o_year from ({GAPS_SQL})"
)


@query(
    "impute_all",
    f"select o_orderkey, {r('o_totalprice', 4)} as o_totalprice, o_orderpriority, o_orderstatus, o_year from ({IMPUTED_SQL})",
)
def impute_all(spark, sf_dir):
    """Every gap of orders filled by its semantic type."""
    df = gaps(spark, sf_dir)
    fills = I.fit_imputation(df, GAPS_TYPES, ["o_orderkey"], 0.1, keyed("o_orderkey"))
    return rounded(df.select([I.imputed(df, c, fills[c]).alias(c) for c in df.columns]), 4)


# --- outliers ---------------------------------------------------------------------------


def limits_sql(source: str, c: str) -> str:
    """n, mean, std, quartiles and the interquartile limits of one column."""
    return f"""select n, mean, std, low, high, median, q1 - 15e-1 * (q3 - q1) as lower_limit,
        q3 + 15e-1 * (q3 - q1) as upper_limit from (select count(v) as n, avg(v) as mean, stddev_samp(v) as std,
        min(v) as low, max(v) as high, median(v) as median, list_extract(list_sort(list(v)), count(v) // 4 + 1) as q1,
        list_extract(list_sort(list(v)), 3 * count(v) // 4 + 1) as q3
        from (select cast({c} as double) as v from ({source}) where {c} is not null))"""


def summary_sql(source: str, c: str, i: int) -> str:
    z = "abs(v - mean) / std > 3"
    q = "(v < lower_limit or v > upper_limit)"
    return f"""select '{c}' as "column", {i} as ord, true as analysis_performed, cast(null as varchar) as reason,
        any_value(n) as sample_size, count(*) filter ({z}) as zscore_outliers, count(*) filter ({q}) as iqr_outliers,
        count(*) filter ({z} or {q}) as total_outliers,
        {r(f'count(*) filter ({z} or {q}) * 1e2 / any_value(n)')} as outlier_percentage,
        {r('any_value(mean)', 4)} as mean, {r('any_value(median)', 4)} as median, {r('any_value(std)', 4)} as std,
        {r('any_value(low)', 4)} as min, {r('any_value(high)', 4)} as max
        from (select cast({c} as double) as v from ({source})), ({limits_sql(source, c)})"""


def _rounded_summary(df):
    names = ("mean", "median", "std", "min", "max")
    return df.withColumns({"outlier_percentage": rnd(F.col("outlier_percentage")), **{c: rnd(F.col(c), 4) for c in names}})


_EVENTS = "select event_id, value from events"


@query(
    "zscore_outliers",
    f"select event_id, value, {r('abs(value - mean) / std')} as z_score from events, ({limits_sql(_EVENTS, 'value')}) "
    "where abs(value - mean) / std > 3",
)
def zscore_outliers(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    limits = O.fit_limits(df, ["value"])["value"]
    return rounded(O.zscore_outliers(df, "value", limits, ["event_id"]))


@query(
    "iqr_outliers",
    "select event_id, value, case when value < lower_limit then 'low_outlier' else 'high_outlier' end as outlier_type "
    f"from events, ({limits_sql(_EVENTS, 'value')}) where value < lower_limit or value > upper_limit",
)
def iqr_outliers(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    limits = O.fit_limits(df, ["value"])["value"]
    return O.iqr_outliers(df, "value", limits, ["event_id"])


@query(
    "outlier_details",
    "select event_id, value, case when abs(value - mean) / std > 3 then 'zscore' else 'iqr' end as outlier_type "
    f"from events, ({limits_sql(_EVENTS, 'value')}) where value < lower_limit or value > upper_limit "
    "or abs(value - mean) / std > 3 order by outlier_type desc, event_id limit 10",
)
def outlier_details(spark, sf_dir):
    """The ten outliers that a report shows."""
    df = table(spark, sf_dir, "events")
    limits = O.fit_limits(df, ["value"])["value"]
    return O.outlier_details(df, "value", limits, ["event_id"])


_LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(
    "outlier_all_columns",
    " union all ".join(
        f"select * from ({summary_sql('select * from lineitem', c, i)})" for i, c in enumerate(_LINE_NUMBERS)
    ),
)
def outlier_all_columns(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return _rounded_summary(O.outlier_summary(df, O.fit_limits(df, _LINE_NUMBERS)))


@query(
    "outlier_summary",
    "select count(*) as columns_analyzed, count(*) filter (total_outliers > 0) as columns_with_outliers, "
    "cast(sum(total_outliers) as bigint) as total_outliers from ("
    + summary_sql("select * from events", "value", 0) + " union all "
    + summary_sql("select * from events", "user_id", 1) + ")",
)
def outlier_summary(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return O.outlier_totals(O.outlier_summary(df, O.fit_limits(df, ["value", "user_id"])))


_IMPUTED_COUNTS = " + ".join(f"count(*) filter ({_GAPS_MISSING[c]})" for c in ("o_totalprice", "o_orderpriority", "o_orderstatus"))


@query(
    "preprocess_summary",
    f"""with o as ({summary_sql(IMPUTED_SQL, 'o_totalprice', 0)} union all {summary_sql(IMPUTED_SQL, 'o_year', 1)}),
        s as (select cast(sum(total_outliers) as bigint) as total_outliers, count(*) filter (total_outliers > 0) as hit from o),
        g as (select count(*) as n, {_IMPUTED_COUNTS} as gone, count(*) - (select count(*) from (select distinct * from ({GAPS_SQL})))
              as duplicates from ({GAPS_SQL}))
        select n as original_rows, n as final_rows, cast(100 as integer) as quality_score, 'excellent' as quality_assessment,
        gone as total_missing, duplicates as duplicate_rows, cast(3 as integer) as columns_imputed,
        cast(gone as integer) as values_imputed, {r('1e-1 / 5')} as epsilon_used,
        cast(2 as bigint) as columns_analyzed, hit as columns_with_outliers, total_outliers,
        cast(total_outliers > 0 as integer) as issues_detected,
        case when total_outliers > 0 then 'outliers_found' else '' end
        as recommendations from g, s""",
)
def preprocess_summary(spark, sf_dir):
    df = gaps(spark, sf_dir)
    fills = I.fit_imputation(df, GAPS_TYPES, ["o_orderkey"], 0.1, keyed("o_orderkey"))
    return rounded(summarize(df, ["o_orderkey"], GAPS_TYPES, fills))
