"""Filters, filter options, projections, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import (
    EVENT_ROLES,
    EVENTS_SQL,
    ORDERS_ROLES,
    ORDERS_SQL,
    event_snapshots,
    order_snapshots,
    query,
    table,
    tidy,
    with_nan,
)
from snaplens import (
    Analysis,
    BooleanFilter,
    CategoricalFilter,
    DateFilter,
    NumericFilter,
    OutlierSpec,
    Semantic,
    TextFilter,
    add_features,
    apply_filters,
    clip_upper,
    detect_types,
    export_info,
    filter_options,
    order_columns,
    preview,
    select_columns,
    summary,
)


def filtered(name, source, filters, sql, columns=None):
    @query(name, sql)
    def _(spark, folder):
        df = apply_filters(table(spark, folder, source), filters)
        return df.select(*columns) if columns else df


ORDERS, DOCS = "SELECT * FROM orders", "SELECT doc_id, lang, source, n_chars FROM documents"
DOC_COLUMNS = ["doc_id", "lang", "source", "n_chars"]

filtered(
    "filter_cat_include", "orders", [CategoricalFilter("o_orderpriority", ["1-URGENT", "2-HIGH"])],
    f"{ORDERS} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
)
filtered(
    "filter_cat_include_number", "lineitem", [CategoricalFilter("l_linenumber", ["2", "05", "7"])],
    "SELECT * FROM lineitem WHERE CAST(l_linenumber AS VARCHAR) IN ('2', '05', '7')",
)


@query(
    "filter_cat_double",
    """SELECT * FROM (SELECT o_orderkey, floor(o_totalprice / 100000) * 1e7 AS size FROM orders)
    WHERE size IN (10000000.0, 20000000.0)""",
)
def _(spark, folder):
    size = (F.floor(F.col("o_totalprice") / 100000) * F.lit(1e7)).alias("size")
    rows = table(spark, folder, "orders").select("o_orderkey", size)
    return apply_filters(rows, [CategoricalFilter("size", ["10000000.0", "2.0E7", "no number"])])


@query("filter_cat_bool", "SELECT * FROM (SELECT o_orderkey, o_totalprice > 150000 AS large FROM orders) WHERE large")
def _(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", (F.col("o_totalprice") > 150000).alias("large"))
    return apply_filters(rows, [CategoricalFilter("large", ["True"])])


@query("filter_num_nan", "SELECT event_id FROM events WHERE event_id % 7 <> 0 AND value > 100")
def _(spark, folder):
    rows = with_nan(table(spark, folder, "events").select("event_id", "value"))
    return apply_filters(rows, [NumericFilter("value", "greater_than", low=100.0)]).select("event_id")


filtered(
    "filter_cat_exclude", "orders", [CategoricalFilter("o_orderstatus", ["P"], "exclude")],
    f"{ORDERS} WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('P')",
)
filtered("filter_cat_none", "orders", [CategoricalFilter("o_orderstatus", [], "exclude")], f"{ORDERS} WHERE false")
filtered(
    "filter_num_range", "lineitem", [NumericFilter("l_quantity", "range", 10, 20)],
    "SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 20",
)
filtered(
    "filter_num_greater", "orders", [NumericFilter("o_totalprice", "greater_than", low=400000)],
    f"{ORDERS} WHERE o_totalprice > 400000",
)
filtered(
    "filter_num_less", "orders", [NumericFilter("o_totalprice", "less_than", high=20000)],
    f"{ORDERS} WHERE o_totalprice < 20000",
)
filtered(
    "filter_date_range", "orders", [DateFilter("o_orderdate", "range", "1997-01-01", "1997-12-31")],
    f"{ORDERS} WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'",
)
filtered(
    "filter_date_after", "events", [DateFilter("ts", "after", low="2024-01-20")],
    "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-20'",
)
filtered(
    "filter_date_before", "events", [DateFilter("ts", "before", high="2024-01-10")],
    "SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-10'",
)
filtered(
    "filter_text_contains", "documents", [TextFilter("text", "THE")],
    f"{DOCS} WHERE contains(lower(text), 'the')", DOC_COLUMNS,
)
filtered(
    "filter_text_contains_case", "documents", [TextFilter("text", "The.", case_sensitive=True)],
    f"{DOCS} WHERE contains(text, 'The.')", DOC_COLUMNS,
)
filtered(
    "filter_text_starts", "documents", [TextFilter("text", "th", "starts_with")],
    f"{DOCS} WHERE starts_with(lower(text), 'th')", DOC_COLUMNS,
)
filtered(
    "filter_text_ends", "documents", [TextFilter("text", "en.", "ends_with")],
    f"{DOCS} WHERE ends_with(lower(text), 'en.')", DOC_COLUMNS,
)
filtered(
    "filter_text_exact", "documents", [TextFilter("source", "SRC3", "exact")],
    f"{DOCS} WHERE lower(source) = 'src3'", DOC_COLUMNS,
)


@query("filter_bool", "SELECT *, o_orderstatus = 'P' AS is_open FROM orders WHERE o_orderstatus = 'P'")
def _(spark, folder):
    df = table(spark, folder, "orders").withColumn("is_open", F.col("o_orderstatus") == "P")
    return apply_filters(df, [BooleanFilter("is_open", [True])])


COMBINED = [
    CategoricalFilter("o_orderstatus", ["P"], "exclude"),
    NumericFilter("o_totalprice", "range", 100000, 300000),
    DateFilter("o_orderdate", "after", low="1996-06-30"),
    TextFilter("o_orderpriority", "i"),
    TextFilter("o_orderpriority", ""),
    NumericFilter("no_such_column", "range", 0, 1),
    CategoricalFilter("o_orderstatus", ["O"], active=False),
]
COMBINED_SQL = """o_orderstatus <> 'P' AND o_totalprice BETWEEN 100000 AND 300000
    AND o_orderdate > TIMESTAMP '1996-06-30' AND contains(lower(o_orderpriority), 'i')"""
filtered("filter_combined", "orders", COMBINED, f"{ORDERS} WHERE {COMBINED_SQL}")


def _option_sql(source, categories, numbers, dates, texts):
    blank = "NULL::VARCHAR AS option, NULL::DOUBLE AS min, NULL::DOUBLE AS p25, NULL::DOUBLE AS p50, NULL::DOUBLE AS p75, NULL::DOUBLE AS max, NULL::DATE AS min_date, NULL::DATE AS max_date"
    parts = [
        f"SELECT DISTINCT '{c}' AS column, 'categorical' AS type, CAST({c} AS VARCHAR) AS option FROM {source} WHERE {c} IS NOT NULL"
        for c in categories
    ]
    parts += [
        f"""SELECT '{c}' AS column, 'numerical' AS type, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 6) AS p25,
        round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, max({c})::DOUBLE AS max FROM {source}"""
        for c in numbers
    ]
    parts += [
        f"SELECT '{c}' AS column, 'date' AS type, min({c})::DATE AS min_date, max({c})::DATE AS max_date FROM {source}"
        for c in dates
    ]
    parts += [f"SELECT '{c}' AS column, 'text' AS type" for c in texts]
    head = f"SELECT 'x' AS column, 'x' AS type, {blank} WHERE false"
    return " UNION ALL BY NAME ".join([head, *parts])


@query(
    "filter_options",
    _option_sql("orders", ["o_orderstatus", "o_orderpriority"], ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderdate"], []),
)
def _(spark, folder):
    df = table(spark, folder, "orders")
    return tidy(filter_options(df, detect_types(df)))


@query(
    "filter_options_documents",
    _option_sql("documents", ["doc_id", "lang", "source"], ["n_chars"], [], ["text"]),
)
def _(spark, folder):
    df = table(spark, folder, "documents")
    return tidy(filter_options(df, detect_types(df)))


@query(
    "clip_upper",
    "SELECT o_orderkey, least(o_totalprice, 300000) AS o_totalprice, o_totalprice > 300000 AS above_limit FROM orders",
)
def _(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return clip_upper(df, "o_totalprice", 300000.0)


@query("column_subset", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, folder):
    return select_columns(table(spark, folder, "orders"), ["o_orderkey", "o_totalprice", "no_such_column"])


@query(
    "preview",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus "
    "FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate LIMIT 100",
)
def _(spark, folder):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    return preview(table(spark, folder, "lineitem"), order_by=order)


@query(
    "export_info",
    """SELECT count(*) AS row_count, 3 AS column_count,
    CAST(sum(strlen(CAST(doc_id AS VARCHAR)) + strlen(CAST(quality AS VARCHAR)) + strlen(CAST(toxic AS VARCHAR)) + 3)
        + strlen('doc_id,quality,toxic') + 1 AS BIGINT) AS csv_bytes,
    'doc_id bigint, quality int, toxic int' AS columns FROM labels""",
)
def _(spark, folder):
    return export_info(table(spark, folder, "labels"))


@query(
    "export_columns",
    f"""SELECT o_orderkey, o_custkey, o_totalprice,
    CAST(floor(epoch(o_orderdate - min(o_orderdate) OVER (PARTITION BY o_custkey)) / 86400) AS BIGINT) AS opportunity_age_days,
    o_orderstatus, o_orderdate, o_orderpriority, c_mktsegment FROM ({ORDERS_SQL})""",
)
def _(spark, folder):
    df = add_features(order_snapshots(spark, folder), ORDERS_ROLES, ["opportunity_age_days"])
    return order_columns(df, ["o_orderkey", "o_custkey", "o_totalprice"], ["opportunity_age_days", "no_such_column"])


WORK_FILTERS = [CategoricalFilter("event_type", ["signup"], "exclude"), NumericFilter("value", "greater_than", low=1.0)]
WORK_SPEC = OutlierSpec(["value"], "iqr", "moderate")
WORK_SQL = f"""kept AS (SELECT * FROM ({EVENTS_SQL}) WHERE event_type <> 'signup' AND value > 1.0),
    fence AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM kept),
    working AS (SELECT kept.* FROM kept, fence
        WHERE NOT (value < q1 - 2.0 * (q3 - q1) OR value > q3 + 2.0 * (q3 - q1)))"""


@query(
    "analysis_run",
    f"""WITH {WORK_SQL}
    SELECT event_id, user_id, event_type, value,
        CAST(floor(epoch(max(ts) OVER w - min(ts) OVER w) / 86400) AS BIGINT) AS days_in_pipeline,
        first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS final_stage
    FROM working WINDOW w AS (PARTITION BY user_id)""",
)
def _(spark, folder):
    plan = Analysis(EVENT_ROLES, WORK_FILTERS, WORK_SPEC, ["days_in_pipeline", "final_stage"])
    df = plan.run(event_snapshots(spark, folder))
    return df.select("event_id", "user_id", "event_type", "value", "days_in_pipeline", "final_stage")


@query(
    "summary",
    f"""WITH {WORK_SQL},
    o AS (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM working) AS out FROM kept),
    c AS (SELECT event_type AS v, count(*) AS n FROM working GROUP BY 1),
    k AS (SELECT k AS v, count(*) AS n FROM working WHERE k IS NOT NULL GROUP BY 1)
    SELECT section, item, metric, round(value, 6) AS value, text FROM (
    SELECT 'data' AS section, NULL AS item, 'records' AS metric, count(*)::DOUBLE AS value, NULL AS text FROM working
    UNION ALL SELECT 'data', NULL, 'columns', 3, NULL
    UNION ALL SELECT 'filters', 'event_type', 'CategoricalFilter', NULL, 'exclude: signup'
    UNION ALL SELECT 'filters', 'value', 'NumericFilter', NULL, 'greater_than: low=1.0'
    UNION ALL SELECT 'outliers', NULL, 'excluded_rows', out, NULL FROM o
    UNION ALL SELECT 'outliers', NULL, 'exclusion_pct', 100.0 * out / n, NULL FROM o
    UNION ALL SELECT 'outliers', NULL, 'method', NULL, 'iqr'
    UNION ALL SELECT 'outliers', NULL, 'sensitivity', NULL, 'moderate'
    UNION ALL SELECT 'outliers', NULL, 'columns', NULL, 'value'
    UNION ALL SELECT 'outliers', NULL, 'combination', NULL, 'any'
    UNION ALL SELECT 'outliers', 'value', 'outliers', out, NULL FROM o
    UNION ALL SELECT 'outliers', 'value', 'pct', 100.0 * out / n, NULL FROM o
    UNION ALL SELECT 'columns', x.item, 'type', NULL, x.type
        FROM (VALUES ('event_type', 'categorical'), ('value', 'numerical'), ('ts', 'date')) x(item, type)
    UNION ALL SELECT 'columns', x.item, m, CASE m WHEN 'count' THEN (SELECT count(*) FROM working) ELSE 0 END, NULL
        FROM (VALUES ('event_type'), ('value'), ('ts')) x(item), (VALUES ('count'), ('missing'), ('missing_pct')) y(m)
    UNION ALL SELECT 'columns', 'value', 'mean', avg(value), NULL FROM working
    UNION ALL SELECT 'columns', 'value', 'median', quantile_cont(value, 0.5), NULL FROM working
    UNION ALL SELECT 'columns', 'value', 'std', stddev_samp(value), NULL FROM working
    UNION ALL SELECT 'columns', 'value', 'min', min(value), NULL FROM working
    UNION ALL SELECT 'columns', 'value', 'max', max(value), NULL FROM working
    UNION ALL SELECT 'columns', 'event_type', 'distinct', count(*), NULL FROM c
    UNION ALL (SELECT 'columns', 'event_type', 'mode', n, v FROM c ORDER BY n DESC, v LIMIT 1)
    UNION ALL SELECT 'columns', 'ts', 'earliest', NULL, strftime(min(ts), '%Y-%m-%d %H:%M:%S') FROM working
    UNION ALL SELECT 'columns', 'ts', 'latest', NULL, strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM working
    UNION ALL SELECT 'columns', 'ts', 'range_days', floor(epoch(max(ts) - min(ts)) / 86400), NULL FROM working)""",
)
def _(spark, folder):
    df = event_snapshots(spark, folder).select("event_type", "value", "ts")
    types = {"event_type": Semantic.CATEGORICAL, "value": Semantic.NUMERICAL, "ts": Semantic.DATE}
    return tidy(summary(df, types, WORK_FILTERS, WORK_SPEC))
