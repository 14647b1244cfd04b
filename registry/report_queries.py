"""The eight report tables and the histogram limit helper."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import (
    EVENT_ROLES,
    EVENTS_SQL,
    LATEST_EVENTS,
    LATEST_LINES,
    LATEST_ORDERS,
    LINE_ROLES,
    ORDERS_ROLES,
    PART_ROLES,
    PARTS_SQL,
    event_snapshots,
    order_snapshots,
    part_snapshots,
    query,
    table,
    tidy,
    with_nan,
)
from registry.profiling import ORDER_TYPES, stats_sql
from snaplens import (
    bar_chart,
    box_plot,
    correlation_matrix,
    descriptive_statistics,
    histogram,
    line_chart,
    scatter_plot,
    time_series,
    upper_limit_options,
)

DESCRIBED = (
    '"column", type, count, non_null, missing, missing_pct, mean, median, std, min, max, skew, kurt, '
    """CASE WHEN type = 'categorical' THEN "distinct" END AS "distinct", mode, mode_count, earliest, latest, range_days"""
)


@query("rpt_describe", f"SELECT {DESCRIBED} FROM ({stats_sql(f'({LATEST_ORDERS})', {**ORDER_TYPES, 'c_mktsegment': 'categorical'})})")
def _(spark, folder):
    df = descriptive_statistics(order_snapshots(spark, folder), ORDERS_ROLES, sort_by="column_name")
    return tidy(df, std=4)


GROUPED_TYPES = {k: ORDER_TYPES[k] for k in ("o_totalprice", "o_orderdate", "o_orderpriority")}


@query(
    "rpt_describe_grouped",
    f'SELECT "group", {DESCRIBED} FROM ({stats_sql(f"({LATEST_ORDERS})", GROUPED_TYPES, "c_mktsegment")})',
)
def _(spark, folder):
    df = descriptive_statistics(
        order_snapshots(spark, folder), ORDERS_ROLES, list(GROUPED_TYPES), "c_mktsegment", "count_descending"
    )
    return tidy(df, std=4)


def hist_sql(latest, x, bins, limit=None, group=None):
    v = f"CASE WHEN {x} > {limit} THEN {limit} ELSE {x} END" if limit else x
    above = f"{x} > {limit}" if limit else "false"
    g = f'CAST({group} AS VARCHAR) AS "group", ' if group else ""
    gk = '"group", ' if group else ""
    kept = f"AND {group} IS NOT NULL" if group else ""
    return f"""WITH r AS (SELECT {g}CAST({v} AS DOUBLE) AS v, {above} AS above FROM ({latest}) WHERE {x} IS NOT NULL {kept}),
    e AS (SELECT min(v) AS a, (max(v) - min(v)) / {bins} AS w FROM r),
    b AS (SELECT {gk}a, w, above, CASE WHEN w = 0 THEN 1
        ELSE least(CAST(floor((v - a) / w) AS INT) + 1, {bins}) END AS bin FROM r, e)
    SELECT {gk}bin, round(a + (bin - 1) * w, 6) AS lo, round(a + bin * w, 6) AS hi, count(*) AS count,
        count(*) FILTER (above) AS above_limit FROM b GROUP BY ALL"""


@query("rpt_hist", hist_sql(LATEST_ORDERS, "o_totalprice", 30))
def _(spark, folder):
    return tidy(histogram(order_snapshots(spark, folder), ORDERS_ROLES, "o_totalprice"))


@query("rpt_hist_grouped", hist_sql(LATEST_ORDERS, "o_totalprice", 12, group="c_mktsegment"))
def _(spark, folder):
    return tidy(histogram(order_snapshots(spark, folder), ORDERS_ROLES, "o_totalprice", 12, group_by="c_mktsegment"))


@query("rpt_hist_capped", hist_sql(LATEST_EVENTS, "value", 20, limit=120.0))
def _(spark, folder):
    return tidy(histogram(event_snapshots(spark, folder), EVENT_ROLES, "value", 20, upper_limit=120.0))


NAN_EVENTS = f"SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN value END AS value) FROM ({LATEST_EVENTS})"


@query("rpt_hist_nan", hist_sql(f"SELECT * FROM ({NAN_EVENTS}) WHERE value IS NOT NULL", "value", 20))
def _(spark, folder):
    return tidy(histogram(with_nan(event_snapshots(spark, folder)), EVENT_ROLES, "value", 20))


@query(
    "rpt_hist_date",
    f"""WITH r AS (SELECT CAST(epoch(o_orderdate) AS DOUBLE) AS v FROM ({LATEST_ORDERS})),
    e AS (SELECT min(v) AS a, (max(v) - min(v)) / 10 AS w FROM r),
    b AS (SELECT a, w, least(CAST(floor((v - a) / w) AS INT) + 1, 10) AS bin FROM r, e)
    SELECT bin, CAST(make_timestamp(CAST(round((a + (bin - 1) * w) * 1000000) AS BIGINT)) AS TIMESTAMP) AS lo,
        CAST(make_timestamp(CAST(round((a + bin * w) * 1000000) AS BIGINT)) AS TIMESTAMP) AS hi,
        count(*) AS count, 0::BIGINT AS above_limit FROM b GROUP BY ALL""",
)
def _(spark, folder):
    return histogram(order_snapshots(spark, folder), ORDERS_ROLES, "o_orderdate", 10)


@query(
    "rpt_upper_limit",
    """SELECT min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.95), 6) AS p95,
    round(quantile_cont(value, 0.99), 6) AS p99 FROM events""",
)
def _(spark, folder):
    return tidy(upper_limit_options(event_snapshots(spark, folder), "value"))


SQL_AGGREGATES = {
    "sum": "round(coalesce(sum({y}), 0), 2)", "mean": "round(avg({y}), 6)", "count": "count({y})",
    "median": "round(quantile_cont({y}, 0.5), 6)", "min": "min({y})", "max": "max({y})",
}


def _bar(how, sort_by):
    value = SQL_AGGREGATES[how].format(y="o_totalprice")

    @query(
        f"rpt_bar_{how}",
        f"SELECT c_mktsegment, {value} AS value FROM ({LATEST_ORDERS}) WHERE c_mktsegment IS NOT NULL GROUP BY 1",
    )
    def _(spark, folder):
        df = bar_chart(
            order_snapshots(spark, folder), ORDERS_ROLES, "c_mktsegment", "o_totalprice", how, sort_by=sort_by
        )
        return tidy(df, value=2 if how == "sum" else 6)


for _how, _order in (
    ("sum", "value_descending"), ("mean", "value_ascending"), ("count", "category_name"),
    ("median", "none"), ("min", "none"), ("max", "none"),
):
    _bar(_how, _order)


@query(
    "rpt_bar_grouped",
    f"""SELECT CAST(c_mktsegment AS VARCHAR) AS "group", o_orderpriority, round(sum(o_totalprice), 2) AS value
    FROM ({LATEST_ORDERS}) WHERE c_mktsegment IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY ALL""",
)
def _(spark, folder):
    df = bar_chart(
        order_snapshots(spark, folder), ORDERS_ROLES, "o_orderpriority", "o_totalprice", group_by="c_mktsegment",
        sort_by="value_descending",
    )
    return tidy(df, value=2)


@query(
    "rpt_bar_gaps",
    f"""SELECT k, round(coalesce(median(CASE WHEN value > 80 THEN value END), 0), 6) AS value
    FROM ({LATEST_EVENTS}) WHERE k IS NOT NULL GROUP BY 1""",
)
def _(spark, folder):
    df = event_snapshots(spark, folder)
    df = df.withColumn("value", F.when(F.col("value") > 80, F.col("value")))
    return tidy(bar_chart(df, EVENT_ROLES, "k", "value", "median"))


@query("rpt_bar_empty", "SELECT event_type, value FROM events WHERE false")
def _(spark, folder):
    df = event_snapshots(spark, folder).withColumn("value", F.when(F.col("value") < 0, F.col("value")))
    return bar_chart(df, EVENT_ROLES, "event_type", "value", "mean")


@query("rpt_scatter", f"SELECT l_quantity AS x, l_extendedprice AS y FROM ({LATEST_LINES})")
def _(spark, folder):
    return scatter_plot(table(spark, folder, "lineitem"), LINE_ROLES, "l_quantity", "l_extendedprice")


@query(
    "rpt_scatter_sized",
    f"""SELECT l_returnflag AS "group", l_quantity AS x, l_extendedprice AS y, l_tax AS size,
    round(2.0 * max(l_tax) OVER (PARTITION BY l_returnflag) / 1600, 6) AS size_ref FROM ({LATEST_LINES})""",
)
def _(spark, folder):
    df = table(spark, folder, "lineitem")
    return tidy(scatter_plot(df, LINE_ROLES, "l_quantity", "l_extendedprice", "l_returnflag", "l_tax"))


@query(
    "rpt_scatter_sized_plain",
    f"""SELECT o_orderdate AS x, o_totalprice AS y, o_totalprice AS size,
    round(2.0 * max(o_totalprice) OVER () / 1600, 6) AS size_ref FROM ({LATEST_ORDERS})""",
)
def _(spark, folder):
    df = order_snapshots(spark, folder)
    return tidy(scatter_plot(df, ORDERS_ROLES, "o_orderdate", "o_totalprice", size="o_totalprice"))


@query(
    "rpt_line",
    f"SELECT l_shipdate, round(avg(l_quantity), 6) AS value FROM ({LATEST_LINES}) GROUP BY 1",
)
def _(spark, folder):
    return tidy(line_chart(table(spark, folder, "lineitem"), LINE_ROLES, "l_shipdate", "l_quantity"))


@query(
    "rpt_line_grouped",
    f"""SELECT l_returnflag AS "group", l_quantity, round(quantile_cont(l_extendedprice, 0.5), 6) AS value
    FROM ({LATEST_LINES}) WHERE l_returnflag IS NOT NULL GROUP BY ALL""",
)
def _(spark, folder):
    df = table(spark, folder, "lineitem")
    return tidy(line_chart(df, LINE_ROLES, "l_quantity", "l_extendedprice", "median", "l_returnflag"))


def corr_sql(rows, columns):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS r FROM r"
        for a in columns
        for b in columns
    ).join([f"WITH r AS ({rows}) ", ""])


CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "late"]


@query("rpt_corr", corr_sql(f"SELECT *, l_shipdate > TIMESTAMP '1999-01-01' AS late FROM ({LATEST_LINES})", CORRELATED))
def _(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("late", F.col("l_shipdate") > F.lit("1999-01-01").cast("timestamp_ntz"))
    return tidy(correlation_matrix(df, LINE_ROLES, CORRELATED))


@query(
    "rpt_corr_gaps",
    f"""WITH r AS (SELECT CASE WHEN value > 10 THEN value END AS a, CASE WHEN event_type <> 'view' THEN user_id END AS b,
        7 AS c FROM ({LATEST_EVENTS})),
    p AS (SELECT corr(a, b) AS ab FROM r)
    SELECT x AS col_a, y AS col_b, round(CASE WHEN x = 'c' OR y = 'c' THEN NULL WHEN x = y THEN 1.0 ELSE ab END, 6) AS r
    FROM p, (VALUES ('a'), ('b'), ('c')) s(x), (VALUES ('a'), ('b'), ('c')) t(y)""",
)
def _(spark, folder):
    df = event_snapshots(spark, folder).select(
        "user_id", "ts", "event_id",
        F.when(F.col("value") > 10, F.col("value")).alias("a"),
        F.when(F.col("event_type") != "view", F.col("user_id")).alias("b"),
        F.lit(7).alias("c"),
    )
    return tidy(correlation_matrix(df, EVENT_ROLES, ["a", "b", "c"]))


def box_sql(rows, x, y):
    return f"""WITH r AS (SELECT CAST({x} AS VARCHAR) AS category, CAST({y} AS DOUBLE) AS v FROM ({rows})
        WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
    q AS (SELECT category, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
        FROM r GROUP BY 1),
    j AS (SELECT r.*, q1, median, q3, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
        FROM r JOIN q USING (category))
    SELECT category, count(*) AS count, round(avg(v), 6) AS mean, round(any_value(q1), 6) AS q1,
        round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, min(v) FILTER (inside) AS lo_whisker,
        max(v) FILTER (inside) AS hi_whisker, count(*) FILTER (NOT inside) AS n_outliers FROM j GROUP BY 1"""


@query("rpt_box", box_sql(LATEST_ORDERS, "c_mktsegment", "o_totalprice"))
def _(spark, folder):
    df = box_plot(order_snapshots(spark, folder), ORDERS_ROLES, "c_mktsegment", "o_totalprice", "value_descending")
    return tidy(df)


@query("rpt_box_events", box_sql(LATEST_EVENTS, "event_type", "value"))
def _(spark, folder):
    return tidy(box_plot(event_snapshots(spark, folder), EVENT_ROLES, "event_type", "value"))


UNITS = {
    "D": ("day", "s"), "W": ("week", "s + INTERVAL 6 DAY"), "M": ("month", "last_day(s)"),
    "Q": ("quarter", "last_day(s + INTERVAL 2 MONTH)"), "Y": ("year", "last_day(s + INTERVAL 11 MONTH)"),
}
STEPS = {"D": "1 DAY", "W": "7 DAY", "M": "1 MONTH", "Q": "3 MONTH", "Y": "12 MONTH"}


def series_sql(rows, x, key, snapshot, tie, y, period, how, group=None):
    unit, end = UNITS[period]
    value = SQL_AGGREGATES[how].format(y=y)
    gap = "coalesce(value, 0)" if how in ("sum", "count") else "value"
    g, gk, on = (f'CAST({group} AS VARCHAR) AS "group", ', '"group", ', '"group", s') if group else ("", "", "s")
    kept = f"AND {group} IS NOT NULL" if group else ""
    return f"""WITH d AS (SELECT *, CAST(date_trunc('{unit}', {x}) AS TIMESTAMP) AS s FROM ({rows})
        WHERE {x} IS NOT NULL AND {key} IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY date_trunc('{unit}', {x}), {key} ORDER BY {snapshot} DESC NULLS LAST, {tie}) = 1),
    a AS (SELECT {g}s, {value} AS value FROM d WHERE true {kept} GROUP BY ALL),
    e AS (SELECT {gk}unnest(generate_series(min(s), max(s), INTERVAL {STEPS[period]})) AS s FROM a {'GROUP BY "group"' if group else ''})
    SELECT {gk}CAST({end} AS TIMESTAMP) AS period_end, {gap} AS value FROM e LEFT JOIN a USING ({on})"""


def _series(name, period, how, group=None, y="l_extendedprice"):
    sql = series_sql(
        PARTS_SQL, "o_orderdate", "l_partkey", "l_shipdate", "l_orderkey, l_linenumber, l_suppkey, l_extendedprice",
        y, period, how, group,
    )

    @query(name, sql)
    def _(spark, folder):
        df = time_series(
            part_snapshots(spark, folder), PART_ROLES, "o_orderdate", y, period, how, group
        )
        return tidy(df, value=2 if how == "sum" else 6)


_series("rpt_ts_d", "D", "sum")
_series("rpt_ts_w", "W", "count")
_series("rpt_ts_m", "M", "sum")
_series("rpt_ts_q", "Q", "median")
_series("rpt_ts_y", "Y", "max")
_series("rpt_ts_grouped", "M", "mean", "l_returnflag", "l_quantity")


@query(
    "rpt_ts_gaps",
    series_sql(EVENTS_SQL, "ts", "user_id", "ts", "event_id", "value", "D", "sum", "user_id"),
)
def _(spark, folder):
    """A user has events on few days, so that most of their days are gaps."""
    return tidy(time_series(event_snapshots(spark, folder), EVENT_ROLES, "ts", "value", "D", "sum", "user_id"), value=2)


@query("rpt_bar_nan", f"SELECT k, round(coalesce(sum(value), 0), 2) AS value FROM ({NAN_EVENTS}) WHERE k IS NOT NULL GROUP BY 1")
def _(spark, folder):
    return tidy(bar_chart(with_nan(event_snapshots(spark, folder)), EVENT_ROLES, "k", "value", "sum"), value=2)


@query("rpt_bar_median_nan", f"SELECT event_type, round(quantile_cont(value, 0.5), 6) AS value FROM ({NAN_EVENTS}) GROUP BY 1")
def _(spark, folder):
    return tidy(bar_chart(with_nan(event_snapshots(spark, folder)), EVENT_ROLES, "event_type", "value", "median"))


@query("rpt_line_nan", f"SELECT user_id, round(avg(value), 6) AS value FROM ({NAN_EVENTS}) GROUP BY 1")
def _(spark, folder):
    return tidy(line_chart(with_nan(event_snapshots(spark, folder)), EVENT_ROLES, "user_id", "value", "mean"))


@query("rpt_box_nan", box_sql(NAN_EVENTS, "event_type", "value"))
def _(spark, folder):
    return tidy(box_plot(with_nan(event_snapshots(spark, folder)), EVENT_ROLES, "event_type", "value"))


@query("rpt_corr_nan", corr_sql(NAN_EVENTS, ["value", "user_id"]))
def _(spark, folder):
    return tidy(correlation_matrix(with_nan(event_snapshots(spark, folder)), EVENT_ROLES, ["value", "user_id"]))


@query(
    "rpt_ts_nan",
    series_sql(
        f"SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN value END AS value) FROM ({EVENTS_SQL})",
        "ts", "user_id", "ts", "event_id", "value", "D", "sum",
    ),
)
def _(spark, folder):
    return tidy(time_series(with_nan(event_snapshots(spark, folder)), EVENT_ROLES, "ts", "value", "D", "sum"), value=2)
