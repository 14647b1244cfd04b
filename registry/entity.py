"""Snapshot reduction and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import (
    EVENT_ROLES,
    EVENTS_SQL,
    LATEST_ORDERS,
    LINE_ROLES,
    LINE_TIE,
    ORDERS_ROLES,
    ORDERS_SQL,
    PART_ROLES,
    PARTS_SQL,
    days_sql,
    event_snapshots,
    latest_sql,
    order_snapshots,
    part_snapshots,
    query,
    table,
    tidy,
    with_segment,
)
from snaplens import add_features, first_snapshot, latest_per_period, latest_snapshot, register_feature
from snaplens.operators.skew import lookup_join

ORDER_KEYS = ["o_orderkey", "o_custkey"]
EVENT_KEYS = ["event_id", "user_id"]
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("latest_snapshot", LATEST_ORDERS)
def _(spark, folder):
    # Reduced first: the segment is looked up for one row per customer.
    return with_segment(spark, folder, latest_snapshot(table(spark, folder, "orders"), ORDERS_ROLES))


@query(
    "latest_snapshot_text_dates",
    f"""SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%m/%d/%Y') AS o_orderdate FROM (
    {latest_sql("SELECT o_orderkey, o_custkey, date_trunc('day', o_orderdate) AS o_orderdate FROM orders", "o_custkey", "o_orderdate", "o_orderkey")})""",
)
def _(spark, folder):
    text = F.date_format("o_orderdate", "MM/dd/yyyy").alias("o_orderdate")
    return latest_snapshot(table(spark, folder, "orders").select("o_orderkey", "o_custkey", text), ORDERS_ROLES)


@query(
    "latest_snapshot_by_month",
    f"""SELECT * REPLACE (CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS o_orderdate) FROM ({ORDERS_SQL})
    WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY date_trunc('month', o_orderdate), o_custkey
                               ORDER BY o_orderdate DESC, o_orderkey) = 1""",
)
def _(spark, folder):
    return latest_per_period(order_snapshots(spark, folder), ORDERS_ROLES, "o_orderdate", "M")


@query(
    "latest_snapshot_by_created_quarter",
    f"""SELECT * REPLACE (CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS o_orderdate) FROM ({PARTS_SQL})
    WHERE l_partkey IS NOT NULL AND o_orderdate IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY date_trunc('quarter', o_orderdate), l_partkey
        ORDER BY l_shipdate DESC NULLS LAST, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) = 1""",
)
def _(spark, folder):
    return latest_per_period(part_snapshots(spark, folder), PART_ROLES, "o_orderdate", "Q")


@query(
    "first_snapshot",
    f"""SELECT * FROM ({EVENTS_SQL}) WHERE user_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts ASC NULLS LAST, event_id) = 1""",
)
def _(spark, folder):
    return first_snapshot(event_snapshots(spark, folder), EVENT_ROLES)


def order_feature(name):
    def build(spark, folder):
        df = add_features(order_snapshots(spark, folder), ORDERS_ROLES, [name])
        return tidy(df.select(*ORDER_KEYS, name))

    return build


def event_feature(name):
    def build(spark, folder):
        df = add_features(event_snapshots(spark, folder), EVENT_ROLES, [name])
        return tidy(df.select(*EVENT_KEYS, name))

    return build


FIRST_AT, LAST_AT = "min(o_orderdate) OVER w", "max(o_orderdate) OVER w"
PER_CUSTOMER = f"FROM ({ORDERS_SQL}) WINDOW w AS (PARTITION BY o_custkey)"
FINAL_EVENT = """first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""

query(
    "feat_span_days",
    f"SELECT o_orderkey, o_custkey, {days_sql(LAST_AT, FIRST_AT)} AS days_in_pipeline {PER_CUSTOMER}",
)(order_feature("days_in_pipeline"))

query(
    "feat_days_to_close_won",
    f"""SELECT event_id, user_id, {days_sql("min(CASE WHEN event_type = 'purchase' THEN ts END) OVER w", "min(ts) OVER w")}
    AS days_to_close_won FROM ({EVENTS_SQL}) WINDOW w AS (PARTITION BY user_id)""",
)(event_feature("days_to_close_won"))

query(
    "feat_starting_stage",
    f"""SELECT o_orderkey, o_custkey, first_value(o_orderstatus) OVER (PARTITION BY o_custkey
    ORDER BY o_orderdate, o_orderkey) AS starting_stage FROM ({ORDERS_SQL})""",
)(order_feature("starting_stage"))

query(
    "feat_final_stage",
    f"""SELECT o_orderkey, o_custkey, first_value(o_orderstatus) OVER (PARTITION BY o_custkey
    ORDER BY o_orderdate DESC, o_orderkey) AS final_stage FROM ({ORDERS_SQL})""",
)(order_feature("final_stage"))

query(
    "feat_age_days",
    f"""SELECT event_id, user_id, {days_sql("ts", "min(ts) OVER w")} AS opportunity_age_days
    FROM ({EVENTS_SQL}) WINDOW w AS (PARTITION BY user_id)""",
)(event_feature("opportunity_age_days"))

query(
    "feat_stage_count",
    """SELECT o_orderkey, o.o_custkey, stage_progression_count FROM orders o JOIN (
    SELECT o_custkey, count(DISTINCT o_orderstatus) AS stage_progression_count FROM orders GROUP BY 1) s
    ON o.o_custkey = s.o_custkey""",
)(order_feature("stage_progression_count"))


def step_sql(rows, key, snapshot, stage, tie, select):
    return f"""WITH p AS (SELECT *, lag({stage}) OVER w AS before_stage, lag({snapshot}) OVER w AS before_at,
        row_number() OVER w AS place FROM ({rows})
        WINDOW w AS (PARTITION BY {key} ORDER BY {snapshot} NULLS LAST, {tie}))
    SELECT {select}, CASE WHEN place = 1 THEN 0 WHEN {stage} <> before_stage THEN 0
        ELSE greatest(0, {days_sql(snapshot, "before_at")}) END::BIGINT AS days_in_current_stage FROM p"""


query(
    "feat_days_in_stage",
    step_sql(EVENTS_SQL, "user_id", "ts", "event_type", "event_id", "event_id, user_id"),
)(event_feature("days_in_current_stage"))


@query(
    "feat_days_in_stage_lines",
    step_sql("SELECT * FROM lineitem", "l_orderkey", "l_shipdate", "l_returnflag", LINE_TIE, ", ".join(LINE_KEYS)),
)
def _(spark, folder):
    df = add_features(table(spark, folder, "lineitem"), LINE_ROLES, ["time_in_stages"])
    return df.select(*LINE_KEYS, "days_in_current_stage")


def win_rate_sql(rows, key, snapshot, stage, owner, tie, won, lost):
    return f"""WITH b AS ({rows}),
    owned AS (SELECT {key}, {owner} FROM b WHERE {key} IS NOT NULL AND {owner} IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {snapshot} NULLS LAST, {tie}) = 1),
    final AS (SELECT {key}, {stage} AS stage FROM b
        WHERE {key} IS NOT NULL AND {snapshot} IS NOT NULL AND {stage} IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {snapshot} DESC, {tie}) = 1),
    rates AS (SELECT {owner}, coalesce(100.0 * count(*) FILTER (stage = '{won}')
            / nullif(count(*) FILTER (stage IN ('{won}', '{lost}')), 0), 0) AS user_win_rate
        FROM owned JOIN final USING ({key}) WHERE trim(CAST({owner} AS VARCHAR)) <> '' GROUP BY 1)
    """


query(
    "feat_win_rate",
    win_rate_sql(ORDERS_SQL, "o_custkey", "o_orderdate", "o_orderstatus", "c_mktsegment", "o_orderkey", "F", "O")
    + """SELECT o_orderkey, o_custkey, round(user_win_rate, 6) AS user_win_rate
    FROM b LEFT JOIN rates USING (c_mktsegment)""",
)(order_feature("user_win_rate"))

query(
    "feat_win_rate_events",
    win_rate_sql(EVENTS_SQL, "user_id", "ts", "event_type", "k", "event_id", "purchase", "error")
    + """SELECT event_id, user_id, round(user_win_rate, 6) AS user_win_rate FROM b LEFT JOIN rates USING (k)""",
)(event_feature("user_win_rate"))


def activity_sql(rows, key, snapshot, owner, select):
    return f"""WITH b AS ({rows}),
    monthly AS (SELECT {owner}, date_trunc('month', {snapshot}) AS m, count(DISTINCT {key}) AS n FROM b
        WHERE {key} IS NOT NULL AND {snapshot} IS NOT NULL AND {owner} IS NOT NULL GROUP BY ALL),
    owners AS (SELECT {owner}, avg(n) AS mean FROM monthly GROUP BY 1),
    cuts AS (SELECT quantile_cont(mean, 0.33) AS low, quantile_cont(mean, 0.67) AS high, count(*) AS n FROM owners),
    rated AS (SELECT {owner}, CASE WHEN n < 3 THEN 'Unknown' WHEN mean <= low THEN 'Low'
        WHEN mean <= high THEN 'Medium' ELSE 'High' END AS rating FROM owners, cuts)
    SELECT {select}, coalesce(rating, 'Unknown') AS user_activity_rating FROM b LEFT JOIN rated USING ({owner})"""


query(
    "feat_activity",
    activity_sql(ORDERS_SQL, "o_custkey", "o_orderdate", "c_mktsegment", "o_orderkey, o_custkey"),
)(order_feature("user_activity_rating"))

query(
    "feat_activity_events",
    activity_sql(EVENTS_SQL, "user_id", "ts", "k", "event_id, user_id"),
)(event_feature("user_activity_rating"))

FUSED = [
    "days_in_pipeline", "days_to_close_won", "starting_stage", "final_stage",
    "days_in_current_stage", "opportunity_age_days", "stage_progression_count",
]


@query(
    "feat_all_entity",
    f"""WITH b AS ({EVENTS_SQL}),
    s AS (SELECT user_id, count(DISTINCT event_type) AS stage_progression_count FROM b GROUP BY 1),
    p AS (SELECT b.*, stage_progression_count, min(ts) OVER w AS first_at, max(ts) OVER w AS last_at,
        min(CASE WHEN event_type = 'purchase' THEN ts END) OVER w AS won_at,
        first_value(event_type) OVER o AS starting_stage, {FINAL_EVENT} AS final_stage,
        lag(event_type) OVER o AS before_stage, lag(ts) OVER o AS before_at, row_number() OVER o AS place
        FROM b JOIN s USING (user_id)
        WINDOW w AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, {days_sql("last_at", "first_at")} AS days_in_pipeline,
        {days_sql("won_at", "first_at")} AS days_to_close_won, starting_stage, final_stage,
        CASE WHEN place = 1 OR event_type <> before_stage THEN 0
            ELSE greatest(0, {days_sql("ts", "before_at")}) END::BIGINT AS days_in_current_stage,
        {days_sql("ts", "first_at")} AS opportunity_age_days, stage_progression_count FROM p""",
)
def _(spark, folder):
    return add_features(event_snapshots(spark, folder), EVENT_ROLES, FUSED).select(*EVENT_KEYS, *FUSED)


def _value_share(df, roles):
    """A feature of one's own: the row's value against the largest of its stage."""
    top = df.groupBy(roles.stage).agg(F.max("value").alias("top"))
    joined = lookup_join(df, top, [roles.stage])
    return joined.withColumn("value_share", F.col("value") / F.col("top")).drop("top")


@query(
    "feat_custom",
    """SELECT event_id, user_id, round(value / max(value) OVER (PARTITION BY event_type), 6) AS value_share
    FROM events""",
)
def _(spark, folder):
    register_feature("value_share", _value_share, ("stage", "value"), description="value over the stage's largest")
    df = add_features(event_snapshots(spark, folder), EVENT_ROLES, ["value_share", "no_such_feature"])
    return tidy(df.select(*EVENT_KEYS, "value_share"))
