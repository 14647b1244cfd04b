"""Table bindings, SQL fragments and the registration decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplens.operators.skew import lookup_join
from snaplens.roles import Roles
from snaplens.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is left out where SQL cannot express it."""

    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(configure(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tidy(df: DataFrame, **digits: int) -> DataFrame:
    """Round doubles (6 places unless named) so that summation order does not show."""
    return df.select(*[
        F.round(F.col(f.name), digits.get(f.name, 6)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType)
        else F.col(f.name)
        for f in df.schema
    ])


def with_nan(events: DataFrame) -> DataFrame:
    """Every seventh event's value becomes NaN."""
    return events.withColumn("value", F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value")))


# Orders as snapshots of their customer; the market segment owns it.
ORDERS_ROLES = Roles(
    id="o_custkey", snapshot="o_orderdate", stage="o_orderstatus", owner="c_mktsegment",
    tie=("o_orderkey",), stages=("F", "O"), won=("F",), lost=("O",),
)
ORDERS_SQL = "SELECT o.*, c.c_mktsegment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey"


def order_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """The lookup leaves the rows unpartitioned by customer when one of them is hot, so the
    reductions that follow can still limit map-side."""
    return with_segment(spark, folder, table(spark, folder, "orders"))


def with_segment(spark: SparkSession, folder: str, orders: DataFrame) -> DataFrame:
    owner = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment"
    )
    return lookup_join(orders, owner, ["o_custkey"])


# Events as snapshots of their user; the key inside ``props`` owns the event.
EVENT_ROLES = Roles(
    id="user_id", snapshot="ts", stage="event_type", owner="k", tie=("event_id",),
    stages=("view", "signup", "click"), won=("purchase",), lost=("error",),
)
EVENTS_SQL = "SELECT event_id, ts, user_id, event_type, value, json_extract_string(props, '$.k') AS k FROM events"


def event_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").alias("k")
    )


# Line items as snapshots of their order; the supplier owns them.
LINE_ROLES = Roles(
    id="l_orderkey", snapshot="l_shipdate", stage="l_returnflag", owner="l_suppkey",
    tie=("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), won=("R",), lost=("A",),
)
LINE_TIE = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"

# Line items of a part, created with their order and shipped later.
PART_ROLES = Roles(
    id="l_partkey", snapshot="l_shipdate", stage="l_returnflag", owner="l_suppkey",
    tie=("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"), won=("R",), lost=("A",),
)
PARTS_SQL = (
    "SELECT l.l_partkey, l.l_shipdate, l.l_returnflag, l.l_suppkey, l.l_orderkey, l.l_linenumber, "
    "l.l_extendedprice, l.l_quantity, o.o_orderdate FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey"
)


def part_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    created = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return table(spark, folder, "lineitem").join(created, "l_orderkey", "left").select(
        "l_partkey", "l_shipdate", "l_returnflag", "l_suppkey", "l_orderkey", "l_linenumber",
        "l_extendedprice", "l_quantity", "o_orderdate",
    )


def latest_sql(rows: str, key: str, snapshot: str, tie: str) -> str:
    return (
        f"SELECT * FROM ({rows}) WHERE {key} IS NOT NULL AND {snapshot} IS NOT NULL "
        f"QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {snapshot} DESC, {tie}) = 1"
    )


LATEST_ORDERS = latest_sql(ORDERS_SQL, "o_custkey", "o_orderdate", "o_orderkey")
LATEST_EVENTS = latest_sql(EVENTS_SQL, "user_id", "ts", "event_id")
LATEST_LINES = latest_sql("SELECT * FROM lineitem", "l_orderkey", "l_shipdate", LINE_TIE)


def days_sql(later: str, earlier: str) -> str:
    return f"CAST(floor(epoch({later} - {earlier}) / 86400) AS BIGINT)"
