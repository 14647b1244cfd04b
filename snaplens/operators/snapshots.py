"""Reducing a snapshot table to one row per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplens.functions.dates import period_start
from snaplens.operators.semantics import parse_date
from snaplens.roles import Roles, col


def first_per_key(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    ``row_number() = 1`` plans a group limit before the exchange, so each map task
    sends at most one row per key however many rows a key has.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(ranked)).filter("__rank = 1").drop("__rank")


def moment(df: DataFrame, name: str) -> Column:
    """The column as a point in time: texts are parsed, and null where they are no date."""
    return parse_date(col(name)) if isinstance(df.schema[name].dataType, T.StringType) else col(name)


def latest_snapshot(df: DataFrame, roles: Roles) -> DataFrame:
    """Latest snapshot per id; the tie columns, ascending, decide between equal dates.

    Rows without id or date drop out. Dates written as text are compared as dates and
    stay text. Without an id or snapshot column the table is returned as it is.
    """
    r = roles.bind(df)
    if r.missing(("id", "snapshot")):
        return df
    at = moment(df, r.snapshot)
    dated = df.filter(col(r.id).isNotNull() & at.isNotNull())
    return first_per_key(dated, [col(r.id)], [at.desc(), *r.order_columns()])


def latest_per_period(df: DataFrame, roles: Roles, x: str, period: str) -> DataFrame:
    """Latest snapshot per id within each calendar period of ``x``.

    ``x`` becomes the first day of its period. Rows without ``x`` or id drop out;
    a row without a snapshot date only stands in when its id has no dated row.
    """
    r = roles.bind(df)
    at = moment(df, x)
    start = period_start(at, period).cast("timestamp_ntz")
    if r.missing(("id", "snapshot")):
        return df.filter(at.isNotNull()).withColumn(x, start)
    rows = df.filter(at.isNotNull() & col(r.id).isNotNull())
    if r.snapshot == x:  # the period replaces x, the order still needs the full date
        order = F.col("__snapshot").desc()
        rows = rows.withColumn("__snapshot", at)
    else:
        order = moment(df, r.snapshot).desc_nulls_last()
    rows = rows.withColumn(x, start)
    return first_per_key(rows, [col(x), col(r.id)], [order, *r.order_columns()]).drop("__snapshot")


def first_snapshot(df: DataFrame, roles: Roles) -> DataFrame:
    """First row per id in snapshot order; undated rows come last."""
    r = roles.bind(df)
    if r.missing(("id",)):
        return df
    order = [moment(df, r.snapshot).asc_nulls_last()] if r.snapshot else []
    order += r.order_columns()
    if not order:
        raise ValueError("first_snapshot needs a snapshot or tie column to order by")
    return first_per_key(df.filter(col(r.id).isNotNull()), [col(r.id)], order)
