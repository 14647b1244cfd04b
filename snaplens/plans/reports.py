"""Report tables: the numbers behind each chart, as DataFrames.

All reports but the time series work on the latest snapshot per entity.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplens.functions.dates import PERIODS, epoch_seconds, from_epoch_seconds, period_end, period_step
from snaplens.operators.filters import clip_upper
from snaplens.operators.profile import GROUP, column_stats
from snaplens.operators.quantiles import column_quantiles, group_quantiles, number
from snaplens.operators.semantics import Semantic, detect_types, is_number, present
from snaplens.operators.skew import lookup_join
from snaplens.operators.snapshots import latest_per_period, latest_snapshot
from snaplens.roles import Roles, col
from snaplens.session import stabilise

AGGREGATIONS = ("sum", "mean", "count", "median", "min", "max")

# Which semantic types each axis of a report takes.
AXES = {
    "histogram": {"x": (Semantic.NUMERICAL, Semantic.DATE)},
    "bar_chart": {"x": (Semantic.CATEGORICAL, Semantic.BOOLEAN), "y": (Semantic.NUMERICAL,)},
    "scatter_plot": {"x": (Semantic.NUMERICAL, Semantic.DATE), "y": (Semantic.NUMERICAL,)},
    "line_chart": {"x": (Semantic.DATE, Semantic.NUMERICAL), "y": (Semantic.NUMERICAL,)},
    "box_plot": {"x": (Semantic.CATEGORICAL, Semantic.BOOLEAN), "y": (Semantic.NUMERICAL,)},
    "time_series": {"x": (Semantic.DATE,), "y": (Semantic.NUMERICAL,)},
}


def check_axes(report: str, types: Mapping[str, Semantic], **axes: str) -> None:
    """Raise when a column's semantic type does not suit its axis."""
    for axis, column in axes.items():
        allowed = AXES[report].get(axis)
        if allowed and column in types and types[column] not in allowed:
            names = ", ".join(a.value for a in allowed)
            raise ValueError(f"{report}: {axis} must be {names}; {column!r} is {types[column].value}")


def _need(df: DataFrame, **axes: str) -> None:
    for axis, column in axes.items():
        if column not in df.columns:
            raise ValueError(f"{axis} column {column!r} not found")


def _keep_group(df: DataFrame, group: str | None) -> tuple[DataFrame, list[str]]:
    if group is None or group not in df.columns:
        return df, []
    return df.filter(col(group).isNotNull()).withColumn(GROUP, col(group).cast("string")), [GROUP]


def aggregate(df: DataFrame, keys: Sequence[str], y: str, how: str) -> DataFrame:
    """Columns ``keys`` and ``value``; null keys drop out, a sum over nothing is 0. NaN is missing."""
    if how not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {how!r}; use one of {', '.join(AGGREGATIONS)}")
    for key in keys:
        df = df.filter(col(key).isNotNull())
    value, by = present(df, y), [col(k) for k in keys]
    if how == "median":
        df = stabilise(df.select(*by, value.alias(y)))  # read by several passes
        middle = group_quantiles(df, keys, y, [0.5]).select(*by, F.col("q")[0].alias("value"))
        return df.select(*by).distinct().join(middle, list(keys), "left")
    agg: dict[str, Column] = {
        "sum": F.coalesce(F.sum(value), F.lit(0)),
        "mean": F.avg(value),
        "count": F.count(value),
        "min": F.min(value),
        "max": F.max(value),
    }
    return df.groupBy(*by).agg(agg[how].alias("value"))


def descriptive_statistics(
    df: DataFrame,
    roles: Roles,
    columns: Sequence[str] | None = None,
    group_by: str | None = None,
    sort_by: str = "none",
    types: Mapping[str, Semantic] | None = None,
) -> DataFrame:
    """One row per column (and group) with the statistics that suit its type.

    ``sort_by``: column_name, data_type, count_descending, missing_ascending or none
    (column order). Types are detected once, on the whole table.
    """
    latest = latest_snapshot(df, roles)
    columns = [c for c in (latest.columns if columns is None else columns) if c in latest.columns]
    group_by = group_by if group_by in latest.columns else None
    needed = dict.fromkeys([*columns, *([group_by] if group_by else [])])
    latest = stabilise(latest.select(*map(col, needed)))  # read by several passes
    types = detect_types(latest, columns) if types is None else types
    stats = column_stats(latest, {c: types[c] for c in columns if c in types}, group_by)
    lead = [GROUP] if group_by else []
    category = F.col("type") == Semantic.CATEGORICAL.value
    stats = stats.withColumn("distinct", F.when(category, F.col("distinct")))
    order = {
        "column_name": [F.col("column")],
        "data_type": [F.col("type"), F.col("position")],
        "count_descending": [F.col("count").desc(), F.col("position")],
        "missing_ascending": [F.col("missing"), F.col("position")],
    }.get(sort_by, [*lead, F.col("position")])
    return stats.orderBy(*order, *lead).select(
        *lead, "column", "type", "count", "non_null", "missing", "missing_pct",
        "mean", "median", "std", "min", "max", "skew", "kurt",
        "distinct", "mode", "mode_count", "earliest", "latest", "range_days",
    )


def histogram(
    df: DataFrame,
    roles: Roles,
    x: str,
    bins: int = 30,
    upper_limit: float | None = None,
    group_by: str | None = None,
) -> DataFrame:
    """Counts per equal-width bin, empty bins left out; groups share the bin edges.

    The last bin is closed. With ``upper_limit`` larger values count as the limit
    and ``above_limit`` says how many a bin took in that way. Dates bin by elapsed seconds.
    """
    _need(df, x=x)
    rows, keys = _keep_group(latest_snapshot(df, roles), group_by)
    rows = rows.filter(col(x).isNotNull())
    numeric = is_number(df.schema[x].dataType)
    if upper_limit is not None and numeric:
        rows = clip_upper(rows, x, upper_limit)
    else:
        rows = rows.withColumn("above_limit", F.lit(False))
    if numeric:
        value = col(x).cast("double")
        rows = rows.filter(~F.isnan(value))  # NaN is missing
    else:
        value = epoch_seconds(col(x).cast("timestamp_ntz"))
    rows = stabilise(rows.select(*keys, value.alias("v"), "above_limit"))  # read twice

    ends = rows.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    lo, hi = ends["lo"], ends["hi"]
    width = (hi - lo) / F.lit(bins)
    step = F.coalesce(F.floor(F.try_divide(F.col("v") - lo, width)).cast("int"), F.lit(0))  # no width: one bin
    counted = (
        rows.select(*keys, F.least(step + 1, F.lit(bins)).alias("bin"), "above_limit", lo.alias("a"), width.alias("w"))
        .groupBy(*keys, "bin", "a", "w")
        .agg(F.count("*").alias("count"), F.count_if("above_limit").alias("above_limit"))
    )
    low = F.col("a") + (F.col("bin") - 1) * F.col("w")
    high = F.col("a") + F.col("bin") * F.col("w")
    if not numeric:
        low, high = from_epoch_seconds(low), from_epoch_seconds(high)
    return counted.select(*keys, "bin", low.alias("lo"), high.alias("hi"), "count", "above_limit").orderBy(*keys, "bin")


def upper_limit_options(df: DataFrame, x: str) -> DataFrame:
    """Bounds from which a histogram limit is chosen: min, max, p95, p99 of a numeric column."""
    _need(df, x=x)
    if not is_number(df.schema[x].dataType):
        raise ValueError("an upper limit needs a numeric column")
    p95, p99 = column_quantiles(df, [x], [0.95, 0.99])[x]
    return df.agg(F.min(col(x)).cast("double").alias("min"), F.max(col(x)).cast("double").alias("max")).select(
        "min", "max", F.lit(p95).cast("double").alias("p95"), F.lit(p99).cast("double").alias("p99")
    )


def bar_chart(
    df: DataFrame,
    roles: Roles,
    x: str,
    y: str,
    aggregation: str = "sum",
    group_by: str | None = None,
    sort_by: str = "none",
) -> DataFrame:
    """``value`` per category (and group), 0 where there is none; empty when no category has one.

    ``sort_by``: category_name, value_ascending, value_descending or none (by key).
    """
    _need(df, x=x, y=y)
    rows, keys = _keep_group(latest_snapshot(df, roles), group_by)
    found = aggregate(rows, [x, *keys], y, aggregation)
    if aggregation not in ("sum", "count"):
        found = found.filter(found.filter(F.col("value").isNotNull()).exists())
    found = found.select(*keys, col(x), F.coalesce("value", F.lit(0)).alias("value"))
    order = {
        "value_ascending": [F.col("value"), col(x)],
        "value_descending": [F.col("value").desc(), col(x)],
    }.get(sort_by, [col(x)])
    return found.orderBy(*keys, *order)


def line_chart(
    df: DataFrame,
    roles: Roles,
    x: str,
    y: str,
    aggregation: str = "mean",
    group_by: str | None = None,
) -> DataFrame:
    """``value`` per ``x`` (and group), ordered by ``x``."""
    _need(df, x=x, y=y)
    rows, keys = _keep_group(latest_snapshot(df, roles), group_by)
    found = aggregate(rows, [x, *keys], y, aggregation)
    return found.select(*keys, col(x), "value").orderBy(*keys, col(x))


def scatter_plot(
    df: DataFrame,
    roles: Roles,
    x: str,
    y: str,
    group_by: str | None = None,
    size: str | None = None,
) -> DataFrame:
    """All points. With ``size`` also ``size_ref``, the marker scale 2 * max / 40^2 (per group)."""
    _need(df, x=x, y=y)
    rows, keys = _keep_group(latest_snapshot(df, roles), group_by)
    sized = size is not None and size in df.columns
    points = rows.select(
        *keys, col(x).alias("x"), col(y).alias("y"), *([col(size).alias("size")] if sized else [])
    )
    if not sized:
        return points
    points = stabilise(points)  # read twice
    reference = F.lit(2.0) * F.max(present(points, "size")) / F.lit(40.0**2)
    if keys:
        return lookup_join(points, points.groupBy(*keys).agg(reference.alias("size_ref")), keys)
    return points.withColumn("size_ref", points.agg(reference.alias("r")).scalar())


def correlation_matrix(
    df: DataFrame, roles: Roles, columns: Sequence[str] | None = None
) -> DataFrame:
    """Pearson's ``r`` for every pair of numeric or boolean columns, both ways round."""
    kinds = {f.name: f.dataType for f in df.schema}
    usable = [
        c for c, t in kinds.items()
        if (is_number(t) or isinstance(t, T.BooleanType)) and (not columns or c in columns)
    ]
    if len(usable) < 2:
        raise ValueError("a correlation needs at least two numeric columns")
    latest = latest_snapshot(df, roles)
    values = latest.select(*[
        number(col(c).cast("int") if isinstance(kinds[c], T.BooleanType) else col(c)).alias(f"c{i}")
        for i, c in enumerate(usable)
    ])
    values = stabilise(values)  # read twice
    # sums of squares are taken around a value near the mean, so that they lose no digits
    centre = values.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in values.columns])
    named = F.array(*[F.lit(c) for c in usable])
    near = centre.select(F.lit(0).alias("one"), F.array(*values.columns).alias("centre"))
    cells = values.select(F.lit(0).alias("one"), F.array(*values.columns).alias("x")).join(F.broadcast(near), "one")
    sums = cells.select("x", "centre").mapInArrow(_co_moments(), "i int, j int, n double, " + ", ".join(f"{c} double" for c in CO_MOMENTS))
    total = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", *CO_MOMENTS)])
    spread_x = F.col("xx") - F.col("x") * F.col("x") / F.col("n")
    spread_y = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    together = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    # what is left of a constant after centring is rounding, some 1e-16 of its squares
    varies = (F.col("n") > 1) & (spread_x > 1e-14 * F.col("xx")) & (spread_y > 1e-14 * F.col("yy"))
    r = F.when(varies, F.when(F.col("i") == F.col("j"), 1.0).otherwise(together / F.sqrt(spread_x * spread_y)))
    pairs = [(i, j) for i in range(len(usable)) for j in range(i, len(usable))]
    wanted = df.sparkSession.createDataFrame(pairs, "i int, j int")  # a pair without a common row has no sums
    found = wanted.join(total.select("i", "j", r.alias("r")), ["i", "j"], "left")
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return (
        found.select("r", F.inline(F.array_distinct(both)))
        .select(F.get(named, F.col("i")).alias("col_a"), F.get(named, F.col("j")).alias("col_b"), "r")
    )


CO_MOMENTS = ("x", "y", "xx", "yy", "xy")


def _co_moments():
    """Counts, sums and products of every pair of columns over the rows that have both, one row per pair and task.

    Missing values are 0 in the values and in the mask, so each sum is a product of two matrices.
    """
    names = ["i", "j", "n", *CO_MOMENTS]

    def run(batches):  # local, so that it travels to the workers by value
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            width = len(batch.column(0)[0])
            x, centre = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for k in (0, 1))
            there = ~np.isnan(x)
            x, there = np.where(there, x - centre, 0.0), there.astype(float)
            block = np.stack([there.T @ there, x.T @ there, there.T @ x, (x * x).T @ there, there.T @ (x * x), x.T @ x])
            total = block if total is None else total + block
        if total is not None:
            i, j = np.triu_indices(total.shape[1])
            columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(m[i, j]) for m in total]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def box_plot(df: DataFrame, roles: Roles, x: str, y: str, sort_by: str = "none") -> DataFrame:
    """Quartiles, whiskers (furthest value within 1.5 IQR) and outlier count per category."""
    _need(df, x=x, y=y)
    rows = latest_snapshot(df, roles).select(col(x), number(col(y)).alias("v"))
    rows = stabilise(rows.filter(col(x).isNotNull() & F.col("v").isNotNull()))  # read by several passes
    q = group_quantiles(rows, [x], "v", [0.25, 0.5, 0.75]).select(
        col(x), *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))]
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)
    found = (
        lookup_join(rows, q, [x])
        .groupBy(col(x).cast("string").alias("category"), "q1", "median", "q3")
        .agg(
            F.count("*").alias("count"),
            F.avg("v").alias("mean"),
            F.min(F.when(inside, F.col("v"))).alias("lo_whisker"),
            F.max(F.when(inside, F.col("v"))).alias("hi_whisker"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )
    order = {
        "value_ascending": [F.col("median"), F.col("category")],
        "value_descending": [F.col("median").desc(), F.col("category")],
    }.get(sort_by, [F.col("category")])
    return found.select(
        "category", "count", "mean", "q1", "median", "q3", "lo_whisker", "hi_whisker", "n_outliers"
    ).orderBy(*order)


def time_series(
    df: DataFrame,
    roles: Roles,
    x: str,
    y: str,
    period: str = "D",
    aggregation: str = "sum",
    group_by: str | None = None,
) -> DataFrame:
    """``value`` per calendar period, labelled by the period's last day, without gaps.

    Within a period each entity counts once, by its latest snapshot. Each group runs
    from its own first to its own last period; gaps hold 0 for sum and count.
    """
    _need(df, x=x, y=y)
    if period not in PERIODS:
        raise ValueError(f"unknown period {period!r}; use one of {', '.join(PERIODS)}")
    rows, keys = _keep_group(latest_per_period(df, roles, x, period), group_by)
    rows = rows.withColumn("__start", col(x).cast("date"))
    found = aggregate(rows, ["__start", *keys], y, aggregation)
    # Each period also stands for the empty ones up to the next; a group has no more
    # rows here than the calendar has periods.
    following = F.lead("__start").over(Window.partitionBy(*keys).orderBy("__start"))
    reach = found.withColumn("__until", F.coalesce(F.date_sub(following, 1), F.col("__start")))
    stretch = F.posexplode(F.sequence("__start", "__until", period_step(period)))
    filled = reach.select(*keys, "value", stretch.alias("gap", "__start"))
    value = F.when(F.col("gap") == 0, F.col("value"))
    if aggregation in ("sum", "count"):
        value = F.coalesce(value, F.lit(0))
    label = period_end(F.col("__start"), period).cast("timestamp_ntz").alias("period_end")
    return filled.select(*keys, label, value.alias("value")).orderBy(*keys, "period_end")
