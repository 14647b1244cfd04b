"""Report edge cases."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from snaplens import (
    Roles,
    Semantic,
    bar_chart,
    box_plot,
    check_axes,
    correlation_matrix,
    histogram,
    line_chart,
    scatter_plot,
    time_series,
    upper_limit_options,
)
from tests.conftest import day

ROLES = Roles()


def points(spark, values, group="g"):
    rows = [(str(i), day("2024-01-01"), group, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "Id string, `Snapshot Date` timestamp_ntz, G string, v double")


def test_histogram_edges(spark):
    df = points(spark, [0.0, 1.0, 2.0, 3.0, 4.0, None])
    rows = {r["bin"]: (r["lo"], r["hi"], r["count"]) for r in histogram(df, ROLES, "v", bins=4).collect()}
    assert rows == {1: (0, 1, 1), 2: (1, 2, 1), 3: (2, 3, 1), 4: (3, 4, 2)}  # the last bin is closed
    one = histogram(points(spark, [7.0, 7.0]), ROLES, "v").collect()
    assert [(r["bin"], r["lo"], r["hi"], r["count"]) for r in one] == [(1, 7.0, 7.0, 2)]
    assert histogram(points(spark, [None]), ROLES, "v").collect() == []


def test_histogram_limit(spark):
    df = points(spark, [1.0, 2.0, 50.0, 90.0, 10.0])
    rows = histogram(df, ROLES, "v", bins=9, upper_limit=10.0).collect()
    assert [(r["bin"], r["count"], r["above_limit"]) for r in rows] == [(1, 1, 0), (2, 1, 0), (9, 3, 2)]


def test_histogram_of_dates_is_time_zone_free(spark):
    df = points(spark, [1.0]).withColumn("at", F.lit("2024-03-31 02:30:00").cast("timestamp_ntz"))
    df = df.unionByName(df.withColumn("Id", F.lit("x")).withColumn("at", F.lit("2024-04-01 02:30:00.5").cast("timestamp_ntz")))
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        rows = histogram(df, ROLES, "at", bins=2).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert rows[0]["lo"] == datetime(2024, 3, 31, 2, 30) and rows[-1]["hi"] == datetime(2024, 4, 1, 2, 30, 0, 500000)


def test_bars_with_missing_values(spark):
    rows = [("1", "a", None), ("2", "b", 4.0), ("3", None, 9.0)]
    df = spark.createDataFrame([(i, day("2024-01-01"), k, v) for i, k, v in rows],
                               "Id string, `Snapshot Date` timestamp_ntz, k string, v double")
    for how, b in (("sum", 4.0), ("mean", 4.0), ("median", 4.0), ("max", 4.0), ("count", 1)):
        assert [(r["k"], r["value"]) for r in bar_chart(df, ROLES, "k", "v", how).collect()] == [("a", 0), ("b", b)]
    nothing = df.withColumn("v", F.lit(None).cast("double"))
    assert bar_chart(nothing, ROLES, "k", "v", "median").collect() == []
    assert [r["value"] for r in bar_chart(nothing, ROLES, "k", "v", "sum").collect()] == [0, 0]
    assert [r["value"] for r in line_chart(nothing, ROLES, "k", "v").collect()] == [None, None]


def test_unknown_settings_are_refused(spark):
    df = points(spark, [1.0])
    for call in (
        lambda: bar_chart(df, ROLES, "gone", "v"), lambda: bar_chart(df, ROLES, "G", "gone"),
        lambda: bar_chart(df, ROLES, "G", "v", "mode"), lambda: time_series(df, ROLES, "Snapshot Date", "v", "H"),
        lambda: upper_limit_options(df, "G"), lambda: histogram(df, ROLES, "gone"),
        lambda: check_axes("bar_chart", {"v": Semantic.NUMERICAL}, x="v"),
        lambda: check_axes("time_series", {"G": Semantic.TEXT}, y="G"),
    ):
        with pytest.raises(ValueError):
            call()
    check_axes("box_plot", {"G": Semantic.CATEGORICAL, "v": Semantic.NUMERICAL}, x="G", y="v")


def test_box_plot(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, -100.0, None]
    row = box_plot(points(spark, values), ROLES, "G", "v").first()
    x = np.array(values[:-1])
    q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    assert (row["count"], row["q1"], row["median"], row["q3"]) == (7, q1, q2, q3)
    assert (row["lo_whisker"], row["hi_whisker"], row["n_outliers"]) == (1.0, 5.0, 2)
    assert box_plot(points(spark, [None]), ROLES, "G", "v").collect() == []


PERIOD_ROWS = [("a", "2024-01-31", 1.0), ("b", "2024-02-29", 2.0), ("c", "2024-06-03", 4.0)]


def dated(spark, rows=PERIOD_ROWS):
    return spark.createDataFrame([(i, day(d), v, i) for i, d, v in rows],
                                 "Id string, `Snapshot Date` timestamp_ntz, v double, G string")


@pytest.mark.parametrize("period, ends", [
    ("W", ["2024-02-04", "2024-03-03", "2024-06-09"]), ("M", ["2024-01-31", "2024-02-29", "2024-06-30"]),
    ("Q", ["2024-03-31", "2024-06-30"]), ("Y", ["2024-12-31"]), ("D", ["2024-01-31", "2024-02-29", "2024-06-03"]),
])
def test_period_labels_and_gaps(spark, period, ends):
    rows = time_series(dated(spark), ROLES, "Snapshot Date", "v", period).collect()
    assert [r["period_end"] for r in rows if r["value"]] == [day(e) for e in ends]
    assert {"W": 19, "M": 6, "Q": 2, "Y": 1, "D": 125}[period] == len(rows)
    assert sum(r["value"] for r in rows) == 7.0
    gaps = time_series(dated(spark), ROLES, "Snapshot Date", "v", period, "median").collect()
    assert len(gaps) == len(rows) and [r["value"] is None for r in gaps] == [r["value"] == 0 for r in rows]


def test_groups_have_their_own_span(spark):
    rows = time_series(dated(spark), ROLES, "Snapshot Date", "v", "M", group_by="G").collect()
    assert [(r["group"], r["period_end"]) for r in rows] == [
        ("a", day("2024-01-31")), ("b", day("2024-02-29")), ("c", day("2024-06-30"))
    ]


def test_series_without_roles_counts_every_row(spark):
    df = dated(spark, [("a", "2024-01-01", 1.0), ("a", "2024-01-02", 2.0)]).withColumnRenamed("Id", "key")
    assert time_series(df, ROLES, "Snapshot Date", "v", "M").first()["value"] == 3.0
    with_id = df.withColumnRenamed("key", "Id")
    assert time_series(with_id, ROLES, "Snapshot Date", "v", "M").first()["value"] == 2.0


def test_scatter_sizes(spark):
    df = points(spark, [1.0, 2.0, 8.0])
    assert {r["size_ref"] for r in scatter_plot(df, ROLES, "v", "v", "G", "v").collect()} == {2 * 8 / 1600}
    assert {r["size_ref"] for r in scatter_plot(df, ROLES, "v", "v", size="v").collect()} == {0.01}
    assert scatter_plot(df, ROLES, "v", "v").columns == ["x", "y"]


def test_correlation_of_constant_is_missing(spark):
    df = points(spark, [1.0, 2.0, 3.0]).withColumn("one", F.lit(1)).withColumn("big", F.col("v") > 1)
    r = {(x["col_a"], x["col_b"]): x["r"] for x in correlation_matrix(df, ROLES).collect()}
    assert r["v", "one"] is None and r["one", "one"] is None
    assert r["v", "big"] == pytest.approx(np.corrcoef([1, 2, 3], [0, 1, 1])[0, 1])
