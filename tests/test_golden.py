"""Golden values of the twelve-row table."""

from datetime import datetime

import pytest

from snaplens import (
    add_features,
    bar_chart,
    box_plot,
    column_stats,
    correlation_matrix,
    descriptive_statistics,
    detect_types,
    histogram,
    latest_snapshot,
    line_chart,
    scatter_plot,
    time_series,
    validate,
)
from snaplens import Semantic
from tests.conftest import by_key

TOTAL = 1_000_000


def test_latest_snapshot(golden, roles):
    assert by_key(latest_snapshot(golden, roles), "Id", "SellPrice") == {
        "OPP-001": 150000, "OPP-002": 0, "OPP-003": 350000, "OPP-004": 500000,
    }


def test_types(golden):
    types = detect_types(golden)
    assert types == {
        "Id": Semantic.CATEGORICAL, "OpportunityName": Semantic.CATEGORICAL, "Snapshot Date": Semantic.DATE,
        "Created": Semantic.DATE, "Stage": Semantic.CATEGORICAL, "SellPrice": Semantic.NUMERICAL,
        "GM%": Semantic.NUMERICAL, "BusinessUnit": Semantic.CATEGORICAL, "Owner": Semantic.CATEGORICAL,
    }


@pytest.mark.parametrize("name, expected", [
    ("days_in_pipeline", [29, 31, 31, 31]),
    ("days_to_close_won", [29, None, None, 31]),
    ("starting_stage", ["Lead"] * 4),
    ("final_stage", ["Closed - WON", "Closed - LOST", "Negotiation", "Closed - WON"]),
    ("user_win_rate", [100.0, 0.0, 0.0, 100.0]),
    ("stage_progression_count", [3, 3, 3, 3]),
])
def test_entity_features(golden, roles, name, expected):
    out = add_features(golden, roles, [name])
    assert out.count() == 12
    assert by_key(out, "Id", name) == dict(zip(["OPP-001", "OPP-002", "OPP-003", "OPP-004"], expected))


def test_row_features(golden, roles):
    out = add_features(golden, roles, ["time_in_stages", "opportunity_age_days"])
    rows = {(r["Id"], r["Stage"]): (r["days_in_current_stage"], r["opportunity_age_days"]) for r in out.collect()}
    assert rows["OPP-001", "Lead"] == (0, 0)
    assert rows["OPP-001", "Budget"] == (0, 14)
    assert rows["OPP-004", "Closed - WON"] == (0, 31)


def test_activity_rating(golden, roles):
    ratings = by_key(add_features(golden, roles, ["user_activity_rating"]), "Owner", "user_activity_rating")
    assert set(ratings.values()) == {"Low"}  # all owners have one entity per active month


def test_every_report_agrees_on_the_total(golden, roles):
    bars = bar_chart(golden, roles, "Owner", "SellPrice")
    assert by_key(bars, "Owner", "value") == {"Alice": 150000, "Bob": 0, "Carol": 350000, "David": 500000}
    units = by_key(bar_chart(golden, roles, "BusinessUnit", "SellPrice"), "BusinessUnit", "value")
    assert units == {"Enterprise": 650000, "SMB": 0, "Government": 350000}
    series = time_series(golden, roles, "Created", "SellPrice", "M").collect()
    assert [(r["period_end"], r["value"]) for r in series] == [(datetime(2024, 1, 31), TOTAL)]
    line = line_chart(golden, roles, "Created", "SellPrice", "sum")
    points = scatter_plot(golden, roles, "GM%", "SellPrice")
    grouped = bar_chart(golden, roles, "Stage", "SellPrice", group_by="Owner")
    totals = [sum(r[0] for r in d.collect()) for d in (
        bars.select("value"), line.select("value"), points.select("y"), grouped.select("value"),
    )]
    assert totals == [TOTAL] * 4
    assert sum(r["count"] for r in histogram(golden, roles, "SellPrice").collect()) == 4
    assert sum(r["count"] for r in box_plot(golden, roles, "Owner", "SellPrice").collect()) == 4


def test_daily_series_counts_each_creation_day(golden, roles):
    rows = time_series(golden, roles, "Created", "SellPrice", "D", "count").collect()
    assert len(rows) == 15 and sum(r["value"] for r in rows) == 4


def test_descriptive_statistics(golden, roles):
    price = by_key(descriptive_statistics(golden, roles), "column", "mean")
    assert price["SellPrice"] == 250000 and price["GM%"] == pytest.approx(0.1875)
    row = descriptive_statistics(golden, roles, ["SellPrice"]).first()
    assert (row["min"], row["max"], row["median"], row["count"]) == (0, 500000, 250000, 4)


def test_statistics_sorting_and_groups(golden, roles):
    by_name = descriptive_statistics(golden, roles, sort_by="column_name").collect()
    assert [r["column"] for r in by_name] == sorted(golden.columns)
    grouped = descriptive_statistics(golden, roles, ["SellPrice"], "BusinessUnit").collect()
    assert {r["group"]: r["count"] for r in grouped} == {"Enterprise": 2, "SMB": 1, "Government": 1}


def test_correlation(golden, roles):
    rows = {(r["col_a"], r["col_b"]): r["r"] for r in correlation_matrix(golden, roles).collect()}
    assert rows["SellPrice", "SellPrice"] == pytest.approx(1.0)
    assert rows["SellPrice", "GM%"] == pytest.approx(rows["GM%", "SellPrice"])
    with pytest.raises(ValueError):
        correlation_matrix(golden, roles, ["SellPrice"])


def test_bar_sorting(golden, roles):
    down = [r["value"] for r in bar_chart(golden, roles, "Owner", "SellPrice", sort_by="value_descending").collect()]
    up = [r["value"] for r in bar_chart(golden, roles, "Owner", "SellPrice", sort_by="value_ascending").collect()]
    assert down == sorted(down, reverse=True) and up == sorted(up)


def test_validation(golden, roles):
    findings = {(r["check"], r["detail"]): r["n"] for r in validate(golden, roles).collect()}
    assert findings == {("duplicate_ids", "Id"): 8}


def test_replicated_table(spark, golden, roles):
    copies = spark.range(100).selectExpr("cast(id as string) as copy")
    many = golden.join(copies).selectExpr("concat(Id, '-', copy) as Id", *[f"`{c}`" for c in golden.columns[1:]])
    total = bar_chart(many, roles, "Owner", "SellPrice").agg({"value": "sum"}).first()[0]
    assert (many.count(), total) == (1200, 100 * TOTAL)


def test_column_stats_shape(golden):
    stats = {r["column"]: r for r in column_stats(golden, detect_types(golden)).collect()}
    assert stats["Stage"]["mode"] in ("Budget", "Lead") and stats["Stage"]["mode_count"] == 4
    assert stats["Stage"]["mode"] == "Budget"  # ties go to the smaller value
    assert stats["Snapshot Date"]["range_days"] == 45


def test_latest_of_dates_written_as_text(spark, roles):
    rows = [("a", "12/31/2023", 1), ("a", "01/15/2024", 2), ("b", "no date", 3), ("c", "2024-02-01", 4), ("c", "01/31/2024", 5)]
    df = spark.createDataFrame(rows, "`Id` string, `Snapshot Date` string, n int")
    assert by_key(latest_snapshot(df, roles), "Id", "n") == {"a": 2, "c": 4}
