"""Filters against plain Python, and what reaches the scan."""

from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from snaplens import (
    BooleanFilter,
    CategoricalFilter,
    DateFilter,
    NumericFilter,
    Semantic,
    TextFilter,
    apply_filters,
    clip_upper,
    filter_options,
    preview,
    select_columns,
)

ROWS = [
    (1, "red", 1.0, datetime(2024, 1, 1), "Alpha beta", True),
    (2, "Red", 2.5, datetime(2024, 1, 1, 12), "alpha", False),
    (3, None, None, None, None, None),
    (4, "blue", -3.0, datetime(2024, 2, 1), "50% off_", True),
    (5, "7", 10.0, datetime(2023, 12, 31), "BETA", False),
    (6, "", 2.5, datetime(2024, 1, 31), "", None),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "n int, color string, x double, at timestamp_ntz, words string, ok boolean")


def kept(df, *filters):
    return sorted(r["n"] for r in apply_filters(df, list(filters)).collect())


COLORS = st.lists(st.sampled_from(["red", "Red", "blue", "7", "", "none"]), max_size=4)
NUMBERS = st.floats(-5, 12, allow_nan=False)
QUICK = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@QUICK
@given(values=COLORS, mode=st.sampled_from(["include", "exclude"]))
def test_categorical(df, values, mode):
    def keep(color):
        if not values:
            return False
        return color in values if mode == "include" else color not in values

    assert kept(df, CategoricalFilter("color", values, mode)) == [r[0] for r in ROWS if keep(r[1])]


@QUICK
@given(low=NUMBERS, high=NUMBERS, mode=st.sampled_from(["range", "greater_than", "less_than"]))
def test_numeric(df, low, high, mode):
    tests = {"range": lambda x: low <= x <= high, "greater_than": lambda x: x > low, "less_than": lambda x: x < high}
    assert kept(df, NumericFilter("x", mode, low, high)) == [
        r[0] for r in ROWS if r[2] is not None and tests[mode](r[2])
    ]


@QUICK
@given(
    search=st.sampled_from(["a", "BETA", "alpha", "%", "_", "50% off_", " ", "."]),
    mode=st.sampled_from(["contains", "starts_with", "ends_with", "exact"]),
    exact_case=st.booleans(),
)
def test_text_is_literal(df, search, mode, exact_case):
    def keep(words):
        if words is None:
            return False
        a, b = (words, search) if exact_case else (words.lower(), search.lower())
        return {"contains": b in a, "starts_with": a.startswith(b), "ends_with": a.endswith(b), "exact": a == b}[mode]

    assert kept(df, TextFilter("words", search, mode, exact_case)) == [r[0] for r in ROWS if keep(r[4])]


def test_dates(df):
    assert kept(df, DateFilter("at", "range", "2024-01-01", "2024-01-31")) == [1, 2, 6]
    assert kept(df, DateFilter("at", "range", "2023-12-31", "2024-01-01")) == [1, 5]  # midnight bound
    assert kept(df, DateFilter("at", "after", low="2024-01-01")) == [2, 4, 6]
    assert kept(df, DateFilter("at", "before", high=datetime(2024, 1, 1).date())) == [5]


def test_booleans_and_no_ops(df):
    assert kept(df, BooleanFilter("ok", [True])) == [1, 4]
    assert kept(df, BooleanFilter("ok")) == [1, 2, 4, 5]
    assert kept(df, BooleanFilter("ok", [])) == []
    everything = [r[0] for r in ROWS]
    assert kept(df, TextFilter("words", ""), NumericFilter("gone", "range", 0, 1)) == everything
    assert kept(df, NumericFilter("x", "greater_than", low=2, active=False)) == everything
    assert kept(df, NumericFilter("x", "sideways", 0, 1)) == everything


def test_filters_are_anded(df):
    assert kept(df, NumericFilter("x", "greater_than", low=0), BooleanFilter("ok", [False])) == [2, 5]


def test_whole_numbers_compare_as_text(df):
    assert kept(df, CategoricalFilter("n", ["1", "03", "4", "x"])) == [1, 4]


def test_predicates_reach_the_scan(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    wanted = [
        CategoricalFilter("color", ["red"]), CategoricalFilter("n", ["1", "2"]), NumericFilter("x", "range", 0, 3),
        DateFilter("at", "after", low="2023-01-01"), CategoricalFilter("words", ["x"], "exclude"),
    ]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = apply_filters(stored, wanted).select("n")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    for part in ("EqualTo(color,red)", "In(n, [1,2])", "GreaterThanOrEqual(x,0.0)", "GreaterThan(at,", "Or(IsNull(words)"):
        assert part in pushed, part


def test_options(df):
    types = {
        "n": Semantic.NUMERICAL, "color": Semantic.CATEGORICAL, "x": Semantic.NUMERICAL, "at": Semantic.DATE,
        "words": Semantic.TEXT, "ok": Semantic.BOOLEAN,
    }
    rows = filter_options(df, types).collect()
    assert [r["option"] for r in rows if r["column"] == "color"] == ["", "7", "Red", "blue", "red"]
    x = next(r for r in rows if r["column"] == "x")
    assert (x["min"], x["p25"], x["p50"], x["p75"], x["max"]) == (-3.0, 1.0, 2.5, 2.5, 10.0)
    at = next(r for r in rows if r["column"] == "at")
    assert (str(at["min_date"]), str(at["max_date"])) == ("2023-12-31", "2024-02-01")
    assert {r["type"] for r in rows} == {"numerical", "categorical", "date", "text", "boolean"}


def test_clip_keeps_nulls(df):
    rows = {r["n"]: (r["x"], r["above_limit"]) for r in clip_upper(df, "x", 2.0).collect()}
    assert rows[3] == (None, False) and rows[5] == (2.0, True) and rows[1] == (1.0, False)


def test_projections(df):
    assert select_columns(df, ["x", "gone"]).columns == ["x"] and select_columns(df, None).columns == df.columns
    assert [r["n"] for r in preview(df, 2, 1, ["n"]).collect()] == [1, 2]
