"""Outlier rules against numpy; the isolation forest by its properties."""

import random

import numpy as np
import pytest

from snaplens import OutlierSpec, exclude_outliers, exclusion_info, flag_outliers, outlier_rules, outlier_stats
from snaplens.operators.isolation import Forest, TREE_ROWS, grow_tree, mean_path, share_cut, short_intervals, step_counts, within
from snaplens.operators.outliers import PRESETS

rng = random.Random(11)
PLAIN = [rng.gauss(100, 15) for _ in range(300)] + [1e4] * 5 + [-50.0] * 5
OTHER = [rng.gauss(0, 1) for _ in range(305)] + [99.0] * 5
THIRD = [float(i % 7) for i in range(310)]


@pytest.fixture(scope="module")
def df(spark):
    rows = [(i, a, b, c, "x") for i, (a, b, c) in enumerate(zip(PLAIN, OTHER, THIRD))]
    rows += [(1000, None, None, None, None), (1001, float("nan"), 0.0, 1.0, "y")]
    data = spark.createDataFrame(rows, "n int, a double, b double, c double, t string")
    from snaplens.operators.semantics import blank_nan

    return blank_nan(data)


def model(values, method, sensitivity):
    x, t = np.array(values), PRESETS[sensitivity][method]
    if method == "iqr":
        q1, q3 = np.quantile(x, [0.25, 0.75])
        return (x < q1 - t * (q3 - q1)) | (x > q3 + t * (q3 - q1))
    if method == "z_score":
        return np.abs((x - x.mean()) / x.std()) > t
    mad = np.median(np.abs(x - np.median(x))) or x.std(ddof=1)
    return np.abs(0.6745 * (x - np.median(x)) / mad) > t


@pytest.mark.parametrize("sensitivity", list(PRESETS))
@pytest.mark.parametrize("method", ["iqr", "z_score", "modified_z_score"])
def test_rules_match_numpy(df, method, sensitivity):
    flagged = flag_outliers(df, OutlierSpec(["a"], method, sensitivity)).filter("is_outlier").collect()
    assert {r["n"] for r in flagged} == set(np.flatnonzero(model(PLAIN, method, sensitivity)))


@pytest.mark.parametrize("combine", ["any", "all", "majority"])
def test_combinations(df, combine):
    flags = np.array([model(v, "iqr", "moderate") for v in (PLAIN, OTHER, THIRD)])
    expected = {"any": flags.any(0), "all": flags.all(0), "majority": flags.sum(0) > 1.5}[combine]
    kept = exclude_outliers(df, OutlierSpec(["a", "b", "c"], combine=combine))
    assert {r["n"] for r in kept.collect()} == set(np.flatnonzero(~expected)) | {1000, 1001}


def test_mad_of_zero_falls_back_to_deviation(spark):
    values = [5.0] * 30 + [6.0, 50.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    flagged = flag_outliers(df, OutlierSpec(["v"], "modified_z_score")).filter("is_outlier").collect()
    assert [r["v"] for r in flagged] == [v for v, f in zip(values, model(values, "modified_z_score", "moderate")) if f]


def test_constant_short_and_textual_columns_have_none(spark, df):
    same = spark.createDataFrame([(1.0,)] * 20, "v double")
    few = spark.createDataFrame([(float(i),) for i in range(8)] + [(1e9,)], "v double")
    for data in (same, few):
        for method in ("iqr", "z_score", "modified_z_score", "isolation_forest"):
            assert flag_outliers(data, OutlierSpec(["v"], method)).filter("is_outlier").count() == 0
    rules = outlier_rules(df, OutlierSpec(["t", "gone"]))
    assert [r.flag for r in rules] == [None, None]
    assert exclude_outliers(df, OutlierSpec(["a", "gone"], combine="all")).count() == df.count()


def test_info_and_stats(df):
    spec = OutlierSpec(["a", "gone"])
    n = int(model(PLAIN, "iqr", "moderate").sum())
    info = exclusion_info(df, spec).first()
    assert (info["original_rows"], info["excluded_rows"], info["filtered_rows"]) == (312, n, 312 - n)
    assert info["exclusion_pct"] == pytest.approx(100 * n / 312)
    a, gone = outlier_stats(df, spec).collect()
    assert (a["n"], a["valid"], a["outliers"]) == (312, 310, n)
    q1, q3 = np.quantile(PLAIN, [0.25, 0.75])
    assert (a["lower"], a["upper"]) == pytest.approx((q1 - 2 * (q3 - q1), q3 + 2 * (q3 - q1)))
    assert (gone["valid"], gone["outliers"], gone["lower"]) == (0, 0, None)


def test_empty_table_gives_zero_percent(df):
    empty = df.filter("false")
    assert exclusion_info(empty, OutlierSpec(["a"])).first()["exclusion_pct"] == 0


def test_unknown_settings_are_refused():
    for bad in ({"method": "guess"}, {"sensitivity": "wild"}):
        with pytest.raises(ValueError):
            OutlierSpec(["a"], **bad)


@pytest.mark.parametrize("row_key", [["n"], []])
@pytest.mark.parametrize("sensitivity", ["conservative", "very_aggressive"])
def test_isolation_forest(df, sensitivity, row_key):
    spec = OutlierSpec(["a"], "isolation_forest", sensitivity, row_key=row_key)
    flagged = {r["n"]: r["a"] for r in flag_outliers(df, spec).filter("is_outlier").collect()}
    share = len(flagged) / 310
    assert share <= PRESETS[sensitivity]["isolation_forest"] + 0.01
    assert {300, 301, 302, 303, 304} <= set(flagged)  # the far values
    assert not {1000, 1001} & set(flagged)
    again = {r["n"] for r in flag_outliers(df, spec).filter("is_outlier").collect()}
    assert again == set(flagged)


def test_tree_steps():
    steps = grow_tree(np.array([1.0, 2.0, 3.0, 100.0]), np.random.default_rng(0))
    assert steps[0][0] == -np.inf and all(a < b for (a, _), (b, _) in zip(steps, steps[1:]))
    assert steps[-1][1] < max(path for _, path in steps)  # the far value is isolated early
    assert grow_tree(np.array([4.0] * TREE_ROWS), np.random.default_rng(0)) == [(-np.inf, mean_path(TREE_ROWS))]


def test_exclusion_reaches_the_scan(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    kept = exclude_outliers(spark.read.parquet(str(tmp_path / "t")), OutlierSpec(["a"]))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Or(IsNull(a),And(GreaterThanOrEqual(a," in plan


@pytest.mark.parametrize("method", ["iqr", "z_score", "modified_z_score", "isolation_forest"])
def test_nan_is_missing(spark, method):
    rows = [(float(i),) for i in range(50)] + [(float("nan"),), (None,)]
    df = spark.createDataFrame(rows, "v double")
    flagged = flag_outliers(df, OutlierSpec(["v"], method)).filter("is_outlier").collect()
    assert not any(r["v"] is None or r["v"] != r["v"] for r in flagged) and len(flagged) <= 10
    stats = outlier_stats(df, OutlierSpec(["v"], method)).first()
    assert stats["n"] == 52 and stats["valid"] == 50


def test_intervals_flag_what_path_lengths_flag(spark):
    draw = np.random.default_rng(5)
    forest = Forest(np.sort(draw.normal(0, 3, 400)), draw.uniform(5, 9, 401))  # many separate intervals
    values = np.concatenate([draw.normal(0, 2, 3000), forest.edges[::7], [-1e9, 1e9]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    counts = step_counts(df, "v", forest)
    paths = forest.heights[np.searchsorted(forest.edges, values, side="left")]
    assert counts.sum() == len(values)
    for share in (0.0, 0.05, 0.2, 0.9):
        cut = share_cut(forest.heights, counts, share)
        assert cut == pytest.approx(np.quantile(paths, share), abs=1e-12)
        intervals = short_intervals(forest, counts, cut)
        flagged = sorted(r["v"] for r in df.filter(within(df["v"], intervals)).collect())
        assert flagged == sorted(values[paths < cut])


def test_forest_predicate_runs_no_python_and_reaches_the_scan(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    spec = OutlierSpec(["a"], "isolation_forest", "conservative", row_key=["n"], trees=40, tree_rows=128)
    kept = exclude_outliers(table, spec)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "LessThanOrEqual(a," in plan
    assert not {300, 301, 302, 303, 304} & {r["n"] for r in kept.collect()}
    with pytest.raises(ValueError, match="tree"):
        OutlierSpec(["a"], "isolation_forest", trees=0)
