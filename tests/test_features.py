"""Feature edge cases and a plain-Python model of the stepwise one."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snaplens import Roles, Semantic, add_features, available_features, features, latest_snapshot, register_feature
from snaplens import latest_per_period, first_snapshot
from tests.conftest import GOLDEN_SCHEMA, by_key, day, golden_rows

SCHEMA = "Id string, `Snapshot Date` timestamp_ntz, Stage string, n int"
ROLES = Roles(tie=("n",))
HISTORY = st.lists(
    st.tuples(
        st.sampled_from(["a", "b", None]),
        st.one_of(st.none(), st.integers(0, 200).map(lambda h: datetime(2024, 1, 1) + timedelta(hours=h))),
        st.sampled_from(["x", "y", None]),
    ),
    min_size=1, max_size=25,
)


def step_model(rows):
    """Row by row, as written down in words: the days since the previous row of the id."""
    out = {}
    for key in {r[0] for r in rows if r[0] is not None}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, r[1] or datetime.min, r[3]))
        for before, row in zip([None, *mine], mine):
            _, at, stage, n = row
            if at is None or stage is None:
                out[n] = None
            elif before is None:
                out[n] = 0
            elif before[1] is None or before[2] is None:
                out[n] = None
            else:
                out[n] = max(0, (at - before[1]).days) if stage == before[2] else 0
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(history=HISTORY)
@pytest.mark.parametrize("parts", [1, 5])
def test_days_in_stage_model(spark, history, parts):
    rows = [(*h, i) for i, h in enumerate(history)]
    out = add_features(spark.createDataFrame(rows, SCHEMA).repartition(parts), ROLES, ["days_in_current_stage"])
    expected = step_model(rows)
    assert {r["n"]: r["days_in_current_stage"] for r in out.collect()} == {n: expected.get(n) for n in range(len(rows))}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(history=HISTORY)
def test_latest_snapshot_model(spark, history):
    rows = [(*h, i) for i, h in enumerate(history)]
    best = {}
    for row in rows:
        key, at, _, n = row
        if key is not None and at is not None:
            if key not in best or (at, -n) > (best[key][1], -best[key][3]):
                best[key] = row
    got = sorted(tuple(r) for r in latest_snapshot(spark.createDataFrame(rows, SCHEMA), ROLES).collect())
    assert got == sorted(best.values())


def changed(spark, change):
    rows = [list(r) for r in golden_rows()]
    change(rows)
    return spark.createDataFrame([tuple(r) for r in rows], GOLDEN_SCHEMA)


def test_missing_dates_are_ignored(spark, roles):
    def change(rows):
        for r in rows[:2]:
            r[2] = None

    out = add_features(changed(spark, change), roles, ["days_in_pipeline", "opportunity_age_days", "final_stage"])
    first = [r for r in out.collect() if r["Id"] == "OPP-001"]
    assert {r["days_in_pipeline"] for r in first} == {0}
    assert [r["opportunity_age_days"] for r in first if r["Snapshot Date"] is None] == [None, None]
    assert {r["final_stage"] for r in first} == {"Closed - WON"}


def test_missing_ids_get_no_features(spark, roles):
    def change(rows):
        for r in rows[:3]:
            r[0] = None

    df = changed(spark, change)
    out = add_features(df, roles, list(features()))
    lost = [r for r in out.collect() if r["Id"] is None]
    assert len(lost) == 3
    for name in ("days_in_pipeline", "starting_stage", "days_in_current_stage", "stage_progression_count"):
        assert {r[name] for r in lost} == {None}
    assert latest_snapshot(df, roles).count() == 3


def test_same_dates_give_zero_days(spark, roles):
    def change(rows):
        for r in rows:
            r[2] = r[3]

    out = add_features(changed(spark, change), roles, ["days_in_pipeline", "opportunity_age_days"]).collect()
    assert {(r["days_in_pipeline"], r["opportunity_age_days"]) for r in out} == {(0, 0)}


def test_exact_duplicates_do_not_change_entities(spark, roles, golden):
    doubled = golden.unionByName(golden.limit(1))
    assert latest_snapshot(doubled, roles).count() == 4
    spans = by_key(add_features(doubled, roles, ["days_in_pipeline"]), "Id", "days_in_pipeline")
    assert spans == {"OPP-001": 29, "OPP-002": 31, "OPP-003": 31, "OPP-004": 31}


def test_names_match_whatever_the_case(golden, roles):
    renamed = golden.withColumnRenamed("Id", "ID").withColumnRenamed("Owner", "sales rep")
    out = add_features(renamed, roles, ["days_in_pipeline", "user_win_rate"])
    assert out.columns[-2:] == ["days_in_pipeline", "user_win_rate"]
    assert by_key(out, "sales rep", "user_win_rate")["Alice"] == 100.0


def test_unavailable_features_are_skipped(golden, roles):
    bare = golden.select("Id", "Stage")
    assert set(available_features(bare, roles)) == {"stage_progression_count"}
    with pytest.warns(UserWarning):
        out = add_features(bare, roles, ["days_in_pipeline", "nonsense", "stage_progression_count"])
    assert out.columns == ["Id", "Stage", "stage_progression_count"]


def test_without_id_the_table_stays(golden, roles):
    bare = golden.drop("Id")
    assert latest_snapshot(bare, roles).count() == 12 and first_snapshot(bare, roles).count() == 12
    assert latest_per_period(bare, roles, "Created", "M").count() == 12


def test_no_stage_seen_gives_null(spark):
    df = spark.createDataFrame([("a", day("2024-01-01"), None, 1)], SCHEMA)
    assert add_features(df, ROLES, ["stage_progression_count"]).first()["stage_progression_count"] is None


def test_win_rate_owner_rules(spark):
    """Nothing closed is 0, a blank owner null; an entity belongs to its first owner."""
    rows = [
        ("a", day("2024-01-01"), "Lead", "Ann"), ("a", day("2024-01-02"), "Won", "Bea"),
        ("b", day("2024-01-01"), "LOST", "Ann"), ("c", day("2024-01-01"), "Canceled/deferred", "Bea"),
        ("d", day("2024-01-01"), "Won", " "), ("e", day("2024-01-01"), "Won", None),
    ]
    df = spark.createDataFrame(rows, "Id string, `Snapshot Date` timestamp_ntz, Stage string, Owner string")
    rates = by_key(add_features(df, Roles(), ["user_win_rate"]), "Owner", "user_win_rate")
    assert rates == {"Ann": 50.0, "Bea": 0.0, " ": None, None: None}


def test_activity_terciles(spark):
    rows = [(f"{o}{i}", day("2024-03-05"), o) for o, n in (("a", 1), ("b", 2), ("c", 3), ("d", 9)) for i in range(n)]
    rows.append(("x", day("2024-03-05"), None))
    df = spark.createDataFrame(rows, "Id string, `Snapshot Date` timestamp_ntz, Owner string")
    ratings = by_key(add_features(df, Roles(), ["user_activity_rating"]), "Owner", "user_activity_rating")
    assert ratings == {"a": "Low", "b": "Medium", "c": "Medium", "d": "High", None: "Unknown"}
    few = df.filter("Owner in ('a', 'b')")
    assert {r["user_activity_rating"] for r in add_features(few, Roles(), ["user_activity_rating"]).collect()} == {"Unknown"}


def test_own_features(golden, roles):
    register_feature(
        "margin_value", lambda df, r: df.withColumn("margin_value", F.col("SellPrice") * F.col("`GM%`")),
        ("SellPrice", "GM%"), Semantic.NUMERICAL,
    )
    out = add_features(golden, roles, ["margin_value", "final_stage"])
    assert out.columns[-2:] == ["margin_value", "final_stage"]
    assert out.agg(F.max("margin_value")).first()[0] == pytest.approx(105000)


def test_period_dedup(spark, roles):
    rows = [
        ("a", day("2024-01-03"), day("2024-01-10"), 1), ("a", day("2024-01-20"), day("2024-01-05"), 2),
        ("a", day("2024-02-01"), None, 3), ("a", day("2024-02-02"), day("2024-01-01"), 4),
        (None, day("2024-01-01"), day("2024-01-01"), 5), ("b", None, day("2024-01-01"), 6),
    ]
    df = spark.createDataFrame(rows, "Id string, Created timestamp_ntz, `Snapshot Date` timestamp_ntz, n int")
    got = latest_per_period(df, roles, "Created", "M").collect()
    assert {(r["Created"], r["n"]) for r in got} == {(datetime(2024, 1, 1), 1), (datetime(2024, 2, 1), 4)}
