"""Hot keys: results must not depend on how rows are spread, and no task may need a whole key."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from snaplens import Roles, add_features, latest_snapshot
from snaplens.operators.features import PREVIOUS, features, with_previous
from snaplens.operators.skew import lookup_join

ROLES = Roles(id="id", snapshot="at", stage="stage", owner="owner", tie=("tie",), won=("won",), lost=("lost",))
ALL = [n for n, f in features().items() if f.value is not None or n.startswith("user_")]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one id, many under a null id, ties and gaps throughout."""
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        key = 1 if i % 3 == 0 else (None if i % 11 == 0 else rng.randint(2, 60))
        at = None if rng.random() < 0.05 else datetime(2024, 1, 1) + timedelta(hours=6 * rng.randint(0, 80))
        stage = rng.choice(["new", "open", "won", "lost", None])
        rows.append((key, at, stage, rng.choice(["a", "b", " ", None, "c", "d"]), float(rng.randint(0, 99)), i))
    schema = "id int, at timestamp_ntz, stage string, owner string, value double, tie int"
    return spark.createDataFrame(rows, schema).repartition(6)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def previous_of(rows):
    """Date and stage of the row before, by id, date (undated last) and tie."""
    out, last = {}, {}
    for r in sorted(rows, key=lambda r: (r["at"] is None, r["at"] or datetime.min, r["tie"])):
        out[r["tie"]] = last.get(r["id"])
        last[r["id"]] = (r["at"], r["stage"])
    return {k: v for k, v in out.items()}


@pytest.mark.parametrize("ranges", [1, 4, 40, 400])
def test_previous_row_over_any_number_of_ranges(spark, skewed, ranges):
    want = previous_of(skewed.filter("id is not null").collect())
    got = {r["tie"]: r[PREVIOUS] and tuple(r[PREVIOUS]) for r in with_previous(skewed, ROLES, ranges).filter("id is not null").collect()}
    assert got == want


def test_one_id_on_one_day_is_sorted_by_many_tasks(spark):
    rows = [(7, datetime(2024, 5, 1), f"s{i % 3}", i) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, at timestamp_ntz, stage string, tie int").repartition(5)
    roles = Roles(id="id", snapshot="at", stage="stage", tie=("tie",))
    stepped = with_previous(df, roles, ranges=64)
    got = {r["tie"]: r[PREVIOUS] and r[PREVIOUS]["stage"] for r in stepped.collect()}
    assert got == {i: f"s{(i - 1) % 3}" if i else None for i in range(4000)}
    sizes = [r["count"] for r in _ranges(df, roles, 64).groupBy("__range").count().collect()]
    assert len(sizes) > 40 and max(sizes) < 400


def test_only_ids_with_splitters_are_cut(spark):
    rows = [(i, datetime(2024, 5, 1) + timedelta(days=j), f"s{j}", j) for i in range(600) for j in range(3)]
    df = spark.createDataFrame(rows, "id int, at timestamp_ntz, stage string, tie int").repartition(5)
    roles = Roles(id="id", snapshot="at", stage="stage", tie=("tie",))
    got = {(r["id"], r["tie"]): r[PREVIOUS] and r[PREVIOUS]["stage"] for r in with_previous(df, roles, ranges=8).collect()}
    assert got == {(i, j): f"s{j - 1}" if j else None for i in range(600) for j in range(3)}
    assert _ranges(df, roles, 8).filter("__range > 0").count() <= 3 * 8


def _ranges(df, roles, ranges):
    """The rows as they are dealt, read from the plan's own range column."""
    seen = {}
    drop = type(df).drop

    def keep(self, *names):
        if names == ("__range", "__carried"):
            seen["df"] = self
        return drop(self, *names)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(df), "drop", keep)
        with_previous(df, roles, ranges)
    return seen["df"]


def test_features_do_not_depend_on_the_layout(spark, skewed):
    plain = rows_of(add_features(skewed, ROLES, ALL))
    assert rows_of(add_features(skewed.repartition(1), ROLES, ALL)) == plain
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows_of(add_features(skewed, ROLES, ALL)) == plain
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_building_features_runs_no_job(spark, skewed):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "building only")
    try:
        add_features(skewed, ROLES, ALL)
        assert list(tracker.getJobIdsForGroup("build")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_no_rows_of_an_id_are_gathered(skewed):
    plan = add_features(skewed, ROLES, [n for n in ALL if n != "user_activity_rating"])._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "windowspecdefinition(id" not in plan


def test_lookup_join_keeps_every_row(spark, skewed):
    table = spark.createDataFrame([(1, "x"), (2, "y"), (99, "z")], "id int, name string")
    expected = rows_of(skewed.join(table, ["id"], "left").select(*skewed.columns, "name"))
    assert rows_of(lookup_join(skewed, table, ["id"])) == expected


def test_null_keys_are_spread(spark):
    rows = spark.range(5000).select(F.lit(None).cast("int").alias("id"), F.col("id").alias("n"))
    table = spark.range(10).select(F.col("id").cast("int").alias("id"), F.lit("x").alias("name"))
    joined = lookup_join(rows, table.hint("merge"), ["id"])
    held = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 5000 and max(held) < 5000


def test_dedup_sends_one_row_per_key_and_task(skewed):
    plan = latest_snapshot(skewed, ROLES)._jdf.queryExecution().executedPlan().toString()
    partial, exchange = plan.rindex("WindowGroupLimit"), plan.index("Exchange hashpartitioning")
    assert partial > exchange  # the limit runs below, that is before, the exchange
