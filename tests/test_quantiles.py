"""Radix quantiles against numpy, for all shapes of values."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from snaplens.operators.quantiles import column_quantiles, group_quantiles, long_quantiles, sort_key

PROBS = [0.0, 0.25, 0.33, 0.5, 0.75, 0.99, 1.0]


def values(kind, n, rng):
    if kind == "uniform":
        return [rng.uniform(-1e6, 1e6) for _ in range(n)]
    if kind == "heavy_tail":
        return [math.exp(rng.gauss(0, 8)) for _ in range(n)]
    if kind == "one_value_dominates":  # runs at and around the wanted ranks
        return [5.0 if rng.random() < 0.6 else rng.uniform(0, 10) for _ in range(n)]
    if kind == "few_values":
        return [float(rng.randint(0, 3)) for _ in range(n)]
    if kind == "last_bits":  # equal but for the last bits
        return [1.0 + rng.randint(0, 5000) * 2.0**-52 for _ in range(n)]
    return [7.0] * n


def test_keys_have_the_order_of_the_doubles(spark):
    rng = random.Random(3)
    vs = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 1.7976931348623157e308, math.inf, -math.inf, 2.2250738585072009e-308]
    vs += [s * 2.0**e * f for e in range(-1074, 1024) for s, f in ((1, 1.0), (-1, 1.0), (1, 1 - 2.0**-53), (1, 1 + 2.0**-52))]
    vs += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(5000)]
    vs = sorted(v for v in vs if not math.isnan(v))
    got = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "i int, v double").select("i", sort_key(F.col("v"))).collect()
    keys = [k for _, k in sorted(got)]
    assert keys == sorted(keys) and len(set(keys)) > 0.9 * len(set(vs))


@pytest.mark.parametrize("kind", ["uniform", "heavy_tail", "one_value_dominates", "few_values", "last_bits", "constant"])
def test_groups_match_numpy(spark, kind):
    rng = random.Random(kind)
    groups = {"hot": values(kind, 1500, rng), "cold": values(kind, 40, rng), "odd": values(kind, 501, rng), "one": values(kind, 1, rng)}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    rows += [("hot", None), ("hot", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r["q"] for r in group_quantiles(df, ["g"], "v", PROBS).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(vs, PROBS)), rel=1e-12, abs=1e-12)


def test_whole_columns_match_numpy(spark):
    rng = random.Random(1)
    a, b = values("heavy_tail", 700, rng), values("last_bits", 60, rng) + [None] * 640
    df = spark.createDataFrame(list(zip(a, b)), "a double, `b.c` double")
    got = column_quantiles(df, ["a", "b.c"], PROBS)
    assert got["a"] == pytest.approx(list(np.quantile(a, PROBS)))
    assert got["b.c"] == pytest.approx(list(np.quantile(b[:60], PROBS)), rel=1e-15)


def test_infinite_values(spark):
    vs = [float("inf")] * 80 + [float("-inf")] * 80 + [float(i) for i in range(141)]
    df = spark.createDataFrame([(v,) for v in vs], "v double")
    assert column_quantiles(df, ["v"], [0.0, 0.5, 1.0])["v"] == [float("-inf"), 70.0, float("inf")]


def test_several_columns_per_group(spark):
    rng = random.Random(2)
    rows = [(i % 3 == 0, rng.random(), rng.randint(0, 50)) for i in range(900)]
    df = spark.createDataFrame(rows, "g boolean, x double, y int")
    got = {(r["g"], r["column"]): r["q"] for r in long_quantiles(df, ["x", "y"], [0.5], ["g"]).collect()}
    for g in (True, False):
        for i, c in enumerate("xy", start=1):
            assert got[g, c][0] == pytest.approx(np.median([r[i] for r in rows if r[0] is g]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "v double")
    assert column_quantiles(df, ["v"], [0.5]) == {"v": [None]}


def test_one_lazy_plan_without_sorting_values(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"), (F.col("id") % 3).alias("g"))
    plan = group_quantiles(df, ["g"], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_" not in plan and plan.count("HashAggregate") >= 6
