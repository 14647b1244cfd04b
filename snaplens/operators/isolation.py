"""One-dimensional isolation forest (Liu, Ting and Zhou, 2008).

A tree over one column is a step function from value to path length, so a forest
is one step function too. Trees are grown in parallel on small hashed samples and
their steps (at most a few hundred per tree) are added up. One pass counts the rows of
each step; the counts tell the path length below which values are outliers. What lies
below is a set of intervals, and these make the predicate that rows are tested with: no
Python runs there, and its outer bounds can reach the scan.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplens.operators.skew import key_hash
from snaplens.roles import col

# What runs on workers travels by value: they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Forest size, rows per tree, seed.
TREES, TREE_ROWS, SEED = 100, 256, 42
_BITS = 1 << 31


def mean_path(n: int) -> float:
    """Average path length of an unsuccessful search among ``n`` values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(values: np.ndarray, rng: np.random.Generator) -> list[tuple[float, float]]:
    """Steps ``(edge, path)``: the path length of values above ``edge``, up to the next edge."""
    values = np.sort(values)
    limit = int(np.ceil(np.log2(max(len(values), 2))))
    steps, todo = [], [(0, len(values), 0, -np.inf)]
    while todo:
        start, stop, depth, edge = todo.pop()
        low, high = values[start], values[stop - 1]
        if depth >= limit or stop - start <= 1 or low == high:
            steps.append((edge, depth + mean_path(stop - start)))
            continue
        cut = rng.uniform(low, high)
        middle = int(np.searchsorted(values, cut, side="right"))
        middle = min(max(middle, start + 1), stop - 1)
        todo.append((start, middle, depth + 1, edge))
        todo.append((middle, stop, depth + 1, cut))
    return sorted(steps)


def _grow(tree: pd.DataFrame) -> pd.DataFrame:
    number = int(tree["tree"].iloc[0])
    steps = grow_tree(tree["v"].to_numpy(), np.random.default_rng([SEED, number]))
    edges, paths = np.array(steps).T
    return pd.DataFrame({"edge": edges, "rise": np.diff(paths, prepend=0.0)})


def _samples(df: DataFrame, column: str, n: int, row_key: Sequence[str], trees: int, tree_rows: int) -> DataFrame:
    """At most ``tree_rows`` rows for each tree, chosen by hash so that reruns agree.

    A first hash thins the table to a pool of bounded expected size; within it each
    tree draws its own rows.
    """
    pool_rows = 2 * trees * tree_rows
    share = min(1.0, pool_rows / n)
    per_tree = min(1.0, 1.3 * tree_rows / min(n, pool_rows))
    picked = F.filter(
        F.sequence(F.lit(1), F.lit(trees)),
        lambda t: F.pmod(F.xxhash64("h", t), F.lit(_BITS)) < F.lit(int(per_tree * _BITS)),
    )
    # Without a key rows are told apart by position, so that copies are drawn one by one.
    identity = key_hash(row_key) if row_key else F.monotonically_increasing_id()
    pool = df.filter(col(column).isNotNull()).select(col(column).cast("double").alias("v"), identity.alias("h"))
    drawn = (
        pool.filter(F.pmod(F.xxhash64("h"), F.lit(_BITS)) < F.lit(int(share * _BITS)))
        .select("v", "h", F.explode(picked).alias("tree"))
    )
    order = Window.partitionBy("tree").orderBy(F.xxhash64("tree", "h"), "v")
    return drawn.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= tree_rows)


@dataclass(frozen=True)
class Forest:
    """Path length ``heights[i]`` for values above ``edges[i - 1]``, up to ``edges[i]``."""

    edges: np.ndarray
    heights: np.ndarray


def grow_forest(
    df: DataFrame, column: str, n: int, row_key: Sequence[str], trees: int = TREES, tree_rows: int = TREE_ROWS
) -> Forest:
    """Mean path length over ``trees`` trees; at most ``trees * tree_rows`` steps reach the driver."""
    steps = (
        _samples(df, column, n, row_key, trees, tree_rows)
        .select("tree", "v")
        .groupBy("tree")
        .applyInPandas(_grow, "edge double, rise double")
        .groupBy("edge")
        .agg(F.sum("rise").alias("rise"))
        .toPandas()
        .sort_values("edge")
    )
    return Forest(steps["edge"].to_numpy()[1:], np.cumsum(steps["rise"].to_numpy()) / trees)  # the first is minus infinity


def step_counts(df: DataFrame, column: str, forest: Forest) -> np.ndarray:
    """Rows in each step of the forest; a task sends one row per step it met."""
    edges, size = forest.edges, len(forest.heights)

    def count(batches):
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(np.searchsorted(edges, batch.column(0).to_numpy(), side="left"), minlength=size)
        met = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(held[met])], names=["step", "n"])

    values = df.filter(col(column).isNotNull()).select(col(column).cast("double").alias("v"))
    found = values.mapInArrow(count, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[found["step"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def share_cut(heights: np.ndarray, counts: np.ndarray, share: float) -> float:
    """The path length at quantile ``share`` of the rows, between its two neighbours in proportion."""
    order = np.argsort(heights, kind="stable")
    upto, ordered = np.cumsum(counts[order]), heights[order]
    at = share * (upto[-1] - 1)
    low, high = (ordered[np.searchsorted(upto, place, side="right")] for place in (np.floor(at), np.ceil(at)))
    return float(low + (at - np.floor(at)) * (high - low))


def short_intervals(forest: Forest, counts: np.ndarray, cut: float) -> list[tuple[float, float]]:
    """Where paths are shorter than ``cut``, as few intervals ``(above, up to)`` as the rows allow.

    Steps without rows go with the step before them (the first ones with the one after), so
    every counted row is told as by its path length.
    """
    met = np.flatnonzero(counts)
    short = forest.heights[met] < cut
    begins = np.concatenate([[0], np.flatnonzero(short[1:] != short[:-1]) + 1])
    bounds = [-np.inf, *(float(forest.edges[met[i] - 1]) for i in begins[1:]), np.inf]
    return [(bounds[k], bounds[k + 1]) for k, i in enumerate(begins) if short[i]]


def within(value: Column, intervals: Sequence[tuple[float, float]]) -> Column:
    """Whether ``value`` lies in one of the sorted intervals ``(above, up to)``.

    Those without a bound on one side are comparisons that a scan understands. The others are
    found by bisection over a constant array: as many steps as the number of bounds has bits.
    """
    tests = [value <= F.lit(high) for low, high in intervals[:1] if low == -np.inf]
    tests += [value > F.lit(low) for low, high in intervals[-1:] if high == np.inf]
    inner = [bound for pair in intervals if np.isfinite(pair).all() for bound in pair]
    if inner:
        bounds = F.split(F.lit(",".join(map(repr, inner))), ",").cast("array<double>")
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(inner).bit_length()))])
        below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            (at + step <= F.lit(len(inner))) & (F.get(bounds, at + step - F.lit(1)) < value), at + step).otherwise(at))
        tests.append(below % 2 == 1)
    return reduce(or_, tests) if tests else F.lit(False)
