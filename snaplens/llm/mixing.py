"""Mixing sources to target weights by a splitting tree of exact block quotas.

A source's documents fall into permuted blocks by the hash of their content. Its
target says how often every block is taken and which share of the blocks once more.
The block quotas of all sources are split over the output shards by a binary tree of
multivariate hypergeometric draws; each shard then owns a run of every source's
permuted blocks, disjoint from the other shards', and is shuffled on its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplens.llm.common import WORD, plain, saved

BLOCKS = 256  # per source; the block at the target's edge is cut once more, as fine
AT_MOST = 3.0  # times its size that a source, and so a document, may be taken
SHARDS = 16
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Mix:
    """``sizes``: one row per document with the draws that take it. ``draws``: one row per block taken."""

    sizes: DataFrame
    draws: DataFrame
    docs: DataFrame


def targets(sizes: Mapping[str | None, int], weights: Sequence[float] = (1, 2, 3)) -> dict[str | None, float]:
    """Words to take of each source: weights repeat by code point, null last.

    Shares of the whole by weight; a source stops at ``AT_MOST`` times its size and
    the excess goes to the others by weight until none is above.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = float(sum(sizes.values()))
    full: dict[str | None, float] = {}
    while True:
        rest = [s for s in names if s not in full]
        left, shares = total - sum(full.values()), sum(weight[s] for s in rest)
        found = {s: left * weight[s] / shares for s in rest} if rest else {}
        above = {s: AT_MOST * sizes[s] for s, x in found.items() if x > AT_MOST * sizes[s]}
        if not above:
            return {**full, **found}
        full |= above


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas per shard (shards x sources): halves get exact multivariate hypergeometric draws."""
    if shards == 1:
        return quotas[None]
    left = shards // 2
    take = int(quotas.sum()) * left // shards
    drawn = rng.multivariate_hypergeometric(quotas, take, method="marginals")
    return np.concatenate([split_quotas(drawn, left, rng), split_quotas(quotas - drawn, shards - left, rng)])


def _hash(doc_id: str, text: str) -> Column:
    return F.xxhash64(plain(doc_id), plain(text), F.lit(0x6D6978))


def _block(h: Column) -> Column:
    return F.pmod(h, F.lit(BLOCKS)).cast("int")


def _sub(h: Column) -> Column:
    return F.pmod(F.shiftright(h, 20), F.lit(BLOCKS)).cast("int")


def plan_mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = (1, 2, 3), shards: int = SHARDS, seed: int = 0,
) -> Mix:
    """Plan a mix whose total is the total of all words; reruns give the same one.

    Null and blank texts have size 0: they are taken as often as their block and add no
    words. Null ids and repeated rows are rows like any other; rows equal in id and
    text share a block. An empty table gives an empty mix. The driver sees one row per
    source. Blocks, then sub-blocks are taken as long as they fit, and then the one
    document that closes the gap best, so a source misses its target by less than one
    sub-block (1/65,536 of it, or a document if that is more).
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(plain(text), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = saved(docs.select(plain(doc_id).alias("doc_id"), plain(source).cast("string").alias("source"), size.alias("size"), _hash(doc_id, text).alias("h")), "sizes")
    blocks = saved(sizes.groupBy("source", _block(F.col("h")).alias("block")).agg(F.sum("size").alias("words"), F.count("*").alias("rows")), "blocks")
    held = {r["source"]: r["words"] for r in blocks.groupBy("source").agg(F.sum("words").alias("words")).collect()}
    goal = targets(held, weights)

    # Every block `full` times; then permuted blocks until the rest is used up.
    schema = T.StructType.fromDDL("source string, source_size long, target double, full int, rest double")
    rows = []
    for s, x in held.items():
        full = min(int(goal[s] // x), int(AT_MOST)) if x else 0
        rows.append((s, x, float(goal[s]), full, float(goal[s] - full * x) if x else 0.0))
    by_source = spark.createDataFrame(rows, schema)
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed)), "block")  # BLOCKS rows at most
    ranked = (
        blocks.join(F.broadcast(by_source).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("once_more", F.col("upto") <= F.col("rest"))
        .withColumn("edge", ~F.col("once_more") & (F.col("upto") - F.col("words") < F.col("rest")))
    )
    ranked = saved(ranked, "ranked")

    # The block at the edge: its sub-blocks in order, as long as they fit.
    edge = ranked.filter("edge").select(F.col("source").alias("s"), F.col("block").alias("b"), (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))
    subs = (
        sizes.join(F.broadcast(edge), F.col("source").eqNullSafe(F.col("s")) & (_block(F.col("h")) == F.col("b")))
        .groupBy("source", "b", "left", _sub(F.col("h")).alias("sub")).agg(F.sum("size").alias("words"))
    )
    run = Window.partitionBy("source").orderBy("sub").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        subs.withColumn("upto", F.sum("words").over(run)).filter(F.col("upto") <= F.col("left"))
        .groupBy("source", F.col("b")).agg((F.max("sub") + 1).alias("cut"), F.max("upto").alias("fitted"))
        .select(F.col("source").alias("s2"), F.col("b").alias("b2"), "cut", "fitted")
    )
    plan = (
        ranked.join(cuts, F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")), "left")
        .select("source", "block", "rank", "source_size", "target", "full", "rest",
                F.when(F.col("once_more"), BLOCKS).otherwise(F.coalesce("cut", F.lit(0))).alias("cut"),
                F.when(F.col("once_more"), F.col("words")).otherwise(F.coalesce("fitted", F.lit(0))).alias("fitted"))
    )
    plan = saved(plan, "plan")

    # The document, taken less often than others, whose words come nearest to what is left.
    gaps = plan.groupBy("source").agg((F.max("rest") - F.sum("fitted")).alias("gap")).withColumnRenamed("source", "s")
    spare = plan.filter(F.col("cut") < BLOCKS).select(F.col("source").alias("s2"), F.col("block").alias("b2"), "cut")
    same = sizes.groupBy("source", "h").agg(F.sum("size").alias("words"))
    left_over = (
        same.join(_bounded(spare), F.col("source").eqNullSafe(F.col("s2")) & (_block(F.col("h")) == F.col("b2")) & (_sub(F.col("h")) >= F.col("cut")))
        .join(F.broadcast(gaps), F.col("source").eqNullSafe(F.col("s"))).filter(F.abs(F.col("words") - F.col("gap")) < F.col("gap"))
    )
    miss = F.struct(F.abs(F.col("words") - F.col("gap")), F.col("h"))
    picks = saved(left_over.groupBy("source").agg(F.min_by("h", miss).alias("pick")), "picks")

    quota = plan.groupBy("source").agg(F.sum(F.col("full") + (F.col("cut") > 0).cast("int")).alias("n")).collect()
    names = sorted((r["source"] for r in quota), key=lambda s: (s is None, s or ""))
    wanted = {r["source"]: int(r["n"]) for r in quota}
    share = split_quotas(np.array([wanted[s] for s in names], np.int64), shards, np.random.default_rng(seed)) if names else np.zeros((shards, 0), int)
    ends = spark.createDataFrame(
        [(s, [int(x) for x in np.cumsum(share[:, i])]) for i, s in enumerate(names)], "s string, ends array<int>")

    # A source's draws in a row: the partial pass first, then the full ones; shards own runs of it.
    nth = Window.partitionBy("source").orderBy("pass", "rank")  # AT_MOST * BLOCKS + 1 rows at most
    passes = F.concat(F.when(F.col("cut") > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")),
                      F.when(F.col("full") > 0, F.sequence(F.lit(1), F.col("full"))).otherwise(F.array().cast("array<int>")))
    draws = (
        plan.select("*", F.explode(passes).alias("pass")).withColumn("nth", F.row_number().over(nth) - 1)
        .join(F.broadcast(ends), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("mix_shard", F.size(F.filter("ends", lambda e: e <= F.col("nth"))))
        .select("source", "block", "pass", F.when(F.col("pass") == 0, F.col("cut")).otherwise(BLOCKS).alias("cut"), F.lit(None).cast("long").alias("pick"), "mix_shard")
    ).unionByName(picks.select("source", _block(F.col("pick")).alias("block"), F.lit(0).alias("pass"), F.lit(0).alias("cut"), "pick", F.pmod("pick", F.lit(shards)).cast("int").alias("mix_shard")))
    draws = saved(draws, "draws")

    # A block has AT_MOST + 2 draws at most; each row keeps those that take it.
    of_block = draws.groupBy(F.col("source").alias("s2"), F.col("block").alias("b2")).agg(F.collect_list(F.struct("pass", "cut", "pick", "mix_shard")).alias("drawn"))
    wide = plan.select(F.col("source").alias("s"), F.col("block").alias("b"), "source_size", "target")
    wide = wide.join(of_block, F.col("s").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2")), "left").drop("s2", "b2")
    joined = sizes.join(_bounded(wide), F.col("source").eqNullSafe(F.col("s")) & (_block(F.col("h")) == F.col("b")))
    takes = F.filter("drawn", lambda d: (_sub(F.col("h")) < d["cut"]) | F.coalesce(F.col("h") == d["pick"], F.lit(False)))
    places = F.transform(takes, lambda d: F.struct(d["mix_shard"].alias("mix_shard"), _order(F.col("h"), d["pass"], seed).alias("mix_order")))
    mixed = F.sort_array(F.coalesce(places, F.array().cast("array<struct<mix_shard:int,mix_order:bigint>>")))
    rows = joined.select("doc_id", "source", "size", "source_size", "target", mixed.alias("mixed"))
    return Mix(rows.withColumn("copies", F.size("mixed")), draws, docs)


def _order(h: Column, nth_pass: Column, seed: int) -> Column:
    return F.xxhash64(h, nth_pass, F.lit(seed))


def _bounded(table: DataFrame) -> DataFrame:
    """Broadcast a table of sources x blocks if it is as small as it should be."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, **options) -> DataFrame:
    """The mixed rows of ``docs``: a row for each time it is taken, with ``mix_shard`` and ``mix_order``.

    Sort a shard by ``mix_order`` to read it shuffled. See ``plan_mix`` for the rules.
    """
    plan = plan_mix(docs, doc_id, text, source, seed=seed, **options)
    draws = plan.draws.select(F.col("source").alias("__s"), F.col("block").alias("__b"), "pass", "cut", "pick", "mix_shard")
    rows = docs.select(F.struct(*map(plain, docs.columns)).alias("r"), plain(source).cast("string").alias("__source"), _hash(doc_id, text).alias("h"))
    taken = rows.join(_bounded(draws), F.col("__source").eqNullSafe(F.col("__s")) & (_block(F.col("h")) == F.col("__b")) & ((_sub(F.col("h")) < F.col("cut")) | (F.col("h") == F.col("pick"))))
    return taken.select(*[F.col("r").getField(c).alias(c) for c in docs.columns if c not in ("mix_shard", "mix_order")],
                        "mix_shard", _order(F.col("h"), F.col("pass"), seed).alias("mix_order"))
