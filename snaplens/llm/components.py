"""Connected components of an edge table, by alternating star contractions.

Each round rewires edges to the smallest neighbour (large star, then small star)
with joins and grouped minima. No node's neighbours are gathered in one place: the
minima combine map-side and the joins can be split by adaptive execution. Rounds
end when the edges no longer change; they are then a star around each smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplens.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """Columns ``node``, ``component`` for every node that has an edge.

    ``edges`` has the columns ``u`` and ``v`` (any ordered type). Self-loops, nulls
    and repeated edges are ignored; without edges the result is empty. The component
    is its smallest node.
    """
    kept = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = saved(kept.distinct(), "edges")
    state = _state(now)
    while True:
        large = _large_star(now)
        now = saved(_small_star(large), "edges")
        after = _state(now)
        if after == state:
            break
        state = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(centres)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
