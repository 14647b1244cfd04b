"""Hierarchical navigable small-world graphs over shards of vectors.

A shard's graph is a few flat arrays: for every layer the nodes in it and a matrix of
their neighbours. Neighbours are chosen from a node's nearest for diversity, with the
reverse links added; a shard has a fixed greatest size, so building it by blocks of
products costs the same whatever the table's size. Searches run many queries in step.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplens.llm.common import bucket_count, mix, plain, saved

SHARD = 16_384  # vectors
LINKS = 12  # chosen neighbours in upper layers; twice as many at the bottom
NEAR = 48  # nearest candidates a node chooses from
PART = 65_536  # queries of one searching task
TOGETHER = 256  # queries searched in step
AUDITED = 64  # queries of a task that are also answered exactly


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Graph:
    """``x``: different vectors, ``layers``: (nodes, neighbours) from the top down."""

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.layers = x, layers

    def search(self, queries: np.ndarray, beam: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ``beam`` best nodes found and their products (-1, -inf: none).

        ``start`` may name a node per query (-1: none) from which the bottom layer is walked too.
        """
        start = np.full(len(queries), -1) if start is None else start
        found = [self._together(queries[i : i + TOGETHER], beam, start[i : i + TOGETHER]) for i in range(0, len(queries), TOGETHER)]
        if not found:
            return np.zeros((0, beam), np.int64), np.zeros((0, beam), np.float32)
        return tuple(np.concatenate(parts) for parts in zip(*found))

    def _together(self, q: np.ndarray, beam: int, start: np.ndarray):
        n, rows = len(self.x), np.arange(len(q))[:, None]
        top = self.layers[0][0]
        ids = np.broadcast_to(top, (len(q), len(top)))
        sims = q @ self.x[top].T
        for depth, (nodes, links) in enumerate(self.layers):
            width = beam if depth == len(self.layers) - 1 else min(beam, 16)
            if depth == len(self.layers) - 1:
                fresh = np.where((ids == start[:, None]).any(axis=1), -1, start)
                product = np.where(fresh < 0, -np.inf, (self.x[fresh] * q).sum(axis=1))
                ids, sims = np.concatenate([ids, fresh[:, None]], axis=1), np.concatenate([sims, product[:, None].astype(np.float32)], axis=1)
            ids, sims = _best(ids, sims, width)
            seen = np.zeros((len(q), n + 1), bool)
            seen[rows, ids] = True
            done = ids < 0
            at = np.full(n + 1, -1)
            at[nodes] = np.arange(len(nodes))
            while True:
                open_ = np.where(done, -np.inf, sims)
                pick = np.argpartition(-open_, min(3, width - 1), axis=1)[:, :4] if width > 4 else np.broadcast_to(np.arange(width), (len(q), width))
                live = np.isfinite(np.take_along_axis(open_, pick, 1))
                active = np.flatnonzero(live.any(axis=1))
                if not len(active):
                    break
                done[rows[active], pick[active]] |= live[active]
                step = np.where(live[active], np.take_along_axis(ids[active], pick[active], 1), -1)
                near = links[at[step]].copy()  # at[-1] is -1: the spare last row, all -1
                near = np.sort(near.reshape(len(active), -1), axis=1)
                near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
                near[seen[active[:, None], near]] = -1
                seen[active[:, None], near] = True
                seen[:, n] = False
                new = np.einsum("awd,ad->aw", self.x[near], q[active])
                new[near < 0] = -np.inf
                if not np.isfinite(new).any():
                    continue
                both = np.concatenate([sims[active], new], axis=1)
                keep = np.argpartition(-both, width - 1, axis=1)[:, :width]
                sims[active] = np.take_along_axis(both, keep, 1)
                ids[active] = np.take_along_axis(np.concatenate([ids[active], near], axis=1), keep, 1)
                old = np.concatenate([done[active], near < 0], axis=1)
                done[active] = np.take_along_axis(old, keep, 1)
        return ids, sims


def _best(ids: np.ndarray, sims: np.ndarray, width: int):
    if ids.shape[1] < width:
        short = width - ids.shape[1]
        return np.pad(ids, ((0, 0), (0, short)), constant_values=-1), np.pad(sims, ((0, 0), (0, short)), constant_values=-np.inf)
    keep = np.argpartition(-sims, width - 1, axis=1)[:, :width]
    return np.take_along_axis(ids, keep, 1), np.take_along_axis(sims, keep, 1)


def build(x: np.ndarray) -> Graph:
    """The graph of different vectors. Nearness while building: cosine after a component is
    added that makes all lengths equal, under which the largest product is the nearest."""
    norm = (x.astype(np.float64) ** 2).sum(axis=1)
    extra = np.sqrt(np.maximum(norm.max() - norm, 0))
    even = np.concatenate([x, extra[:, None]], axis=1).astype(np.float32) / np.float32(np.sqrt(norm.max()))
    u = (mix(np.arange(len(x), dtype=np.uint64) + np.uint64(7)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    level = np.floor(-np.log(np.maximum(u, 1e-15)) / np.log(LINKS)).astype(int)
    layers, depth = [], 0
    while True:
        nodes = np.flatnonzero(level >= depth)
        if depth and not len(nodes):
            break
        layers.append((nodes, _links(even, nodes, LINKS * 2 if depth == 0 else LINKS)))
        if len(nodes) <= LINKS:
            break
        depth += 1
    return Graph(x, layers[::-1])


def _links(x: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """Neighbours of each node of a layer (-1: none), with one spare row of none."""
    own, n = x[nodes], len(nodes)
    near = min(NEAR, n - 1)
    chosen = np.full((n, most), -1)
    for start in range(0, n if near else 0, 512):
        block = own[start : start + 512]
        sims = block @ own.T
        sims[np.arange(len(block)), np.arange(start, start + len(block))] = -np.inf
        cand = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        cand = np.take_along_axis(cand, np.argsort(-np.take_along_axis(sims, cand, 1), axis=1, kind="stable"), 1)
        close = np.take_along_axis(sims, cand, 1)
        between = np.einsum("bid,bjd->bij", own[cand], own[cand])
        taken = np.zeros((len(block), near), bool)
        for j in range(near):  # a candidate nearer to one already chosen than to the node is passed over
            nearer = (taken[:, :j] & (between[:, j, :j] > close[:, j, None])).any(axis=1) if j else False
            taken[:, j] = np.logical_not(nearer) & (taken.sum(axis=1) < most)
        order = np.argsort(~taken, axis=1, kind="stable")[:, :most]  # what was passed over fills up
        chosen[start : start + len(block), : order.shape[1]] = np.take_along_axis(cand, order, 1)
    (a, turn), b = np.nonzero(chosen >= 0), chosen[chosen >= 0]
    order = np.lexsort((a, turn, b))  # reverse links of the nodes that chose this one first come first
    a, b = a[order], b[order]
    nth = np.arange(len(b)) - np.searchsorted(b, b, "left")
    back = np.full((n, most), -1)
    back[b[nth < most], nth[nth < most]] = a[nth < most]
    # nodes that no list holds are strung on a chain that starts at their nearest one
    held = np.zeros(n, bool)
    held[b] = held[back[back >= 0]] = True
    lost = np.flatnonzero(~held)
    chain = np.full((n, 2), -1)
    if near and len(lost):
        hub = chosen[lost, 0]
        order = np.argsort(hub, kind="stable")
        lost, hub = lost[order], hub[order]
        head = np.concatenate(([True], hub[1:] != hub[:-1]))
        chain[hub[head], 0] = lost[head]
        chain[lost[:-1][~head[1:]], 1] = lost[1:][~head[1:]]
    links = np.concatenate([chosen, back, chain], axis=1)
    return np.concatenate([np.where(links >= 0, nodes[links], -1), np.full((1, links.shape[1]), -1)]).astype(np.int64)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision."""
    return (a.astype(np.float64) * b.astype(np.float64)).sum(axis=-1)


def shard_index(vectors: DataFrame) -> DataFrame:
    """``shard``, ``data``: the flat arrays of each shard's graph. ``vectors``: vec_id, v (usable)."""
    shards = bucket_count(vectors.count(), SHARD)

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        raw = np.stack(frame["v"].to_numpy()).astype(np.float64)
        kinds, member = np.unique(raw, axis=0, return_inverse=True)
        order = np.argsort(member, kind="stable")
        graph = build(kinds.astype(np.float32))
        flat = {"vectors": kinds, "layers": graph.layers, "members": frame["vec_id"].to_numpy()[order],
                "ends": np.cumsum(np.bincount(member))}
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "data": [pickle.dumps(flat, 5)]})

    placed = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v")
    return saved(placed.groupBy("shard").applyInPandas(make, "shard int, data binary"), "index")


def search_shards(vectors: DataFrame, queries: DataFrame, answer, schema: str, once: bool = False) -> DataFrame:
    """Every query against every shard: ``answer(index, graph, queries, rows, first)`` per shard and part of the queries.

    ``queries`` has the columns vec_id, v and any others, which ``answer`` gets as a frame by vec_id.
    ``first`` is true for one part of each shard. A part holds ``PART`` queries, so a
    task's memory does not grow; a shard's arrays are read once for each part. With ``once`` (queries
    are the vectors) a pair of shards meets once: queries go to their own shard and to later ones.
    """
    index = shard_index(vectors)
    shards = sorted(r["shard"] for r in index.select("shard").collect())
    count = bucket_count(vectors.count(), SHARD)
    parts = bucket_count(queries.count(), PART)
    part = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(parts)).cast("int")
    own = F.pmod(F.xxhash64("vec_id"), F.lit(count))
    asked = F.array(*map(F.lit, shards)) if shards else F.array().cast("array<int>")
    asked = F.filter(asked, lambda s: s >= own) if once else asked
    dealt = queries.withColumn("part", part).withColumn("shard", F.explode(asked))
    copies = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        flat = pickle.loads(left["data"].iloc[0])
        right = right.sort_values("vec_id", ignore_index=True)
        rows = np.stack(right["v"].to_numpy()).astype(np.float64) if len(right) else np.zeros((0, flat["vectors"].shape[1]))
        return answer(flat, Graph(flat["vectors"].astype(np.float32), flat["layers"]), right, rows, int(left["part"].iloc[0]) == 0)

    return copies.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part")).applyInPandas(run, schema)


def prepared(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    value = plain(vector).cast("array<double>")
    return vectors.select(plain(vec_id).cast("long").alias("vec_id"), value.alias("v"), usable(value).alias("fit"))
