"""Near copies among embeddings, from one graph per shard and exact verification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplens.llm.common import saved
from snaplens.llm.components import components
from snaplens.llm.hnsw import AUDITED, exact, prepared, search_shards

BEAM = 16
RECALL = 0.995  # of the links of a task's audited vectors
WIDEST = 128  # beam beyond which products with the whole shard cost less
TOGETHER = 256  # queries whose links are settled at once
PAIRS = 65_536  # pairs whose cosines are taken at once


def cosine_components(vectors: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept``: one row for each row of ``vectors``.

    Vectors link if their cosine in double precision is at least ``cosine``. Each pair of shards meets once: the
    vectors of the one ask the other's graph, starting from their own node where they have one. A beam
    filled with links alone is doubled for its vector, and the beam of all is doubled until the audited
    vectors (those found with links first, without their own nodes) find ``RECALL`` of their links; past ``WIDEST`` or an eighth of the shard
    the products are taken with all of it, which is exact. Tasks return numbers of links and the components they saw as
    stars, never all pairs. Vectors that are null, zero or hold null or non-finite components link
    with nothing; all others must have one length. Rows of one id share their links: the other rows linked to any of
    them. Rows without id link with nothing and have no component. Other columns are not read.
    """
    rows = prepared(vectors, vec_id, vector)
    fit = rows.filter("fit AND vec_id IS NOT NULL").select("vec_id", "v")

    def answer(flat, graph, asked, queries, first):
        kinds, members, ends = flat["vectors"], flat["members"], flat["ends"]
        ids, copies = asked["vec_id"].to_numpy().astype(np.int64), asked["copies"].to_numpy().astype(np.int64)
        times, begins = np.diff(np.concatenate([[0], ends])), np.concatenate([[0], ends[:-1]])
        lead = members[begins]  # the smallest id of equal vectors stands for them
        units = kinds / np.linalg.norm(kinds, axis=1, keepdims=True)
        graph.x = units.astype(np.float32)
        q = queries / np.linalg.norm(queries, axis=1, keepdims=True) if len(ids) else queries
        here = np.isin(ids, members)
        own = _own_nodes(ids, queries, here, members, kinds, times)
        counts, back = np.zeros(len(ids), np.int64), np.zeros(len(kinds), np.int64)
        labels = _Labels(len(ids) + len(kinds))

        def settle(who, a, b, near=None):
            """Counts the true links among the pairs of query ``a`` and node ``b``; ``near`` are their cosines, if known."""
            if near is None:
                near = np.concatenate([exact(units[b[i : i + PAIRS]], q[a[i : i + PAIRS]]) for i in range(0, len(a), PAIRS)] or [np.zeros(0)])
            a, b = a[near >= cosine], b[near >= cosine]
            counts[who] = np.bincount(a, times[b] - (own[a] == b), minlength=len(ids)).astype(np.int64)[who]
            away = ~here[a]
            np.add.at(back, b[away], copies[a[away]])
            labels.join(a, len(ids) + b)

        def walk(some, beam):
            found, sims = graph.search(q[some].astype(np.float32), beam, own[some])
            return found, sims >= cosine - 1e-5, sims.min(axis=1) >= cosine - 1e-5

        beam, limit = BEAM, max(BEAM, min(WIDEST, len(kinds) // 8))
        audit = _audited(walk, len(ids), own)
        while len(audit) and beam <= limit:
            truth = (q[audit] @ units.T >= cosine).sum(axis=1) - (own[audit] >= 0)
            found, near, full = walk(audit, beam)
            seen = (near & (found != own[audit][:, None])).sum(axis=1)
            if seen[~full].sum() >= RECALL * truth[~full].sum():
                break
            beam *= 2
        todo = np.arange(len(ids))
        while len(todo) and beam <= limit:
            again = []
            for start in range(0, len(todo), 4096):
                some = todo[start : start + 4096]
                found, near, full = walk(some, beam)
                a, b = np.nonzero(near & ~full[:, None])
                settle(some[~full], some[a], found[a, b])
                again.append(some[full])
            todo, beam = np.concatenate(again), beam * 2
        for start in range(0, len(todo), TOGETHER):
            some = todo[start : start + TOGETHER]
            near = q[some] @ units.T
            a, b = np.nonzero(near >= cosine - 1e-9)
            near = near[a, b]
            close = np.flatnonzero(near < cosine + 1e-9)  # the order of summation may decide these
            near[close] = exact(units[b[close]], q[some[a[close]]])
            settle(some, some[a], b, near)
        who = np.concatenate([ids, lead])
        u, v = labels.edges()
        edges = [who[u], who[v]]
        if first:  # equal vectors
            equal = np.repeat(times > 1, times)
            edges = [np.concatenate([edges[0], members[equal]]), np.concatenate([edges[1], np.repeat(lead, times)[equal]])]
        reached = np.repeat(back, times)
        per_id = pd.DataFrame({"vec_id": np.concatenate([ids, members[reached > 0]]), "n": np.concatenate([counts, reached[reached > 0]])})
        stars = pd.DataFrame({"u": edges[0], "v": edges[1]}).drop_duplicates()
        return pd.concat([per_id, stars])[["vec_id", "n", "u", "v"]].astype("Int64")

    asked = fit.groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    found = saved(search_shards(fit, asked, answer, "vec_id long, n long, u long, v long", once=True), "links")
    counts = found.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    groups = components(found.filter("u IS NOT NULL").select("u", "v")).withColumnRenamed("node", "vec_id")
    return (
        rows.select("vec_id", "fit").join(counts, "vec_id", "left").join(groups, "vec_id", "left")
        .select("vec_id", F.when(F.col("fit"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
                F.when(F.col("fit"), F.coalesce("component", "vec_id")).otherwise(F.col("vec_id")).alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )


def _own_nodes(ids, queries, here, members, kinds, times) -> np.ndarray:
    """The node that holds each query's own vector, -1 in other shards."""
    own = np.full(len(ids), -1)
    if here.any():
        node = np.repeat(np.arange(len(kinds)), times)
        order = np.argsort(members, kind="stable")
        at = np.searchsorted(members[order], ids[here])
        held = node[order[at]]
        wrong = np.flatnonzero(~(kinds[held] == queries[here]).all(axis=1))  # an id with several vectors
        for i in wrong:
            held[i] = np.flatnonzero((kinds == queries[here][i]).all(axis=1))[0]
        own[here] = held
    return own


def _audited(walk, n: int, own: np.ndarray) -> np.ndarray:
    """Queries to audit: those with a link, of a thousand walked first, and some more."""
    even = np.unique(np.linspace(0, n - 1, min(1024, n)).astype(int)) if n else np.zeros(0, int)
    if not len(even):
        return even
    found, near, _ = walk(even, BEAM)
    linked = even[(near & (found != own[even][:, None])).any(axis=1)]
    return np.unique(np.concatenate([linked[:: max(1, len(linked) // AUDITED)][:AUDITED], even[:: max(1, len(even) // AUDITED)][:AUDITED]]))


class _Labels:
    """Components of numbered things, joined many pairs at a time."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        u = np.flatnonzero(self.label != np.arange(len(self.label)))
        return u, self.label[u]
