"""Nearest neighbours by largest inner product, from one graph per shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplens.llm.hnsw import AUDITED, exact, prepared, search_shards

RECALL = 0.97  # of a task's audited queries; the beam is doubled until it is reached
BEAM = 64


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` nearest of each query.

    Candidates are all rows but the query's own id; ties go to the smaller id. Equal
    vectors are one node of the graph and answer with all their ids. Vectors that are
    null, zero or hold a null or non-finite component, and rows without id, take no part;
    all others must have one length. A repeated id counts once, by its best score. With fewer candidates than ``k`` all are returned.
    Other columns are not read; an empty table gives an empty result.
    """
    rows = prepared(vectors, vec_id, vector).filter("fit AND vec_id IS NOT NULL").withColumn("query", is_query)

    def answer(flat, graph, asked, queries, first):
        ids = asked["vec_id"].to_numpy().astype(np.int64)
        kinds, members, ends = flat["vectors"], flat["members"], flat["ends"]
        begins = np.concatenate([[0], ends[:-1]])
        want = min(k + 1, len(kinds))
        beam = max(BEAM, want)
        q = queries.astype(np.float32)
        audit = np.linspace(0, len(ids) - 1, min(AUDITED, len(ids))).astype(int)
        least = -np.sort(-(queries[audit] @ kinds.T), axis=1)[:, want - 1] - 1e-9 if len(ids) else np.zeros(0)
        while beam < len(kinds) and len(ids):
            found, _ = graph.search(q[audit], beam)
            hits = (exact(kinds[found], queries[audit][:, None]) >= least[:, None]) & (found >= 0)
            if np.minimum(hits.sum(axis=1), want).mean() >= RECALL * want:
                break
            beam *= 2
        beam = min(beam, len(kinds))
        found, _ = graph.search(q, beam) if len(ids) else (np.zeros((0, beam), int), None)
        out = []
        for i in range(len(ids)):
            node = found[i][found[i] >= 0]
            score = exact(kinds[node], queries[i][None])
            best = np.argsort(-score, kind="stable")[:want]
            node, score = node[best], score[best]
            each = [np.unique(members[begins[j] : ends[j]])[: k + 1] for j in node]  # smallest ids first, each once
            other, value = np.concatenate(each), np.repeat(score, [len(e) for e in each])
            keep = np.lexsort((other, -value))
            keep = keep[other[keep] != ids[i]][:k]
            out.append((np.full(len(keep), ids[i]), other[keep], value[keep]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols)))

    asked = rows.filter("query").select("vec_id", "v").dropDuplicates()
    found = search_shards(rows.select("vec_id", "v"), asked, answer, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
