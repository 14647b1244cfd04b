"""Embedding dedup and nearest neighbours over several shards, with planted links, dense groups and repeated ids."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from snaplens.llm import embedding_dedup, hnsw
from snaplens.llm.ann import nearest
from snaplens.llm.embedding_dedup import cosine_components


def links_of(ids, x, cosine=0.95):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        least = np.array([min(label[i], label[near[i]].min(initial=label[i])) for i in range(len(ids))])
        if (least == label).all():
            return near.sum(axis=1), label
        label = least


def planted(n=3000, width=32, seed=5):
    """Random vectors, pairs and chains of near copies among them, and one group of 300."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    for i in range(0, 400, 2):
        x[i + 1] = x[i] + 0.2 * rng.normal(size=width) * np.linalg.norm(x[i]) / width**0.5
    for i in range(400, 500):
        x[i] = x[i - 1] + 0.25 * rng.normal(size=width) * np.linalg.norm(x[i - 1]) / width**0.5
    x[600:900] = x[600] + 0.05 * rng.normal(size=(300, width))
    x[900:905] = x[900]
    order = rng.permutation(n)
    return np.arange(n) * 3, x[order]


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(4)


@pytest.mark.parametrize("shard", [700, 16_384])
def test_planted_links_over_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(hnsw, "SHARD", shard)
    ids, x = planted()
    n_links, label = links_of(ids, x)
    assert n_links.sum() > 90_000 and (n_links == 1).sum() > 100
    got = {r["vec_id"]: r for r in cosine_components(table(spark, ids, x)).collect()}
    wrong = [i for i, n, c in zip(ids.tolist(), n_links.tolist(), label.tolist()) if (got[i]["n_links"], got[i]["component_id"]) != (n, c)]
    assert len(got) == len(ids) and wrong == []


def test_every_vector_finds_itself():
    x = np.random.default_rng(1).normal(size=(6000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.build(x)
    reached, front = np.zeros(len(x), bool), np.array(graph.layers[0][0])
    for nodes, links in graph.layers:  # everything that links lead to from the top
        at = np.full(len(x), -1)
        at[nodes] = np.arange(len(nodes))
        seen = np.zeros(len(x), bool)
        seen[front] = True
        while len(front):
            near = np.unique(links[at[front]])
            near = near[(near >= 0)]
            front = near[~seen[near]]
            seen[front] = True
        front = np.flatnonzero(seen)
        reached |= seen
    assert reached.all()
    found, _ = graph.search(x, 16, np.arange(len(x)))
    assert (found == np.arange(len(x))[:, None]).any(axis=1).all()


def test_dense_groups_are_settled_in_blocks():
    labels = embedding_dedup._Labels(10)
    labels.join(np.array([9, 8, 3, 5]), np.array([8, 7, 5, 9]))
    assert labels.label.tolist() == [0, 1, 2, 3, 4, 3, 6, 3, 3, 3]


def test_repeated_ids(spark):
    ids, x = [1, 1, 2, 20, 20, 7], np.array([[1.0, 0.0]] * 5 + [[0.0, 1.0]])
    rows = table(spark, ids, x)
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in cosine_components(rows).collect())
    assert got == {(1, 4, 1): 2, (2, 4, 1): 1, (20, 4, 1): 2, (7, 0, 7): 1}
    near = sorted(tuple(r)[:3] for r in nearest(rows, F.col("vec_id") == 20, k=3).collect())
    assert near == [(20, 1, 1), (20, 2, 2), (20, 3, 7)]
