"""Periodic runs against a search over all periods of each document."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from snaplens.llm import queries
from snaplens.llm.periodic import _batch, periodic_runs


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def all_runs(words, shortest=12):
    """Start, period and length of every run, one period after the other."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(shortest, 2 * q):
                found.setdefault((start, i - start + q), q)
    return sorted((s, q, n) for (s, n), q in found.items())


def collapsed(words, runs):
    dropped = {i for s, q, n in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def looped(doc_id, words):
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def random_words(rng):
    n = int(rng.integers(0, 160))
    words = [str(x) for x in rng.integers(0, rng.choice([1, 2, 3, 6, 60]), n)]
    kind = rng.integers(0, 3)
    if n and kind == 0:
        a = int(rng.integers(0, n))
        p = 1 + (n - a) // int(rng.integers(2, 9))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    if n > 10 and kind == 1:  # a block over and over with one word changed
        words = (words[: int(rng.integers(1, n))] * 6)[:400]
        words[int(rng.integers(0, len(words)))] = "z"
    return words


@pytest.mark.parametrize("shortest", [8, 12])
def test_runs_of_random_words(shortest):
    rng = np.random.default_rng(shortest)
    for _ in range(60):
        docs = [random_words(rng) for _ in range(int(rng.integers(1, 10)))]
        texts = [str(rng.choice([" ", "\n", " \t\x0b"])).join(w) if w else None for w in docs]
        counts, runs, left = (x.to_pylist() for x in _batch(texts, shortest))
        for words, n, found, text in zip(docs, counts, runs, left):
            want = all_runs(words, shortest)
            assert n == len(words)
            assert [(r["start"], r["period"], r["length"]) for r in found] == want
            assert text == collapsed(words, want)


def test_blocks_whose_every_gram_repeats_inside():
    # period 9 of runs within a run of period 46: a a b a a b ... x, twice and more
    words = (["a", "a", "b"] * 15 + ["x"]) * 4 + ["y"]
    (_, runs, _) = (x.to_pylist() for x in _batch([" ".join(words)], 12))
    assert [(r["start"], r["period"], r["length"]) for r in runs[0]] == all_runs(words)


def test_long_repetitive_texts_stay_cheap():
    texts = ["w " * 50_000, " ".join(str(i % 997) for i in range(50_000)), "x" * 100_000]
    _, runs, left = (x.to_pylist() for x in _batch(texts, 12))
    assert [[tuple(r.values()) for r in x] for x in runs] == [[(0, 50_000, 1)], [(0, 50_000, 997)], []]
    assert left[0] == "w" and left[1] == " ".join(map(str, range(997))) and left[2] == texts[2]


def test_query_against_all_periods(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op12_periodic_runs(spark, sf).collect()
    assert len(rows) == len(texts) and sum(r["n_runs"] > 0 for r in rows) > 5
    for r in rows:
        words = looped(r["doc_id"], words_of(texts[r["doc_id"]]))
        want = all_runs(words)
        best = min(((-n, s, q) for s, q, n in want), default=(None,) * 3)
        assert r["n_runs"] == len(want)
        assert (r["start"], r["period"]) == best[1:] and r["length"] == (best[0] and -best[0])
        assert r["exponent_milli"] == (best[0] and 1000 * -best[0] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, q, n in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, want).encode()).hexdigest()


def test_odd_rows(spark, odd, none):
    rows = periodic_runs(odd.withColumn("runs", odd["score"])).collect()
    assert len(rows) == odd.count() and set(odd.columns) < set(rows[0].asDict())
    for r in rows:
        want = all_runs(words_of(r["text"])) if len(words_of(r["text"])) < 1000 else [(0, 1, 60_000)]
        assert [(x["start"], x["period"], x["length"]) for x in r["runs"]] == want
        assert r["collapsed"] == collapsed(words_of(r["text"]), want)
    assert periodic_runs(none).count() == 0
