"""Removal of repeated byte strings against a dictionary of all windows."""

import hashlib

import numpy as np
import pytest

from snaplens.llm import queries
from snaplens.llm.induced import Scratch, suffix_order
from snaplens.llm.repeats import remove_repeats


def removed(docs, length=100):
    """Bytes that go, per document, of ``docs`` in order."""
    seen, out = set(), []
    for data in docs:
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            window = hash(data[i : i + length])
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        out.append(gone)
    return out


def spans(gone):
    edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(a), int(b - a)) for a, b in zip(starts, ends)]


def check(rows, got, length=100):
    """``rows`` are (doc_id, text) of different ids; ``got`` maps ids to results."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    data = [(t or "").encode() for _, t in rows]
    for (doc, _), d, gone in zip(rows, data, removed(data, length)):
        assert got[doc]["n_bytes"] == len(d)
        assert [tuple(x) for x in got[doc]["removed"]] == spans(gone), doc
        assert bytes(got[doc]["kept"]) == bytes(np.frombuffer(d, np.uint8)[~gone])


@pytest.mark.parametrize("block", [1, 4, 1 << 15])
def test_suffix_order(block):
    rng = np.random.default_rng(block)
    for i in range(150):
        n = int(rng.integers(0, 90))
        text = rng.integers(1, rng.choice([1, 2, 4, 40]) + 1, n)
        text = [text, np.tile(text[: max(1, n // 6)], 6), np.sort(text), np.sort(text)[::-1]][i % 4]
        text = np.append(text, 0)
        with Scratch(limit=int(rng.choice([8, 900, 1 << 20]))) as scratch:
            got = suffix_order(text, scratch, block).tolist()
        listed = text.tolist()
        assert got == sorted(range(len(listed)), key=lambda p: listed[p:])


def mosaic(rng, docs):
    """Documents of pieces that others hold too, cut at any byte, with some changed bytes."""
    pool = ["".join(chr(c) for c in rng.choice([97, 98, 99, 228, 0x6771, 32], int(rng.integers(30, 400)))) for _ in range(25)]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(int(rng.integers(0, 6))):
            piece = pool[int(rng.integers(0, len(pool)))]
            a = int(rng.integers(0, len(piece)))
            parts.append(piece[a : a + int(rng.integers(1, 400))])
        text = "".join(parts)
        if text and rng.random() < 0.3:
            at = int(rng.integers(0, len(text)))
            text = text[:at] + "#" + text[at + 1 :]
        if rng.random() < 0.1:
            text = "ab" * int(rng.integers(0, 300))
        if rng.random() < 0.1 and rows:
            text = rows[int(rng.integers(0, len(rows)))][1]
        rows.append((int(i * 7919 % 10007), text))
    return rows


@pytest.mark.parametrize("bucket_bytes, shard_bytes", [(16 << 20, 4 << 20), (9000, 3000)])
def test_pieces_shared_by_documents(spark, bucket_bytes, shard_bytes):
    rows = mosaic(np.random.default_rng(shard_bytes), 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in remove_repeats(docs, 100, bucket_bytes=bucket_bytes, shard_bytes=shard_bytes).collect()}
    assert sum(len(r["removed"]) for r in got.values()) > 50
    check(rows, got)
    check(rows, {r["doc_id"]: r for r in remove_repeats(docs, 48).collect()}, 48)


def test_query_against_all_windows(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    data = [(t or "").encode() for _, t in sorted(rows)]
    got = {r["doc_id"]: r for r in queries.op13_suffix_dedup(spark, sf).collect()}
    assert len(got) == len(rows)
    for (doc, _), d, gone in zip(sorted(rows), data, removed(data)):
        r = got[doc]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(d), gone.sum(), len(spans(gone)))
        assert r["kept_sha256"] == hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()
    assert sum(r["n_removed"] for r in got.values()) > 10_000


def test_odd_rows(spark, odd, none):
    table = odd.withColumn("kept", odd["source"])
    got = remove_repeats(table).collect()
    assert len(got) == odd.count() and got[0].asDict().keys() == {*odd.columns, "n_bytes", "removed", "kept"}
    by_id = {r["doc_id"]: r for r in got}
    data = {r["doc_id"]: (r["text"] or "").encode() for r in odd.collect()}
    for doc in (1, 2, 3, 4, 5, 6, 7):
        assert by_id[doc]["removed"] == [] and bytes(by_id[doc]["kept"]) == data[doc]
    # of a text of one word, or one letter, the first window stays
    assert [tuple(x) for x in by_id[8]["removed"]] == [(5, len(data[8]) - 5)]
    assert [tuple(x) for x in by_id[9]["removed"]] == [(1, len(data[9]) - 1)]
    assert remove_repeats(none).count() == 0


def test_rows_equal_in_id_and_text_are_copies(spark):
    text = "".join(chr(97 + i * i % 23) + str(i) for i in range(80))
    rows = [(5, text), (5, text), (None, text), (None, text), (2, "short"), (2, "short"), (9, text[:150] + "other " * 3)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["kept"])) for r in got)
    assert sizes == [(False, 2, 5), (False, 2, 5), (False, 5, 0), (False, 5, len(text)), (False, 9, 18), (True, 0, 0), (True, 0, 0)]
