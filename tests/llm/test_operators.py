"""The corpus operators against plain Python on small tables, odd rows and empty tables."""

import re
import time
import zlib
from collections import Counter
from math import log10
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from snaplens.llm import jaccard, queries, token_files
from snaplens.llm.ann import nearest
from snaplens.llm.bpe import Bpe, bpe_encode, read_spec
from snaplens.llm.common import CLEANUP, remainder, saved, shared_folder, worker_state
from snaplens.llm.components import components
from snaplens.llm.embedding_dedup import cosine_components
from snaplens.llm.jaccard import band_keys, differing, jaccard_components
from snaplens.llm.langid import fit, identify
from snaplens.llm.line_templates import line_dedup
from snaplens.llm.lm import filter_segment, from_steps, levels, lm_scores, probed_levels, steps
from snaplens.llm.mixing import mix, plan_mix, split_quotas, targets
from snaplens.llm.sharding import shard_by_size
from snaplens.llm.token_files import ShardReader, read_tokens, write_tokens


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def lowered(text):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]


def shingle_set(text, k):
    w = lowered(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def smallest(ids, links):
    """The smallest id reachable from each of ``ids``."""
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def crc(value):
    return zlib.crc32(str(value).encode())


# ---- op1, op3: token ids


def test_token_files_return_what_the_library_encodes(spark, sf, library):
    rows = sorted(documents(spark, sf).select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in queries.op1_token_files(spark, sf).collect()}
    assert len(got) == len(rows)
    start = 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[doc_id]["start"], got[doc_id]["n_tokens"]) == (start, len(ids))
        assert got[doc_id]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files_of_many_shards(spark, sf, library, tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 40_000)
    docs = documents(spark, sf).select("doc_id", "text")
    files = write_tokens(docs, tokenizer, end_id=2)
    assert len(files.shards) > 5
    back = read_tokens(files, docs)
    assert back.rdd.getNumPartitions() == len(files.shards)
    got, start = {r["doc_id"]: r for r in back.collect()}, 0
    for doc_id, text in sorted(docs.collect()):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[doc_id]["start"] == start and got[doc_id]["ids"] == np.array(ids, "<u4").tobytes()
        start += len(ids)


def test_token_files_with_odd_rows(spark, odd, none, library, tokenizer):
    files = write_tokens(odd, tokenizer, end_id=2)
    want = Counter((r["doc_id"], *library.encode(r["text"] or "", add_special_tokens=False).ids, 2) for r in odd.collect())
    back = read_tokens(files, odd).collect()
    assert Counter((r["doc_id"], *np.frombuffer(r["ids"], "<u4").tolist()) for r in back) == want
    assert sorted(r["start"] for r in back)[0] == 0
    assert len(files.get(6)) == 2 and len(files.get(None)) == 1 and files.get(12345) == []
    assert all(ShardReader(s["path"]).get(99) == [] for s in files.shards)
    empty = write_tokens(none, tokenizer, end_id=2)
    assert empty.shards == [] and read_tokens(empty, odd).count() == 0


def test_token_files_learn_words_of_either_case_once(library, tokenizer):
    coder = token_files.LibraryEncoder(read_spec(tokenizer))
    odd = ["W\u030a w\u030a W\u0323\u030a", "<|STARTOFTEXT|> <|startoftext|>", "\u212aelvin \u212b \u1e9e \u0130 \u03a3\u03a3 Kelvin,", "WE'LL We'll", "\u01c5 \ufb01X", None, " "]
    assert coder.encode(odd) == [coder.pack(library.encode(t or "", add_special_tokens=False).ids) for t in odd]
    before = len(coder.known)
    assert len(set(coder.encode(["Quarry, stone", "quarry, Stone", "QUARRY, STONE"]))) == 1
    assert len(coder.known) == before + 2


def test_workers_hold_the_memories_of_one_operator():
    worker_state("one")["words"] = 1
    assert worker_state("one")["words"] == 1 and "words" not in worker_state("two") and "words" not in worker_state("one")


def test_bpe_without_decoding_keeps_no_text(tokenizer):
    texts = ["Some words, and some more.", "\u00fcber <|endoftext|> 12"]
    both, ids = Bpe(read_spec(tokenizer)), Bpe(read_spec(tokenizer), decode=False)
    assert ids.encode(texts) == (both.encode(texts)[0], [])
    assert {t for _, t in [*ids.chunks.values(), *ids.words.values()]} == {""}


def test_bpe_agrees_with_the_library(spark, sf, odd, none, library, tokenizer):
    for docs in (documents(spark, sf), odd):
        for r in bpe_encode(docs, tokenizer, decode=True).collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            assert r["ids"] == ids, r["doc_id"]
            assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    coded = bpe_encode(odd.withColumn("ids", F.lit("clash")), tokenizer)
    assert sorted(coded.columns) == sorted([*odd.columns, "ids"]) and coded.count() == odd.count()
    assert bpe_encode(none, tokenizer).count() == 0


# ---- op2: Jaccard join


def near_copies(spark):
    rng = np.random.default_rng(5)
    letters = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        base = list(rng.choice(letters, int(rng.integers(4, 900))))
        for copy in range(6):
            words = list(base)
            for at in rng.integers(0, len(words), int(len(words) * 0.012 * copy)):
                words[at] = str(rng.choice(letters))
            rows.append((group * 100 + copy, " ".join(words).upper() if copy % 2 else "\t".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("words_each, percent", [(3, 90), (5, 80)])
def test_jaccard_links_are_those_of_all_pairs(spark, sf, words_each, percent):
    for docs in (documents(spark, sf).select("doc_id", "text"), near_copies(spark)):
        rows = docs.collect()
        sets = {r["doc_id"]: shingle_set(r["text"], words_each) for r in rows}
        ids = sorted(i for i in sets if sets[i])
        links = [
            (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
        ]
        assert links
        want = smallest(sets, links)
        got = {r["doc_id"]: r for r in jaccard_components(docs, words_each=words_each, percent=percent).collect()}
        assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
        assert {i: r["component_id"] for i, r in got.items()} == want


def test_jaccard_in_many_blocks(spark, monkeypatch):
    rows = near_copies(spark).collect()
    whole = sorted(tuple(r) for r in jaccard_components(spark.createDataFrame(rows)).collect())
    for name, value in (("BLOCK", 2), ("ROWS", 5), ("SALTS", 3), ("WORDS", 2), ("KNOWN", 1)):
        monkeypatch.setattr(jaccard, name, value)
    copies = [(r["doc_id"] + 5_000, r["text"]) for r in rows[::3] for _ in range(2)]
    got = sorted(tuple(r) for r in jaccard_components(spark.createDataFrame([tuple(r) for r in rows] + copies, "doc_id long, text string")).collect())
    assert [r for r in got if r[0] < 5_000] == whole
    label = {r[0]: r[1:] for r in whole}
    assert all(r[1:] == label[r[0] - 5_000] for r in got if r[0] >= 5_000) and len(got) == len(rows) + len(copies)


def test_rows_of_wanted_keys_stay(spark):
    rows = spark.range(2_000).select(F.xxhash64("id").alias("row_key"), F.col("id").alias("text"))
    kept = jaccard.among(rows, rows.filter("text % 100 = 0"), "row_key")
    found = {r["text"] for r in kept.collect()}
    assert set(range(0, 2_000, 100)) <= found and len(found) < 100 and kept.columns == rows.columns
    assert jaccard.among(rows, rows.filter("false"), "row_key").count() == 0


def test_jaccard_of_odd_rows(spark, odd, none):
    got = Counter(tuple(r) for r in jaccard_components(odd).select("doc_id", "n_shingles", "component_id").collect())
    assert sum(got.values()) == odd.count()
    assert got[(1, 12, 1)] == 1 and got[(5, 12, 1)] == 1 and got[(6, 1, 6)] == 2
    assert got[(2, 0, 2)] == got[(3, 0, 3)] == got[(4, 0, 4)] == 1 and got[(8, 1, 8)] == 1
    assert jaccard_components(none).count() == 0


def test_a_set_without_id_links_others(spark):
    a = [f"w{i}" for i in range(300)]
    b, c = ["x", *a[1:]], ["x", *a[1:-1], "y"]  # 297 of 299 shingles with b in common, a and c 296 of 300
    rows = [(9, " ".join(a)), (None, " ".join(b)), (4, " ".join(c)), (None, " ".join(b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard_components(docs, words_each=3, percent=99).collect()]
    assert sorted(got, key=str) == sorted([(9, 298, 4), (None, 298, 4), (None, 298, 4), (4, 298, 4)], key=str)


def test_sets_that_may_link_share_a_band():
    rng = np.random.default_rng(2)
    for n in (11, 40, 333, 2_000):
        for percent in (80, 90):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.unique(np.concatenate([a[differing(n, percent) :], rng.integers(0, 1 << 63, 0, dtype=np.uint64)]))
            assert set(band_keys(np.unique(a), percent).tolist()) & set(band_keys(b, percent).tolist())


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 60)}}


# ---- op4, op5: vectors


def vector_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in rows
         if r["embedding"] is not None and None not in r["embedding"]}
    return {r["vec_id"] for r in rows}, {i: v for i, v in x.items() if np.isfinite(v).all() and v.any()}


def test_nearest_against_all_products(spark, sf):
    _, x = vector_table(spark, sf)
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    got = {}
    for r in queries.op4_nearest(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = [i for i in ids if i % 20 == 0]
    assert set(got) == set(asked)
    hits = 0
    for q in asked:
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, len(found) + 1)) and len(found) == min(20, len(ids) - 1)
        assert all(v != q and abs(s - float(x[v] @ x[q])) < 1e-9 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        order = [i for i in ids[np.lexsort((ids, -(m @ x[q])))] if i != q][:20]
        hits += len(set(order) & {f[1] for f in found})
    assert hits >= 0.9 * 20 * len(asked)


ODD_VECTORS = [
    (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
    (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [0.0, 3.0]), (None, [1.0, 0.0]), (9, [0.0, 3.0]), (10, []),
]


def test_odd_vectors(spark):
    table = spark.createDataFrame(ODD_VECTORS, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = sorted(tuple(r) for r in nearest(table, F.col("vec_id") % 20 == 0, k=20).collect())
    assert [r[:3] for r in got] == [(20, 1, 2), (20, 2, 1), (20, 3, 8), (20, 4, 9)]
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cosine_components(table).filter("vec_id is not null").collect()}
    assert found[1] == (2, 1, True) and found[2] == (2, 1, False) and found[20] == (2, 1, False)
    assert found[8] == (1, 8, True) and found[9] == (1, 8, False)
    assert all(found[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 10))
    assert nearest(table.limit(0), F.lit(True)).count() == 0 and cosine_components(table.limit(0)).count() == 0


def test_embedding_links_against_all_pairs(spark, sf):
    every, x = vector_table(spark, sf)
    ids = sorted(x)
    m = np.stack([x[i] for i in ids])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(m @ m.T >= 0.95, 1))
    links = [(ids[i], ids[j]) for i, j in zip(a, b)]
    n = Counter(i for link in links for i in link)
    want = smallest(every, links)
    got = queries.op5_embedding_dedup(spark, sf).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (n[i], want[i], want[i] == i) for i in every}
    assert len(got) == len(every)


# ---- op6: mixing


def test_targets():
    assert targets({"a": 100, "b": 100, None: 100}) == pytest.approx({"a": 50, "b": 100, None: 150})
    assert targets({"a": 1000, "b": 10, "c": 1}) == pytest.approx({"b": 30, "c": 3, "a": 978})
    assert targets({}) == {} and targets({"a": 0}) == {"a": 0}


def test_quotas_are_split_whole():
    share = split_quotas(np.array([100, 0, 7]), 16, np.random.default_rng(0))
    assert share.sum(axis=0).tolist() == [100, 0, 7] and (share >= 0).all()
    assert share.sum(axis=1).max() - share.sum(axis=1).min() <= 1


def test_mix_meets_its_targets(spark, sf):
    docs = documents(spark, sf)
    rows = docs.select("doc_id", "text", "source").collect()
    size = {r["doc_id"]: len(lowered(r["text"])) for r in rows}
    of = {r["doc_id"]: r["source"] for r in rows}
    held = Counter()
    for i, n in size.items():
        held[of[i]] += n
    goal = targets(held)
    got = queries.op6_mixing(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    taken = Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == held[of[r["doc_id"]]]
        assert r["target"] == pytest.approx(goal[of[r["doc_id"]]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[of[r["doc_id"]]] += r["taken"]
    largest = Counter()
    for i, n in size.items():
        largest[of[i]] = max(largest[of[i]], n)
    for s in held:  # a sub-block of these small sources is one document
        assert abs(taken[s] - goal[s]) < max(goal[s] / 65_536, largest[s])
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op6_mixing(spark, sf).collect()))


def test_mixed_rows_are_the_planned_copies(spark, sf, odd, none):
    for docs in (documents(spark, sf), odd):
        planned = Counter({(r["doc_id"],): 0 for r in docs.select("doc_id").collect()})
        for r in plan_mix(docs).sizes.select("doc_id", "copies").collect():
            planned[(r["doc_id"],)] += r["copies"]
        made = mix(docs.withColumn("mix_shard", F.lit("clash")))
        assert Counter(tuple(r) for r in made.select("doc_id").collect()) == +planned
        assert {"mix_shard", "mix_order", *docs.columns} == set(made.columns)
    assert plan_mix(odd).sizes.count() == odd.count()
    assert mix(none).count() == 0 and plan_mix(none).sizes.count() == 0


def test_op6_and_the_pipeline_follow_the_draws(spark, sf, tmp_path):
    docs = documents(spark, sf)
    made = sorted((r["mix_shard"], r["mix_order"], r["doc_id"]) for r in mix(docs).collect())
    got = queries.op6_mixing(spark, sf).collect()
    assert sorted((s, o, r["doc_id"]) for r in got for s, o in zip(r["mix_shard"], r["mix_order"])) == made
    assert all(r["taken"] == r["size"] * len(r["mix_shard"]) for r in got)
    assert len({s for s, _, _ in made}) == 16
    corpus_pipeline.mixed(spark, docs, sf).write.parquet(str(tmp_path / "mixed"))
    files = sorted((tmp_path / "mixed").glob("part-*"))
    assert [r["doc_id"] for f in files for r in spark.read.parquet(str(f)).select("doc_id").collect()] == [i for _, _, i in made]


# ---- op7: sharding


def test_shards_are_even_and_gapless(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in documents(spark, sf).collect()}
    got = queries.op7_sharding(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    bytes_, slots = Counter(), {}
    for r in got:
        raw = (docs[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["law"] == "bytes" and r["grown_shard"] is None
        assert r["text_crc32"] == (None if docs[r["doc_id"]] is None else zlib.crc32(raw))
        bytes_[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    most = max(r["size"] for r in got)
    assert all(abs(bytes_[s] - sum(bytes_.values()) / 40) <= 2 * most for s in range(40))


def test_shards_of_odd_rows(spark, odd, none):
    for shards in (1, 3, 100):
        got = shard_by_size(odd, shards).collect()
        assert len(got) == odd.count() and all(0 <= r["shard"] < shards for r in got)
        assert len({(r["shard"], r["slot"]) for r in got}) == len(got)
    assert shard_by_size(none).count() == 0


# ---- op8: language ID


def test_languages_of_held_out_documents(spark, sf):
    rows = {r["doc_id"]: r for r in documents(spark, sf).collect()}
    got = queries.op8_language_id(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    right = [rows[r["doc_id"]]["lang"] == r["lang_pred"] for r in got if r["held_out"] and rows[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert np.mean(right) >= 0.95
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in rows[r["doc_id"]]["text"] or "")) for r in got)


def test_language_of_odd_rows(spark, sf, odd, none):
    model = fit(odd, F.lit(True))
    got = identify(odd.withColumn("lang_pred", F.lit("clash")), model).collect()
    assert len(got) == odd.count()
    assert all(r["lang_pred"] == "und" and r["rejected"] and r["score"] == 0 for r in got if r["doc_id"] in (2, 3, 4))
    blank = fit(none, F.lit(True))
    assert blank.languages == () and {r["lang_pred"] for r in identify(odd, blank).collect()} == {"und"}
    assert identify(none, model).count() == 0
    strange = spark.createDataFrame([(1, "zzqx xqzz qqzx " * 30), (2, "δοκιμή κειμένου " * 30)], "doc_id long, text string")
    trained = fit(documents(spark, sf), remainder("doc_id", 5) != 0)
    assert all(r["rejected"] for r in identify(strange, trained).collect())


# ---- op9: line dedup


def test_lines_of_a_recurring_template_go(spark):
    rows = [
        (1, "Own words of the first one\nOrder 17 was shipped to you on 2024-01-02"),
        (2, "Order 9 was shipped to you on 2023-11-30\nOwn words of the second one"),
        (3, "Own words of number three here\nOrder 1001 was shipped to you on 2022-05-05"),
        (4, None), (5, ""), (None, "Order 5 was shipped to you on 2020-01-01"),
        (6, "Short line\nShort line"), (7, "Short line"), (8, "Short line"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit(1)).withColumn("d", F.lit(2))
    out = line_dedup(docs)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()}
    assert got[1] == (rows[0][1], 2, 0) and got[2] == ("Own words of the second one", 2, 1)
    assert got[3] == ("Own words of number three here", 2, 1) and got[None] == ("", 1, 1)
    assert got[4] == (None, 0, 0) and got[5] == ("", 1, 0) and got[6] == (rows[6][1], 2, 0)
    assert got[7] == got[8] == ("", 1, 1)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]


def test_lines_in_columns_that_clash(spark):
    rows = [(i, f"The very same line in all\nOwn {i}", 7, 8, 9) for i in range(3)]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_dropped int, gone int"))
    assert out.columns == ["doc_id", "text", "gone", "n_lines", "n_dropped"]
    assert sorted(tuple(r) for r in out.collect()) == [(0, rows[0][1], 9, 2, 0), (1, "Own 1", 9, 2, 1), (2, "Own 2", 9, 2, 1)]


def test_short_lines_of_the_pipeline_go_when_they_recur(spark):
    rows = [
        (1, "Home\nPage 3 of 10\nOwn text a"), (2, " Home\t\nPage 3 of 10\nOwn text b\n\n"), (3, "Home\nPage 3 of 10\n\nOwn text c"),
        (4, "Home\nPage 4 of 10\n\nHome"), (5, "Only two\nOwn text e"), (6, "Only two\nOwn text f"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {1: rows[0][1], 2: "Own text b\n\n", 3: "\nOwn text c", 4: "Page 4 of 10\n", 5: rows[4][1], 6: rows[5][1]}
    assert "Python" not in line_dedup(docs)._jdf.queryExecution().executedPlan().toString()


def test_passages_of_the_pipeline_go_from_the_second_document_on(spark):
    long, longer, limit = (" ".join(f"{c}{i if c == 'n' else 'abcdefghij'[i % 10]}" for i in range(n)) for c, n in (("p", 51), ("n", 60), ("q", 50)))
    rows = [
        (1, f"Own a\n{long}\n{limit}"), (2, f"{long} \nOwn b\n{limit}"), (3, f"Own c\n{longer}"),
        (4, f"{longer}\nOwn d"), (5, f"Own e\n{long} more"), (6, f"Own f\n{longer.replace('n7', 'n70')}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {**dict(rows), 2: f"Own b\n{limit}", 4: "Own d"}


def test_rows_without_id_are_documents_of_their_own(spark):
    rows = [(None, f"Own words {c}\nOrder {i} was shipped to you today") for i, c in enumerate("abcd")]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["n_dropped"] for r in got) == [0, 1, 1, 1]
    assert all((r["text"] in dict.fromkeys(t for _, t in rows)) == (r["n_dropped"] == 0) for r in got)


def test_line_dedup_of_odd_rows_stays_native(spark, odd, none):
    out = line_dedup(odd)
    assert out.count() == odd.count() and line_dedup(none).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- op10: LM scoring


def test_base_scores_are_exact(spark, sf, odd):
    for docs in (documents(spark, sf), odd):
        rows = docs.select("doc_id", "text").collect()
        tokens = [[*lowered(r["text"]), b""] for r in rows]
        train = [crc("" if r["doc_id"] is None else r["doc_id"]) % 10 != 0 for r in rows]
        c = Counter(t for ts, use in zip(tokens, train) if use for t in ts)
        n, v = sum(c.values()), len(c)
        want = {}
        for r, ts in zip(rows, tokens):
            base = sum(log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
            want[r["doc_id"]] = (len(ts), sum(c[t] > 0 for t in ts), n, pytest.approx(base, rel=1e-9))
        got = lm_scores(docs, remainder("doc_id", 10) != 0).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == want[r["doc_id"]]


def test_model_beats_the_base_on_held_out_texts(spark, sf):
    got = [r for r in queries.op10_lm_scoring(spark, sf).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert all(r["score"] <= 0 for r in got)


def test_filter_segment_gives_every_level_back():
    rng = np.random.default_rng(4)
    grams = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    counts = rng.integers(1, 5000, len(grams))
    got = probed_levels(filter_segment(grams, counts), grams)
    assert (got >= levels(counts)).all() and (got == levels(counts)).mean() > 0.95
    others = probed_levels(filter_segment(grams, counts), rng.integers(1 << 63, 1 << 64, 4000, dtype=np.uint64))
    assert (others == 0).mean() > 0.95
    nothing = np.zeros(0, np.uint64)
    assert (probed_levels(filter_segment(nothing, np.zeros(0, np.int64)), grams) == 0).all()
    low = np.unique(rng.integers(0, 1 << 32, 1000, dtype=np.uint64))
    assert (from_steps(steps(low)) == low).all() and len(from_steps(steps(nothing))) == 0


def test_lm_without_rows_or_training(spark, odd, none):
    assert lm_scores(none, F.lit(True)).count() == 0
    got = lm_scores(odd, F.lit(False)).collect()
    assert len(got) == odd.count() and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)


# ---- pipeline


def test_pipeline_stages(spark, sf, library, tmp_path):
    docs = documents(spark, sf)
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() > 0
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        if name == "jaccard_join":
            sets = {r["doc_id"]: shingle_set(r["text"], 5) for r in before.collect()}
            ids = sorted(k for k in sets if sets[k])
            links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
            assert {r["doc_id"] for r in docs.collect()} == {i for i, c in smallest(sets, links).items() if i == c}
    texts = Counter(tuple(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in before.collect())
    assert Counter(tuple(r["ids"]) for r in docs.collect()) == texts


def test_one_of_each_group_of_near_copies_stays(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [
        (1, a, "s"), (1, a, "s"), (1, a, "t"), (2, a + " more", "s"), (2, b, "s"), (None, a, "s"),
        (None, c, "s"), (None, c, "s"), (None, c + " more", "s"), (None, d, "s"), (None, None, "s"), (None, None, "s"), (3, " ", "s"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert sum(got[None, t] for t in (c, c + " more")) == 1
    assert {k: n for k, n in got.items() if not (k[1] or "").startswith("c")} == {(1, a): 1, (2, b): 1, (None, d): 1, (None, None): 2, (3, " "): 1}


def test_pipeline_of_odd_and_empty_documents(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        assert docs.count() <= odd.count() * 3


# ---- disk of the pipeline: what moves, and what goes when it is no longer read


def copies_kept(spark):
    """The names of the copies in the shared folder."""
    return {f.name for f in Path(re.sub("^file:(//)?", "", shared_folder(spark))).iterdir()}


def shuffle_bytes(spark):
    """Bytes of all shuffle files; they may go at any time."""
    total = 0
    for folder in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString():
        for f in Path(folder).rglob("shuffle_*"):
            try:
                total += f.stat().st_size
            except FileNotFoundError:
                pass
    return total


def wait_until(holds, seconds=20):
    end = time.time() + seconds
    while not holds() and time.time() < end:
        time.sleep(0.2)
    return holds()


def test_shuffle_files_of_a_stored_table_go(spark):
    start = shuffle_bytes(spark)
    rows = spark.range(300_000).repartition(F.xxhash64("id"))
    kept = saved(rows)
    assert wait_until(lambda: shuffle_bytes(spark) < start + 100_000)
    assert spark.conf.get(CLEANUP, None) is None and kept.count() == rows.count() == 300_000


def test_texts_of_documents_without_copies_do_not_move(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"{x:x}" for x in rng.integers(0, 1 << 48, 600)), "s") for i in range(400)]
    docs = spark.createDataFrame(rows + [(1_000, rows[5][1] + " more", "s")], "doc_id long, text string, source string")
    start, size = shuffle_bytes(spark), sum(len(r[1]) for r in rows)
    corpus_pipeline.near_copies(spark, docs, "").write.parquet(str(tmp_path / "out"))
    assert wait_until(lambda: shuffle_bytes(spark) - start < size / 10)
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(400))


def test_copies_with_keys_of_all_words_or_lines_go(spark):
    before = copies_kept(spark)
    docs = near_copies(spark).withColumn("source", F.lit("s"))
    for stage in (corpus_pipeline.near_copies, corpus_pipeline.lines):
        assert 0 < stage(spark, docs, "").count() <= docs.count()
    assert not {f for f in copies_kept(spark) - before if f.startswith(("sets-", "lines-"))}


def test_near_copies_when_every_row_is_doubted(spark, monkeypatch):
    docs = near_copies(spark)
    docs = docs.unionByName(docs.filter("doc_id % 3 = 0")).select("*", *(F.lit(i).alias(c) for i, c in enumerate(("word", "bits", "r", "row_key", "order", "n"))))
    few = Counter(map(tuple, corpus_pipeline.near_copies(spark, docs, "").collect()))
    monkeypatch.setattr(jaccard, "WORDS", 1)
    assert Counter(map(tuple, corpus_pipeline.near_copies(spark, docs, "").collect())) == few
    assert max(few.values()) == 1 and len({r[0] // 100 for r in few}) == 12 and next(iter(few))[2:] == tuple(range(6))


def test_pipeline_keeps_one_copy_between_stages(spark, tmp_path, monkeypatch):
    before = copies_kept(spark)
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    more = lambda spark, docs, folder: docs.unionByName(docs)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", more), ("second", more), ("third", more)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 16
    assert [f.split("-")[0] for f in copies_kept(spark) - before] == ["second"]
