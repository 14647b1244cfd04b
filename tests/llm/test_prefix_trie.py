"""The conversation trie against a dictionary of prefixes."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from snaplens.llm import queries
from snaplens.llm.parens import Parens
from snaplens.llm.prefix_trie import ordered_turns, prefix_trie, with_heads

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    return out


def trie(convs):
    """Every column by definition, from all prefixes."""
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, spared = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        spared[node] = own + sum(spared[x] for x in children[node])
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
    return sorted(
        (min(ids), len(node), min(members[node[:-1]]) if node else -1, len(ids), len(children[node]), leaves[node], spared[node],
         hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, ids in members.items())


def got(df):
    assert df.columns[: len(COLUMNS)] == COLUMNS
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3 : len(COLUMNS)]) for r in df.collect())


def made(rng, convs):
    """Conversations of few different turns, so that prefixes are shared, and long common spines."""
    rows = []
    for c in range(convs):
        n = int(rng.integers(0, 7))
        common = 40 if c % 3 == 0 else 0  # longer than what splitters compare
        for t in range(common + n):
            text = "ü" * 5 if t < common else "x" * int(rng.integers(1, 4))
            rows.append((c, t, str(rng.choice(["user", "assistant"])) if t >= common else "user", text))
    return rows


def test_closing_parentheses():
    rng = np.random.default_rng(3)
    for n in (1, 2, 40, 700, 5000):
        for deep in (0.5, 0.95):
            bits, depth, stack, want = [1], 1, [0], {}
            opened = 1
            while stack:
                if opened < n and (rng.random() < deep or len(stack) == 1):
                    stack.append(len(bits))
                    bits.append(1)
                    opened += 1
                else:
                    want[stack.pop()] = len(bits)
                    bits.append(0)
            tree = Parens(np.array(bits) == 1)
            close = tree.find_close(tree.opens)
            assert [want[i] for i in tree.opens] == close.tolist()
            nodes, leaves = tree.subtrees()
            assert nodes[0] == n and leaves[0] == sum(a == 1 and b == 0 for a, b in zip(bits, bits[1:]))


@pytest.mark.parametrize("block_nodes", [3, 50, 1 << 18])
def test_trie_in_blocks_of_any_size(spark, block_nodes):
    rows = made(np.random.default_rng(block_nodes), 150)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    want = trie({c: tuple(t) for c, t in sequences(rows).items()})
    assert got(prefix_trie(ordered_turns(docs), block_nodes)) == want


def test_query_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_prefix_trie(spark, sf)) == trie(rebuilt(sequences(rows)))


def test_odd_conversations(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 1, "assistant", "hello"), (0, None, None, None),
        (3, 0, "user", "hi"), (3, 0, "assistant", "ho"), (4, 5, "user", "late"), (7, 0, "u", "sera"), (8, 0, "us", "era"),
        (None, 0, "user", "nobody's"), (10, 0, "", None), (11, 0, None, ""), (-3, 0, "user", "below"), (12, 0, "user", "hi" * 20_000),
    ] + [(20 + i, 0, "user", "same") for i in range(40)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash"))
    own = ordered_turns(table)
    assert got(prefix_trie(own, 4)) == trie({c: tuple(t) for c, t in sequences(rows).items()})
    heads = with_heads(own, F.col("conv_id") - F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string")) % 9)
    signed = {c: t for c, t in sequences(rows).items() if c >= 0}
    assert got(prefix_trie(heads.filter("conv_id >= 0"))) == trie(rebuilt(signed))
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(ordered_turns(empty)).count() == 0
