"""The trie of shared conversation prefixes, one balanced-parentheses tree per shard.

Conversations are sequences of turns, held as one digest of 16 bytes a turn. Equal
sequences become one path with a count before anything is sorted. Paths are dealt in
lexicographic order to shards; a task reads its shard in order, in blocks of a bounded number of
nodes, and writes each block as parentheses. Closing parentheses delimit subtrees: leaves are a
difference of leaf ranks, members and savings differences of running totals.

A node that lies in several blocks lies on the common prefix of each pair of neighbours
between them (the spine). Sums over blocks are mended along those prefixes: one row per node of
each spine says how often its bytes, its child or its leaf were counted too often.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplens.llm.common import bucket_count, saved
from snaplens.llm.parens import Parens

TURN = 16  # bytes of a turn's digest
KEYED_TURNS = 32  # turns that a splitter between shards compares
COUNTS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
NODE = "k1 long, k2 long, p1 long, p2 long, depth long, conv_id long, " + ", ".join(f"{c} long" for c in COUNTS)
EDGE = "part int, block int, last boolean, low binary, high binary, high_sizes array<long>"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Columns ``conv_id``, ``turns`` (array of ``digest``, ``size``): each conversation by ``turn``, null first.

    Rows of one turn number follow by role, then text; equal rows stay apart. Null role or text is empty.
    Rows without ``conv_id`` belong to no conversation and are left out. A conversation's digests are
    held in one row, some 50 bytes a turn.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.select(
        "conv_id", F.row_number().over(order).alias("place"),
        F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")).alias("digest"),
        F.octet_length("text").cast("long").alias("size"))
    listed = F.sort_array(F.collect_list(F.struct("place", "digest", "size")))
    turns = F.transform(listed, lambda t: F.struct(t.digest.alias("digest"), t.size.alias("size")))
    return placed.groupBy("conv_id").agg(turns.alias("turns"))


def with_heads(own: DataFrame, base: Column, head: Column) -> DataFrame:
    """``own`` whose first ``head`` turns are those of conversation ``base`` (fewer or none, where it has not as many).

    ``head`` is at most 8, so what a base lends is small.
    """
    lent = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("lent"))
    asked = own.withColumn("base", base).withColumn("head", head.cast("int"))
    none = F.slice("turns", 1, 0)
    taken = F.coalesce(F.slice("lent", F.lit(1), F.col("head")), none)
    rest = F.slice("turns", F.col("head") + 1, F.greatest(F.size("turns") - F.col("head"), F.lit(0)))
    return asked.join(lent, "base", "left").select("conv_id", F.concat(taken, rest).alias("turns"))


def prefix_trie(sequences: DataFrame, block_nodes: int = 1 << 18) -> DataFrame:
    """One row per distinct prefix of ``turns`` (see ``ordered_turns``), the empty one included.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``. A row per conversation is expected; without rows there is no node.
    ``block_nodes`` bounds the nodes a task holds at once (a single longer path is held whole).
    """
    digests = F.array_join(F.transform("turns", lambda t: t.digest), "")
    paths = sequences.select("conv_id", F.unhex(digests).alias("path"), F.transform("turns", lambda t: t.size).alias("sizes"))
    paths = saved(paths.withColumn("path_key", F.md5("path")), "rebuilt")
    n_convs, n_turns = paths.agg(F.count("*"), F.sum(F.size("sizes"))).first()

    distinct = paths.groupBy("path_key").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    shards = bucket_count((n_turns or 0) + n_convs, 1 << 20)
    ordered = distinct.repartitionByRange(shards, F.substring("path", 1, TURN * KEYED_TURNS)).sortWithinPartitions("path")
    built = saved(
        ordered.select("path", "sizes", "conv_id", "n").mapInArrow(lambda batches: _blocks(batches, block_nodes), f"{NODE}, {EDGE}"), "trie")

    local = built.filter("depth IS NOT NULL").select(*NODE.replace(" long", "").split(", "))
    nodes = local.unionByName(_spine_rows(built.filter("part IS NOT NULL")))
    nodes = nodes.groupBy("k1", "k2").agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in COUNTS])
    nodes = saved(nodes, "nodes")
    parents = nodes.filter("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    ends = _ends(paths.select("path_key", "conv_id"), bucket_count(n_convs, 1 << 20))
    return (
        nodes.join(parents, ["p1", "p2"], "left").join(ends, ["k1", "k2"], "left")
        .select("conv_id", "depth", "parent_conv_id", *COUNTS,
                F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


def _key(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _shared(a: bytes, b: bytes) -> int:
    """How many turns two paths share at their start."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * TURN : mid * TURN] == b[low * TURN : mid * TURN]:
            low = mid
        else:
            high = mid - 1
    return low


class _Block:
    """Paths in order, written as parentheses."""

    def __init__(self):
        self.bits = bytearray(b"\1")
        self.hashes, self.stack, self.path = [hashlib.md5()], [0], b""
        self.keys, self.parent, self.depth, self.size = [_key(hashlib.md5().digest())], [-1], [0], [0]
        self.ends, self.least, self.low = [0], [None], None

    def __len__(self):
        return len(self.keys)

    def add(self, path: bytes, sizes: list[int], conv_id: int, n: int) -> None:
        if self.low is None:
            self.low = path
        shared = _shared(self.path, path)
        self._close(shared)
        for d in range(shared, len(path) // TURN):
            self.bits.append(1)
            state = self.hashes[-1].copy()
            state.update(path[d * TURN : d * TURN + TURN])
            self.parent.append(self.stack[-1])
            self.stack.append(len(self.keys))
            self.hashes.append(state)
            self.keys.append(_key(state.digest()))
            self.depth.append(d + 1)
            self.size.append(sizes[d])
            self.ends.append(0)
            self.least.append(None)
        top = self.stack[-1]
        self.ends[top] += n
        self.least[top] = conv_id if self.least[top] is None else min(conv_id, self.least[top])
        self.path, self.sizes = path, sizes

    def _close(self, depth: int) -> None:
        """Closes the open nodes below ``depth``; each hands its smallest member up."""
        while len(self.stack) > depth + 1:
            top = self.stack.pop()
            self.hashes.pop()
            self.bits.append(0)
            up = self.stack[-1]
            self.least[up] = self.least[top] if self.least[up] is None else min(self.least[up], self.least[top])

    def rows(self, part: int, block: int, last: bool) -> pa.RecordBatch:
        self._close(0)
        self.bits.append(0)
        nodes, leaves = Parens(np.frombuffer(bytes(self.bits), np.uint8) == 1).subtrees()
        at = np.arange(len(self))
        before = np.concatenate(([0], np.cumsum(self.ends)))
        members = before[at + nodes] - before[at]
        spared = np.concatenate(([0], np.cumsum((members - 1) * np.array(self.size, np.int64))))
        keys = np.array(self.keys, np.int64)
        parent = np.array(self.parent, np.int64)
        children = np.bincount(parent[1:], minlength=len(self))
        up = keys[np.maximum(parent, 0)]
        columns = [keys[:, 0], keys[:, 1], pa.array(up[:, 0], mask=parent < 0), pa.array(up[:, 1], mask=parent < 0),
                   self.depth, self.least, members, children, leaves, spared[at + nodes] - spared[at]]
        edge = pa.nulls(len(self))
        columns = [pa.array(c, pa.int64()) if not isinstance(c, pa.Array) else c for c in columns] + [edge] * 6
        batch = _table([*columns])
        tail = _table([pa.nulls(1)] * 10 + [[part], [block], [last], [self.low], [self.path], [self.sizes]])
        return pa.concat_batches([batch, tail])


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in f"{NODE}, {EDGE}".split(", "))])


def _table(columns: list) -> pa.RecordBatch:
    schema = _schema()
    made = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(made, schema=schema)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    part, number, block = TaskContext.get().partitionId(), 0, _Block()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if block.low is not None and len(block) + len(row[1]) > most:
                yield block.rows(part, number, False)
                number, block = number + 1, _Block()
            block.add(*row)
    if block.low is not None:
        yield block.rows(part, number, True)


def _spine_rows(edges: DataFrame) -> DataFrame:
    """What neighbouring blocks count twice along their common prefix, as rows that are added to the nodes'.

    Which shards are not empty (a number per shard) is all the driver sees.
    """
    spark = edges.sparkSession
    parts = sorted(r["part"] for r in edges.filter("last").select("part").collect())
    follows = spark.createDataFrame(list(zip(parts[1:], parts)), "part int, before int")
    high = edges.select("part", F.when(F.col("last"), -1).otherwise(F.col("block")).alias("block"), "high", "high_sizes")
    low = edges.join(F.broadcast(follows), "part", "left").select(
        F.when(F.col("block") > 0, F.col("part")).otherwise(F.col("before")).alias("part"),
        F.when(F.col("block") > 0, F.col("block") - 1).otherwise(-1).alias("block"), "low")
    return high.join(low, ["part", "block"]).select("high", "high_sizes", "low").mapInArrow(_spines, NODE)


def _spines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = NODE.replace(" long", "").split(", ")
    for batch in batches:
        for high, sizes, low in zip(*(c.to_pylist() for c in batch.columns)):
            shared = _shared(high, low)
            state, keys = hashlib.md5(), []
            for d in range(shared + 1):
                state.update(high[(d - 1) * TURN : d * TURN] if d else b"")
                keys.append(_key(state.digest()))
            twice = np.array([0, *sizes[:shared]], np.int64)
            below = np.cumsum(twice[::-1])[::-1]  # bytes from each node down to the end of the spine
            child = np.where(np.arange(shared + 1) < shared, -1, 0)
            leaf = np.full(shared + 1, -1 if len(high) == shared * TURN else 0)
            none = pa.nulls(shared + 1, pa.int64())
            k = np.array(keys, np.int64)
            columns = [k[:, 0], k[:, 1], none, none, none, none, np.zeros(shared + 1, np.int64), child, leaf, below]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=names)


def _ends(members: DataFrame, partitions: int, each: int = 1 << 14) -> DataFrame:
    """SHA-256 of the ids that end at a node, ascending, joined by commas.

    Ids are sorted over all tasks, however many share a node, and joined in pieces; one digest reads its
    pieces one after the other and holds none of them longer.
    """
    def join(batches):
        key, ids = None, []
        for batch in batches:
            out = []
            for k, i in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key or len(ids) == each:
                    if ids:
                        out.append((key, ids[0], ",".join(map(str, ids))))
                    key, ids = k, []
                ids.append(i)
            yield _columns(out, [pa.string(), pa.int64(), pa.string()], ["path_key", "at", "ids"])
        if ids:
            yield _columns([(key, ids[0], ",".join(map(str, ids)))], [pa.string(), pa.int64(), pa.string()], ["path_key", "at", "ids"])

    def digest(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for k, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if state:
                        out.append((*_key(bytes.fromhex(key)), state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _columns(out, [pa.int64(), pa.int64(), pa.string()], ["k1", "k2", "ends_sha256"])
        if state:
            yield _columns([(*_key(bytes.fromhex(key)), state.hexdigest())], [pa.int64(), pa.int64(), pa.string()], ["k1", "k2", "ends_sha256"])

    ids = members.repartitionByRange(partitions, "path_key", "conv_id").sortWithinPartitions("path_key", "conv_id")
    pieces = ids.mapInArrow(join, "path_key string, at long, ids string")
    dealt = pieces.repartition(partitions, "path_key").sortWithinPartitions("path_key", "at")
    return dealt.select("path_key", "ids").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def _columns(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
