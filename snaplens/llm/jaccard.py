"""N-gram Jaccard join with parity sketches.

A set of shingles becomes a long bit sketch: every shingle flips one bit, so the
sketches of two sets differ in no more bits than the sets differ in shingles. The
sketch is cut into bands. Sets that may link differ in at most ``d`` shingles, hence in
at most ``d`` bands, and agree in all others; so if each set offers the ``d + 1`` bands
that come first in one fixed order (most bits set first), two linking sets have one in
common (pigeonhole). Bands only meet within a class of set sizes.

Sets that share a band form a candidate group. Groups are verified exactly, block
against block, and give a spanning forest of their links rather than all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplens.llm.common import (
    WordHashes, bucket_count, mix, new_folder, pieces, plain, removed, saved, shingles, signed, stored, table, words, worker_state,
)
from snaplens.llm.components import components

BITS = 1 << 16  # bits of a band
BLOCK = 1_500  # sets of one candidate group that are compared in one go
ROWS = 3_000  # sets of one verifying task
KNOWN = 1_000_000  # sets that a task remembers as offered; beyond it some are offered again
SALTS = 32  # tasks that share the rows of one large candidate group
WORDS = 1 << 18  # 64-bit words of the set of wanted rows


def differing(n: int, percent: int) -> int:
    """Shingles in which a set of ``n`` may differ from one it links with, at most."""
    return (100 - percent) * n // percent


def band_keys(found: np.ndarray, percent: int) -> np.ndarray:
    """The keys under which a set meets its candidates: 64-bit, tagged with the size class."""
    n = len(found)
    d = differing(n, percent)
    if d == 0:  # only an equal set can link
        return np.empty(0, np.uint64)
    low, high = n.bit_length(), (n * 100 // percent).bit_length()
    return np.concatenate([_class_keys(found, d, size, percent) for size in range(low, high + 1)])


def _class_keys(found: np.ndarray, d: int, size: int, percent: int) -> np.ndarray:
    bands = differing(1 << size, percent) * 13 // 10 + 1  # one number for all sets of the class
    h = mix(found ^ np.uint64(size))
    place = (h % np.uint64(bands)) * np.uint64(BITS) + (h >> np.uint64(48))
    place, times = np.unique(place, return_counts=True)
    place = place[times % 2 == 1]  # the bits that stay set
    band = (place >> np.uint64(16)).astype(np.int64)
    ones = np.bincount(band, minlength=bands)
    digest = np.zeros(bands, np.uint64)
    np.bitwise_xor.at(digest, band, mix(place + np.uint64(1)))
    digest = mix(digest ^ (np.arange(bands, dtype=np.uint64) + np.uint64(size << 32)))
    first = np.lexsort((digest, -ones))[: d + 1]
    return digest[first]


def link_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``, found exactly.

    Shingles are numbered; the sets before a set that hold its shingles are counted
    with one pass over their postings.
    """
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, number = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by_number = np.argsort(number, kind="stable")
    posting, starts = owner[by_number], np.concatenate([[0], np.cumsum(np.bincount(number))])
    place = np.empty(len(flat), np.int64)
    place[by_number] = np.arange(len(flat))  # where a shingle of a set stands in its posting
    begins = np.concatenate([[0], np.cumsum(sizes)])
    root = np.arange(len(sets))
    forest = []
    for i in range(1, len(sets)):
        mine = slice(begins[i], begins[i + 1])
        low, high = starts[number[mine]], place[mine]  # only the sets before this one
        n = high - low
        if not n.sum():
            continue
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(posting[at], minlength=i)
        linked = np.flatnonzero(100 * common >= percent * (sizes[i] + sizes[:i] - common))
        for group, j in zip(*np.unique(root[linked], return_index=True)):
            forest.append((int(linked[j]), i))
            root[root == group] = i
    return forest


def jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_each: int = 3, percent: int = 90, keyed: bool = False
) -> DataFrame:
    """Columns ``doc_id``, ``n_shingles``, ``component_id``: one row for each row of ``docs``.

    With ``keyed`` also ``row_key``, the row's ``row_key(doc_id, text)``, and ``group_key``, which
    rows of one component share, with ids or without (null without shingles).

    Words are cut at ASCII spaces with A-Z lower-cased. A set holds the distinct
    shingles of ``words_each`` words, or the whole sequence if there are fewer words.
    Two sets link if 100 * intersection >= ``percent`` * union. A text that is null,
    empty or blank has no shingles and is alone. The component is the smallest id that
    links reach; null ids are never that id unless there is no other. Rows with equal
    sets are one set, so groups of copies cost nothing; repeated ids are rows of their own
    and do not join what their texts do not link.
    Other columns are not read.
    """
    base = docs.select(plain(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), plain(text).alias("text"))
    out = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n", pa.int64()), ("set_id", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def sketch(batches):
        worker_state("jaccard")  # nothing is kept, and what an earlier operator kept goes
        hashes, known, none = WordHashes(), set(), np.empty(0, np.int64)
        for piece in pieces(batches, 4 << 20):
            rows = []
            if len(known) > KNOWN:
                known.clear()
            for t in piece.column(2).to_pylist():
                found = shingles(hashes.of(words(t)), words_each)
                set_id = signed_hash(found) if len(found) else None
                # A task offers the keys of a set once, so copies do not make a key hot.
                rows.append((len(found), set_id, none if set_id in known else signed(band_keys(found, percent))))
                known.add(set_id)
            yield table(out, piece.column(0), piece.column(1), *([r[i] for r in rows] for i in range(3)))

    folder = new_folder(docs.sparkSession, "sets")
    sets = stored(base.mapInArrow(sketch, "doc_id long, row_key long, n long, set_id long, keys array<long>"), folder)
    members = saved(sets.select("doc_id", "row_key", "n", "set_id"), "members")
    # A set by its smallest id, so that the smallest set has the component's id; sets without any come last.
    node = F.struct(F.col("rep").isNull().alias("none"), F.coalesce("rep", F.lit(0)).alias("id"), F.col("set_id"))
    first = members.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep")).select("set_id", node.alias("node"))

    # Sets that share a key: each is tied to the smallest one, never to all. The keys move
    # once: the minima and the join both work on the partitions made here.
    keys = (
        sets.filter("size(keys) > 0").select("set_id", F.explode("keys").alias("key"))
        .filter("set_id IS NOT NULL AND key IS NOT NULL").repartition("key")
    )
    shared = keys.groupBy("key").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).filter("low < high")
    ties = keys.join(shared.select("key", "low").hint("merge"), "key").filter("set_id <> low").select(F.col("set_id").alias("u"), F.col("low").alias("v"))
    groups = saved(components(ties), "groups").withColumnRenamed("node", "set_id")
    removed(docs.sparkSession, folder)  # the keys, several bytes a word, go before texts move

    links = saved(_verified(base, members, groups, words_each, percent), "links")
    joined = components(
        links.join(first.select(F.col("set_id").alias("u"), F.col("node").alias("ru")), "u")
        .join(first.select(F.col("set_id").alias("v"), F.col("node").alias("rv")), "v")
        .select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    ).select(F.col("node.set_id").alias("set_id"), "component")
    label = first.join(joined, "set_id", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    return members.join(label, "set_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(~F.coalesce("component.none", F.lit(True)), F.col("component.id")).otherwise(F.col("doc_id")).alias("component_id"),
        *(["row_key", F.col("component.set_id").alias("group_key")] if keyed else []),
    )


def row_key(doc_id: str, text: str) -> Column:
    """The same for rows equal in id and text, null or not."""
    return F.xxhash64(F.struct(plain(doc_id), plain(text)), plain(doc_id).isNull())


def marked(rows: DataFrame, wanted: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with a column ``name``: true where ``key`` (a long) is in ``wanted``, and for few other rows.

    The keys of ``wanted`` are set in ``WORDS`` words of 64 bits, at most one row a word whatever
    the input, so the broadcast is bounded. Beyond some ten million keys it marks ever more rows.
    """
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(64 * WORDS))
    word, mask = F.floor(bit / 64).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    held = wanted.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("bits"))
    found = F.coalesce(F.col("bits").bitwiseAND(mask) != 0, F.lit(False))
    return rows.join(F.broadcast(held), word == F.col("word"), "left").select(*rows.columns, found.alias(name))


def among(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` (a long) is not in ``wanted``; every other row stays."""
    return marked(rows, wanted, key, "among").filter("among").drop("among")


def signed_hash(found: np.ndarray) -> int:
    value = xxhash.xxh64_intdigest(found.tobytes())
    return value - (1 << 64) if value >> 63 else value


def _verified(base: DataFrame, members: DataFrame, groups: DataFrame, words_each: int, percent: int) -> DataFrame:
    """Edges ``u``, ``v`` between set ids: within each candidate group a forest of its links."""
    spark = base.sparkSession
    # Only groups of more than one block need their size; their rows are dealt over SALTS tasks.
    large = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n")).filter("n > 1")
    large = large.select("component", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = groups.withColumn("salt", F.pmod(F.xxhash64("set_id", F.lit(1)), F.lit(SALTS)).cast("int"))
    blocks = F.coalesce("n", F.lit(1))
    placed = salted.join(large, ["component", "salt"], "left").select(
        "set_id", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("set_id"), blocks).cast("int").alias("mine")
    )
    pairs = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("mine")).cast("long") * F.col("blocks") + F.greatest(o, F.col("mine")))
    )
    # A text of each set; equal sets from several texts drop out in the verifying task.
    named = F.min(F.when(F.col("doc_id").isNotNull(), F.col("row_key")))
    holder = members.filter("n > 0").groupBy("set_id").agg(F.coalesce(named, F.min("row_key")).alias("row_key"))
    wanted = saved(placed.join(holder, "set_id").select("row_key", "set_id", "component", pairs.alias("pairs")), "wanted")
    parts = bucket_count(wanted.agg(F.sum(F.size("pairs"))).first()[0], ROWS)
    unit = F.xxhash64("component", "pair")
    # Copies without id are one row here, however many there are.
    nameless = base.filter("doc_id IS NULL").groupBy("row_key").agg(F.first("text").alias("text"))
    texts = among(base.filter("doc_id IS NOT NULL").select("row_key", "text"), wanted, "row_key").unionByName(nameless)
    tasks = (
        texts.join(wanted, "row_key").select("text", "set_id", "component", F.explode("pairs").alias("pair"))
        .select(F.pmod(unit, F.lit(parts)).cast("int").alias("part"), unit.alias("unit"), "set_id", "text")
    )

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        hashes, edges = WordHashes(), []
        for _, rows in frame.groupby("unit"):
            sets = {}
            for set_id, t in zip(rows["set_id"], rows["text"]):
                found = shingles(hashes.of(words(t)), words_each)
                if len(found) and signed_hash(found) == set_id:  # two texts may have one key
                    sets[set_id] = found
            ids = sorted(sets)
            edges += [(ids[a], ids[b]) for a, b in link_forest([sets[i] for i in ids], percent)] if ids else []
        return pd.DataFrame(edges, columns=["u", "v"], dtype="int64")

    return tasks.groupBy("part").applyInPandas(verify, "u long, v long") if parts else spark.createDataFrame([], "u long, v long")
