"""Shards of equal size by sampled splitters.

Keys are drawn with a chance in proportion to their rows' sizes; quantiles of the
draw cut the key range. Ranges that turn out overfull are sampled and cut again. The
ranges are narrow, so that running sums inside a range give every row its exact place
in the whole, and the place gives shard and slot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplens.llm.common import plain, saved

OVERHEAD = 16  # bytes a row counts besides its text
PER_SHARD = 16  # ranges for each shard, at least
RANGE_ROWS = 500_000  # rows of one range, about
DRAWN = 16  # sampled keys for each range
OVERFULL = 2.0  # times the mean size from which a range is cut again
ROUNDS = 4


def _key(doc_id: str, text: str) -> Column:
    """Equal texts have neighbouring keys, and different ids tell them apart."""
    low = F.lit((1 << 24) - 1)
    return F.xxhash64(plain(text)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(F.xxhash64(plain(doc_id)).bitwiseAND(low))


def shard_by_size(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot``: one row for each row.

    A row's size is the bytes of its text (null: none) plus ``OVERHEAD``. Sizes of the
    shards differ by about one row. Equal texts are neighbours: they share a shard, or
    neighbouring ones where their group meets a border or is larger than a shard. Slots
    run from 0 in each shard without gaps. Rows equal in id and text are
    interchangeable; null ids count as a key; an empty table gives an empty result.
    Other columns are not read. The driver holds splitters and one row per range.
    """
    spark = docs.sparkSession
    size = (F.coalesce(F.octet_length(plain(text)), F.lit(0)) + OVERHEAD).cast("long")
    crc = F.crc32(plain(text))
    rows = saved(docs.select(plain(doc_id).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), _key(doc_id, text).alias("key")), "rows")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(shards * PER_SHARD, -(-count // RANGE_ROWS))

    def draw(df: DataFrame, wanted: float, of: int, seed: int) -> list[int]:
        """Distinct keys, each row with chance size * wanted / of; about ``wanted`` of them."""
        u = F.pmod(F.xxhash64("key", "doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
        return sorted(r["key"] for r in df.filter(u < F.col("size") * (wanted / max(1, of))).select("key").distinct().collect())

    def quantiles(keys: list[int], pieces: int) -> list[int]:
        return [keys[len(keys) * i // pieces] for i in range(1, pieces)] if keys else []

    splitters = sorted(set(quantiles(draw(rows, ranges * DRAWN, total, 0), ranges)))
    for round_ in range(1, ROUNDS + 1):
        filled = _in_ranges(rows, splitters).groupBy("range").agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high"))
        over = {r["range"]: r["size"] for r in filled.filter((F.col("size") > OVERFULL * total / ranges) & (F.col("low") < F.col("high"))).collect()}
        if not over:
            break
        more = set()
        inside = _in_ranges(rows, splitters).filter(F.col("range").isin(list(over)))
        of = sum(over.values())
        drawn = np.array(draw(inside, DRAWN * ranges * of / total, of, round_), np.int64)
        place = np.searchsorted(np.array(splitters, np.int64), drawn, "right")
        for r, held in over.items():
            more |= set(quantiles([int(k) for k in drawn[place == r]], max(2, round(held * ranges / total))))
        splitters = sorted(set(splitters) | more)

    placed = _in_ranges(rows, splitters)
    sums = sorted(map(tuple, placed.groupBy("range").agg(F.sum("size"), F.count("*")).collect()))
    before, held_size, held_rows = [], 0, 0
    for r, s, n in sums:
        before.append((r, held_size, held_rows))
        held_size, held_rows = held_size + s, held_rows + n
    start = spark.createDataFrame(before, "range int, size_before long, rows_before long")
    inside = Window.partitionBy("range").orderBy("key", "doc_id")
    whole = (
        placed.join(F.broadcast(start), "range")  # one row per range
        .withColumn("nth", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("upto", F.col("size_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    )
    middle = F.col("upto").cast("double") - F.col("size") / 2
    whole = saved(whole.select("doc_id", "size", "text_crc32", "nth", F.least(F.floor(middle * shards / max(1, total)), F.lit(shards - 1)).cast("int").alias("shard")), "placed")
    first = whole.groupBy("shard").agg(F.min("nth").alias("first"))
    return whole.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot"))


def _in_ranges(rows: DataFrame, splitters: list[int]) -> DataFrame:
    """``rows`` with the number of the range that holds their key."""
    cuts = np.array(splitters, np.int64)
    names = rows.columns

    def place(batches):
        for batch in batches:
            keys = batch.column(names.index("key")).to_numpy()
            found = np.searchsorted(cuts, keys, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*names, "range"])

    return rows.mapInArrow(place, rows.schema.simpleString()[7:-1].replace(":", " ") + ", range int")


def write_shards(docs: DataFrame, path: str, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write whole rows as Parquet folders ``shard=N``; rows are matched by id and text checksum."""
    placed = shard_by_size(docs, shards, doc_id, text).select(F.col("doc_id").alias("__id"), "text_crc32", "shard", "slot").dropDuplicates(["__id", "text_crc32"])
    same = plain(doc_id).eqNullSafe(F.col("__id")) & F.crc32(plain(text)).eqNullSafe(F.col("text_crc32"))
    rows = docs.drop("shard", "slot").join(placed, same).drop("__id", "text_crc32")
    rows.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
