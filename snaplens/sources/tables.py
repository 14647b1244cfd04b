"""Reading snapshot tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snaplens.operators.profile import column_stats
from snaplens.operators.semantics import (
    Semantic,
    blank_nan,
    canonical_names,
    cast_types,
    detect_types,
    fill_missing,
)
from snaplens.roles import Roles, col
from snaplens.session import stabilise

# Cell texts that mean "missing".
NA_TOKENS = ("", "NA", "N/A", "NaN", "null")


@dataclass(frozen=True)
class Loaded:
    """A typed table and the semantic type of each column."""

    df: DataFrame
    types: dict[str, Semantic]
    stats: DataFrame  # counted before missing values were filled


def read_csv(
    spark: SparkSession, path: str, na_tokens: Sequence[str] = NA_TOKENS, multiline: bool = False
) -> DataFrame:
    """All-string scan of UTF-8 CSV with a header.

    Set ``multiline`` when quoted cells hold line breaks; such files are then read by one task
    each. ``read_quoted_csv`` splits them.
    """
    df = (
        spark.read.option("header", True)
        .option("encoding", "UTF-8")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    if not df.columns or df.isEmpty():
        raise ValueError(f"{path} is empty")
    return df.select(*[F.when(~col(c).isin(*na_tokens), col(c)).alias(c) for c in df.columns])


def read_quoted_csv(
    spark: SparkSession, path: str, na_tokens: Sequence[str] = NA_TOKENS, bad: str | None = None
) -> DataFrame:
    """All-string scan like ``read_csv`` for large files whose quoted cells hold line breaks, read by many tasks.

    A line starts a record if the quotes before it in its file are even. They are counted from the
    start of each split, the splits' counts are added up (one row per split), and only the lines of
    records that hold line breaks are shuffled. Quotes must come in pairs, as ``write_csv`` writes
    them; a file with an odd number of them is refused. Records with too few or too many cells stay
    as they are read; with ``bad``, a column of that name holds their text, and null for all others.
    """
    columns = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    if not columns:
        raise ValueError(f"{path} is empty")
    lines = stabilise(_numbered_lines(spark, path))
    ahead = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        lines.groupBy("file", "start")
        .agg(F.max_by("after", "nth").alias("turns"), F.max("even").alias("even"), F.max("odd").alias("odd"))
        .withColumn("before", F.coalesce(F.sum("turns").over(ahead), F.lit(0)) % 2)
        .withColumn("latest", F.when(F.col("before") == 0, F.col("even")).otherwise(F.col("odd")))
        .withColumn("open", F.last(F.when(F.col("latest").isNotNull(), F.struct("start", F.col("latest").alias("nth"))), True).over(ahead))
        .select("file", "start", "turns", "before", "open")
    )
    odd = splits.groupBy("file").agg(F.sum("turns").alias("n")).filter("n % 2 = 1").select("file").first()
    if odd is not None:
        raise ValueError(f"{odd[0]} holds a quote without its other half")
    # The head of a record: its own split and line, or those of the record that an earlier split left open.
    latest = F.when(F.col("before") == 0, F.col("even")).otherwise(F.col("odd"))
    placed = lines.join(splits, ["file", "start"]).withColumn(
        "head", F.when(latest.isNotNull(), F.struct("start", latest.alias("nth"))).otherwise(F.col("open")))
    alone = (F.col("flip") == F.col("before")) & (F.col("after") == F.col("before"))
    parts = F.array_sort(F.collect_list(F.struct("start", "nth", "value")))
    longer = placed.filter(~alone).groupBy("file", "head").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("record"))
    records = placed.filter(alone).select("head", F.col("value").alias("record")).unionByName(longer.select("head", "record"))
    text = F.regexp_replace("record", "\r\\z", "")
    records = records.filter("head.start > 0 OR head.nth > 0").select(text.alias("record")).filter("record <> ''")
    names = [f"c{i}" for i in range(len(columns))]
    schema = ", ".join(f"{n} string" for n in [*names, "bad"])
    options = {"quote": '"', "escape": '"', "multiLine": "true", "columnNameOfCorruptRecord": "bad", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    cells = records.select(F.from_csv("record", schema, options).alias("r"))
    return cells.select(
        *[F.when(~F.col(f"r.{n}").isin(*na_tokens), F.col(f"r.{n}")).alias(c) for n, c in zip(names, columns)],
        *([F.col("r.bad").alias(bad)] if bad else []),
    )


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``file``, ``start`` of their split and ``nth`` place in it, as counted from 0 at the split's start.

    ``flip`` and ``after``: parity of the split's quotes before and behind the line; ``even`` and ``odd``:
    the last line so far before which that parity is even or odd (null: none).
    """
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), "value")

    def number(batches):
        now, nth, turns, last = None, 0, 0, [-1, -1]
        for batch in batches:
            files, starts = batch.column(0), batch.column(1).to_numpy()
            quotes = pc.count_substring(batch.column(2), '"').to_numpy(zero_copy_only=False)
            same = pc.equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False) & (starts[1:] == starts[:-1])
            cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if now != (files[i].as_py(), int(starts[i])):
                    now, nth, turns, last = (files[i].as_py(), int(starts[i])), 0, 0, [-1, -1]
                after = (turns + np.cumsum(quotes[i:j])) % 2
                flip = np.concatenate([[turns], after[:-1]])
                place = np.arange(nth, nth + j - i)
                latest = [np.maximum.accumulate(np.concatenate([[last[k]], np.where(flip == k, place, -1)]))[1:] for k in (0, 1)]
                nth, turns, last = nth + j - i, int(after[-1]), [int(x[-1]) for x in latest]
                yield pa.RecordBatch.from_arrays(
                    [files[i:j], batch.column(1)[i:j], pa.array(place), pa.array(flip.astype(np.int32)), pa.array(after.astype(np.int32)),
                     *[pa.array(x, mask=x < 0) for x in latest], batch.column(2)[i:j]],
                    names=["file", "start", "nth", "flip", "after", "even", "odd", "value"])

    return lines.mapInArrow(number, "file string, start long, nth long, flip int, after int, even long, odd long, value string")


def read_table(spark: SparkSession, path: str, **csv_options) -> DataFrame:
    """CSV or Parquet, by extension; a path without one is taken as a Parquet folder."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix == ".csv":
        return read_csv(spark, path, **csv_options)
    if suffix in (".parquet", ""):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type {suffix!r}; convert to CSV or Parquet")


def load(df: DataFrame, roles: Roles = Roles(), types: dict[str, Semantic] | None = None) -> Loaded:
    """Type, cast, rename and fill a raw table.

    Only type detection runs a job; pass ``types`` to skip it.
    """
    df = blank_nan(df)
    types = detect_types(df) if types is None else types
    cast = canonical_names(cast_types(df, types, roles), roles)
    types = dict(zip(cast.columns, (types[c] for c in df.columns)))
    return Loaded(fill_missing(cast, types, roles), types, column_stats(cast, types))

