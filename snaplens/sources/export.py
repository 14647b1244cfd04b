"""Writing tables and describing what would be written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplens.roles import col


def write_csv(df: DataFrame, folder: str, mode: str = "errorifexists", manifest: bool = False) -> None:
    """One CSV file per partition, each with a header; spaces and line breaks in cells stay as they are.

    Spark commits each file once, however often its task runs. With ``manifest`` the folder also gets
    ``_manifest``: a row per file with its lines, bytes and checksum, as ``check_manifest`` expects.
    """
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(folder)
    )
    if manifest:
        csv_files(df.sparkSession, folder).write.mode("overwrite").parquet(f"{folder}/_manifest")


def csv_files(spark: SparkSession, folder: str) -> DataFrame:
    """Columns ``file``, ``lines``, ``bytes``, ``checksum``: what stands in each file of ``folder``.

    Lines are counted and hashed where they are read, by as many tasks as a file has splits; the checksum does not
    depend on how it is split.
    """
    lines = spark.read.text(folder).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    return lines.groupBy("file").agg(
        F.count("*").alias("lines"),
        F.sum(F.octet_length("value") + 1).alias("bytes"),
        F.bit_xor(F.xxhash64("value")).alias("checksum"))


def check_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files that are missing, not listed or changed since ``write_csv`` listed them; no row means all is well."""
    listed = spark.read.parquet(f"{folder}/_manifest")
    found = csv_files(spark, folder)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("lines", "bytes", "checksum")]
    joined = listed.alias("l").join(found.alias("f"), F.col("l.file") == F.col("f.file"), "full")
    problem = F.when(F.col("f.file").isNull(), "missing").when(F.col("l.file").isNull(), "not listed").otherwise("changed")
    return joined.filter(~(same[0] & same[1] & same[2])).select(F.coalesce("l.file", "f.file").alias("file"), problem.alias("problem"))


def write_parquet(df: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(folder)


def order_columns(df: DataFrame, original: Sequence[str], features: Sequence[str] = ()) -> DataFrame:
    """Original columns first, then features, then whatever else there is."""
    present = [c for c in dict.fromkeys([*original, *features]) if c in df.columns]
    return df.select(*map(col, present), *[col(c) for c in df.columns if c not in present])


def export_info(df: DataFrame) -> DataFrame:
    """Rows, columns, CSV size in bytes (header included) and the columns' types, as one row."""
    header = len((",".join(df.columns) + "\n").encode())
    line = F.octet_length(F.to_csv(F.struct(*[col(c) for c in df.columns]))) + 1
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        (F.coalesce(F.sum(line), F.lit(0)) + F.lit(header)).alias("csv_bytes"),
    ).select(
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        "csv_bytes",
        F.lit(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)).alias("columns"),
    )
