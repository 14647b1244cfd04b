"""The two file ends: CSV written to the shared folder, checked and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import query, table
from snaplens.session import new_path
from snaplens.sources.export import check_manifest, csv_files, write_csv
from snaplens.sources.tables import read_csv, read_quoted_csv


def _path(spark, name):
    path = new_path(spark, name)
    if path is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return path


TEXTS_SQL = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, md5(nullif(text, '')) AS text FROM documents"


@query("csv_round_trip", TEXTS_SQL)
def _(spark, folder):
    """Texts with quotes, commas and line breaks, through a file and back."""
    path = _path(spark, "csv")
    write_csv(table(spark, folder, "documents").select("doc_id", "lang", "source", "text"), path)
    return read_csv(spark, path, multiline=True).select("doc_id", "lang", "source", F.md5("text").alias("text"))


@query("csv_round_trip_split", TEXTS_SQL)
def _(spark, folder):
    """The same, each file read by as many tasks as it has splits."""
    path = _path(spark, "csv")
    write_csv(table(spark, folder, "documents").select("doc_id", "lang", "source", "text"), path)
    return read_quoted_csv(spark, path).select("doc_id", "lang", "source", F.md5("text").alias("text"))


@query(
    "export_round_trip",
    """SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS price, 0::BIGINT AS damaged,
        (SELECT count(*) FROM lineitem) AS listed FROM lineitem GROUP BY 1""",
)
def _(spark, folder):
    """Line items exported by order with a manifest; the files are checked against it and read back.

    Rebalancing cuts what a file holds by size, so their number follows the table and a hot order or null ids fill several.
    """
    path = _path(spark, "export")
    write_csv(table(spark, folder, "lineitem").hint("rebalance", "l_orderkey"), path, manifest=True)
    damaged = check_manifest(spark, path).agg(F.count("*").alias("n")).scalar()
    listed = csv_files(spark, path).agg(F.sum(F.col("lines") - 1).alias("n")).scalar()  # without headers
    back = read_csv(spark, path)
    return back.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice").cast("double")), 2).alias("price")
    ).select("*", damaged.alias("damaged"), listed.alias("listed"))
