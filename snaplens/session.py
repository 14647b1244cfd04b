"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A skewed join may be followed by a window on the same key; let the join
    # split its hot partition even though that costs another exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", name: str = "snaplens", **extra: str) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    parts = "8" if cpus == "*" else str(max(2, int(cpus)))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _scratch() -> str:
    return tempfile.mkdtemp(prefix="snaplens-")


def new_path(spark: SparkSession, name: str = "snaplens") -> str | None:
    """A path not used yet in the shared folder that ``spark.checkpoint.dir`` names.

    A local session without one gets a temporary folder; a cluster without one has no such path.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            return None
        folder = _scratch()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stabilise(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back, so that later passes do not redo its plan.

    The table goes to ``new_path`` and so outlives lost executors; where there is none, the plan stays as it is.
    """
    path = new_path(df.sparkSession)
    if path is None:
        return df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
