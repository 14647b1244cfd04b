"""Helpers shared by the operators: shared storage, words, hashes, worker state."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="snaplens-llm-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once to the shared folder and read back; lost executors cost nothing."""
    return stored(df, new_folder(df.sparkSession, name))


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read back.

    The shuffle files of the writing query go when it ends; else they stay until the driver
    happens to collect its garbage, and those of one query after the other add up.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a copy that ``stored`` made and that no table to come reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def bucket_count(rows_or_bytes: int | None, each: int) -> int:
    """Enough buckets that each holds about ``each`` rows or bytes, whatever the total."""
    return max(1, -(-int(rows_or_bytes or 0) // each))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes split at exactly the ASCII spaces."""
    return text.encode().lower().split() if text else []


def worker_state(owner: str) -> dict:
    """A dictionary that lives as long as the Python worker, across the tasks of one operator.

    What another operator left is dropped, so that a worker never holds the memories of two.
    """
    state = sys.modules.setdefault("snaplens_worker_state", types.ModuleType("snaplens_worker_state")).__dict__
    if state.get("owner") != owner:
        state.clear()
        state["owner"] = owner
    return state


class Remembered(dict):
    """A memory of two generations: beyond ``limit`` entries only those used since the last time stay."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit, {}

    def missing(self, keys: set) -> set:
        """The keys that neither generation holds; those of the older one become new again."""
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
        unseen = keys.difference(self)
        again = list(filter(self.older.__contains__, unseen))
        self.update(zip(again, map(self.older.__getitem__, again)))
        return unseen.difference(again)


class WordHashes(dict):
    """Word to 64-bit hash, computed once; ``limit`` bounds the memory."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, found: Sequence[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(found: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; fewer words count as one shingle."""
    n = len(found)
    if n == 0:
        return found
    k = min(k, n)
    rolled = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + found[i : n - k + 1 + i])
    return np.unique(rolled)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pieces(batches: Iterator[pa.RecordBatch], chars: int, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece's last column holds about ``chars`` bytes of text."""
    for batch in batches:
        held, start = 0, 0
        sizes = pc.binary_length(batch.column(batch.num_columns - 1)).to_pylist()
        for i, size in enumerate(sizes):
            held += (size or 0) + 64
            if held >= chars or i + 1 - start >= rows:
                yield batch.slice(start, i + 1 - start)
                held, start = 0, i + 1
        if start < batch.num_rows:
            yield batch.slice(start)


def add_columns(
    docs: DataFrame, text: str, fields: T.StructType, start: Callable[[], Callable], chars: int = 4 << 20, rows: int = 4096
) -> DataFrame:
    """``docs`` with the columns ``fields`` computed from whole texts in Arrow batches.

    ``start()`` runs once per task and returns a function from a list of texts (with
    nulls) to one array per field. Columns of the same name are replaced.
    """
    kept = [f for f in docs.schema if f.name not in fields.fieldNames()]
    names = [plain(f.name) for f in kept]

    def run(batches):
        work = start()
        for piece in pieces(batches, chars, rows):
            made = work(piece.column(piece.num_columns - 1).to_pylist())
            made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in made]
            yield pa.RecordBatch.from_arrays(piece.columns[:-1] + made, names=labels)

    labels = [f.name for f in kept] + fields.fieldNames()
    schema = T.StructType([*kept, *fields])
    return docs.select(*names, plain(text).alias("__text")).mapInArrow(run, schema)


def plain(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
