"""Joins back onto rows whose keys may be skewed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplens.roles import col

NULL_PARTS = 1024  # how far rows with a null key are spread


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[col(k) for k in keys])


def lookup_join(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of ``table``, which holds one row per key, onto ``rows``.

    The table side has one row per key, so adaptive execution can split a hot key's rows over any
    number of tasks and send each its row. Rows with a null key match nothing; they are dealt by a
    hash of their other values, not all to the task that nulls hash to.
    """
    keys = list(keys)
    order = rows.columns + [c for c in table.columns if c not in keys]
    plain = [col(f.name) for f in rows.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    unknown = reduce(or_, [col(k).isNull() for k in keys])
    spread = F.when(unknown, F.pmod(F.xxhash64(*plain), F.lit(NULL_PARTS)).cast("int")).otherwise(0)
    joined = rows.withColumn("__spread", spread).join(table.withColumn("__spread", F.lit(0)), [*keys, "__spread"], "left")
    return joined.select(*map(col, order))
