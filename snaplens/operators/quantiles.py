"""Exact quantiles with linear interpolation by radix selection, for groups of any size.

Doubles become longs of the same order. A pass counts values per group and leading bits,
and running totals over the bins tell which bin holds each wanted rank. Those bins (at most two per
probability) are the bracket, a table that is joined to the values for the next bits. After the
third pass, whose bins are the values themselves, the rank is found. The passes are one lazy plan that is the same for every
size: counts combine map-side, a bracket never has more than 2**22 bins, and no pass sorts or gathers
the values of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplens.roles import col

SHIFTS = (44, 22, 0)  # bits of the key below a bin, pass by pass


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Columns ``keys`` and ``q``, an array with one double per entry of ``probs``.

    Key columns must not be null; groups without a value are absent.
    """
    return long_quantiles(df, [value], probs, keys).select(*map(col, keys), "q")


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles of whole columns; at most one row per column reaches the driver."""
    found = {r["column"]: list(r["q"]) for r in long_quantiles(df, columns, probs).collect()}
    return {c: found.get(c, [None] * len(probs)) for c in columns}


def number(value: Column) -> Column:
    """As a double; NaN counts as missing."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def sort_key(value: Column) -> Column:
    """A long that never falls as the double grows: its exponent, 52 bits of its fraction, and the sign.

    Next to a power of two, where the logarithm may be one off, neighbours can share a key; so do
    subnormal numbers and 0, and infinity and the largest number. The last pass tells them apart.
    """
    size = F.least(F.greatest(F.abs(value), F.lit(2.0**-1022)), F.lit(1.7976931348623157e308))
    exponent = F.floor(F.log2(size)).cast("int")
    fraction = size * F.pow(F.lit(2.0), -exponent) - 1.0  # powers of two are exact, so this is too
    key = (exponent + 1023).cast("bigint") * F.lit(1 << 52) + F.floor(fraction * F.lit(2.0**52))
    return F.when(value < 0, -key).otherwise(key)


def long_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Rows ``keys``, ``column``, ``q``: the quantiles of several columns, per group if keyed. Nothing runs yet.

    Columns and groups without a value are absent. ``df`` is read once per
    pass, three times.
    """
    by = [*keys, "column"]
    cells = [F.struct(F.lit(c).alias("column"), number(col(c)).alias("__v")) for c in columns]
    values = df.select(*map(col, keys), F.inline(F.array(*cells))).filter("__v IS NOT NULL")
    values = values.withColumn("__key", sort_key(F.col("__v")))

    ranks = [edge((F.col("__all") - 1) * F.lit(float(p))).cast("bigint") for p in probs for edge in (F.floor, F.ceil)]
    held, brackets = by, None
    for before, shift in zip((64, *SHIFTS), SHIFTS):
        binned = values.withColumn("__bin", F.shiftright("__key", shift) if shift else F.col("__v"))
        if brackets is not None:
            # without keys a bracket table has two rows per column and probability at most
            binned = binned.withColumn("__prior", F.shiftright("__key", before)).join(brackets if keys else F.broadcast(brackets), held)
        # a bracket's total and ranks are the same for all its bins
        carried = [] if brackets is None else ["__all", "__ranks"]
        bins = binned.groupBy(*map(col, held), "__bin", *carried).agg(F.count("*").alias("__n"), F.min("__v").alias("__v"))
        inside = Window.partitionBy(*map(col, held))
        running = inside.orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = bins.withColumn("__below", F.sum("__n").over(running) - F.col("__n"))
        if brackets is None:
            bins = bins.withColumn("__all", F.sum("__n").over(inside)).withColumn("__ranks", F.array(*ranks))
        here = F.transform("__ranks", lambda r: F.when((r >= F.col("__below")) & (r < F.col("__below") + F.col("__n")), r - F.col("__below")))
        bins = bins.select(*map(col, by), F.col("__bin").alias("__prior"), "__all", "__v", here.alias("__ranks"))
        bins = bins.filter(F.exists("__ranks", lambda r: r.isNotNull()))
        brackets = bins.drop("__v")
        held = [*by, "__prior"]

    found = [F.max(F.when(F.get("__ranks", F.lit(i)).isNotNull(), F.col("__v"))).alias(f"__q{i}") for i in range(len(ranks))]
    stats = bins.groupBy(*map(col, by)).agg(F.max("__all").alias("__all"), *found)

    def between(i: int, p: float) -> Column:
        low, high = F.col(f"__q{2 * i}"), F.col(f"__q{2 * i + 1}")
        part = F.pmod((F.col("__all") - 1) * F.lit(float(p)), F.lit(1.0))
        return F.when(low == high, low).otherwise(low * (1 - part) + high * part)

    return stats.select(*map(col, by), F.array(*[between(i, p) for i, p in enumerate(probs)]).alias("q"))
