"""Typed row filters, folded into one predicate that Catalyst can push to the scan."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplens.operators.quantiles import long_quantiles
from snaplens.operators.semantics import Semantic
from snaplens.roles import col


@dataclass(frozen=True)
class CategoricalFilter:
    """Membership; no selected value means no row, in both modes.

    Values are texts. Fractional columns compare them as numbers and booleans as
    truth values, so neither depends on how an engine writes ``1e7`` or ``true``.
    """

    column: str
    values: Sequence[str]
    mode: str = "include"  # or exclude
    active: bool = True

    def predicate(self, kind: T.DataType) -> Column | None:
        if not self.values:
            return F.lit(False)
        inside = self._inside(kind)
        if self.mode == "include":
            return inside
        return col(self.column).isNull() | ~inside

    def _inside(self, kind: T.DataType) -> Column:
        texts = [str(v) for v in self.values]
        if isinstance(kind, T.StringType):
            return col(self.column).isin(*texts)
        if isinstance(kind, T.IntegralType):  # compare as numbers, so that it is pushed down
            numbers = [int(t) for t in texts if t.lstrip("-").isdigit() and str(int(t)) == t]
            return col(self.column).isin(*numbers) if numbers else F.lit(False)
        if isinstance(kind, T.FractionalType):
            numbers = [F.lit(t).cast(kind) for t in texts if _is_finite(t)]
            return col(self.column).isin(*numbers) if numbers else F.lit(False)
        if isinstance(kind, T.BooleanType):
            truths = {"true": True, "false": False}
            found = [truths[t.lower()] for t in texts if t.lower() in truths]
            return col(self.column).isin(*found) if found else F.lit(False)
        return col(self.column).cast("string").isin(*texts)


@dataclass(frozen=True)
class NumericFilter:
    """``range`` keeps both bounds, ``greater_than`` and ``less_than`` are strict; NaN is missing."""

    column: str
    mode: str = "range"
    low: float | None = None
    high: float | None = None
    active: bool = True

    def predicate(self, kind: T.DataType) -> Column | None:
        test = _compare(self.mode, ("greater_than", "less_than"), col(self.column), self.low, self.high, F.lit)
        if test is None or not isinstance(kind, (T.DoubleType, T.FloatType)):
            return test
        return test & ~F.isnan(col(self.column))  # NaN sorts above all numbers; the bounds still reach the scan


@dataclass(frozen=True)
class DateFilter:
    """``range`` keeps both bounds, ``after`` and ``before`` are strict; a date means its midnight."""

    column: str
    mode: str = "range"
    low: dt.date | dt.datetime | str | None = None
    high: dt.date | dt.datetime | str | None = None
    active: bool = True

    def predicate(self, kind: T.DataType) -> Column | None:
        target = "timestamp" if isinstance(kind, T.TimestampType) else "timestamp_ntz"

        def moment(value: object) -> Column:
            return F.lit(str(value)).cast(target)

        return _compare(self.mode, ("after", "before"), col(self.column), self.low, self.high, moment)


@dataclass(frozen=True)
class TextFilter:
    """Literal search; an empty search keeps every row."""

    column: str
    search: str
    mode: str = "contains"  # starts_with, ends_with, exact
    case_sensitive: bool = False
    active: bool = True

    def predicate(self, kind: T.DataType) -> Column | None:
        if not self.search:
            return None
        value, search = col(self.column).cast("string"), F.lit(self.search)
        if not self.case_sensitive:
            value, search = F.lower(value), F.lower(search)
        tests = {
            "contains": value.contains,
            "starts_with": value.startswith,
            "ends_with": value.endswith,
            "exact": value.__eq__,
        }
        return tests[self.mode](search) if self.mode in tests else None


@dataclass(frozen=True)
class BooleanFilter:
    """Membership; no selected value means no row."""

    column: str
    values: Sequence[bool] = (True, False)
    active: bool = True

    def predicate(self, kind: T.DataType) -> Column | None:
        return col(self.column).isin(*self.values) if self.values else F.lit(False)


Filter = CategoricalFilter | NumericFilter | DateFilter | TextFilter | BooleanFilter


def _is_finite(text: str) -> bool:
    try:
        return math.isfinite(float(text))
    except ValueError:
        return False


def _compare(mode, strict, value, low, high, literal) -> Column | None:
    above, below = strict
    if mode == "range":
        return (value >= literal(low)) & (value <= literal(high))
    if mode == above:
        return value > literal(low)
    if mode == below:
        return value < literal(high)
    return None


def apply_filters(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Rows that satisfy every active filter; filters on unknown columns are skipped."""
    kinds = {f.name: f.dataType for f in df.schema}
    tests = [f.predicate(kinds[f.column]) for f in filters if f.active and f.column in kinds]
    tests = [t for t in tests if t is not None]
    return df.filter(reduce(and_, tests)) if tests else df


def filter_options(df: DataFrame, types: Mapping[str, Semantic]) -> DataFrame:
    """What each column can be filtered by.

    One row per distinct value of a category (``option``), one row for any other
    column: numeric bounds and quartiles, or first and last day. Rows are ordered by
    column, then option.
    """
    columns = [c for c in df.columns if c in types]
    of = {kind: [c for c in columns if types[c] is kind] for kind in Semantic}
    empty = {
        "option": "string", "min": "double", "p25": "double", "p50": "double", "p75": "double",
        "max": "double", "min_date": "date", "max_date": "date",
    }

    def shaped(rows: DataFrame) -> DataFrame:
        return rows.select("column", "type", *[
            F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()
        ])

    parts = []
    if of[Semantic.CATEGORICAL]:
        pairs = [
            F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("option"))
            for c in of[Semantic.CATEGORICAL]
        ]
        values = df.select(F.inline(F.array(*pairs))).filter("option is not null").distinct()
        parts.append(shaped(values.withColumn("type", F.lit("categorical"))))
    plain = of[Semantic.DATE] + of[Semantic.TEXT] + of[Semantic.BOOLEAN] + of[Semantic.NUMERICAL]
    if plain:
        aggs, rows = [], []
        for i, c in enumerate(plain):
            kind, got = types[c], {}
            if kind is Semantic.DATE:
                got = {"min_date": F.min(col(c)).cast("date"), "max_date": F.max(col(c)).cast("date")}
            elif kind is Semantic.NUMERICAL:
                got = {"min": F.min(col(c)).cast("double"), "max": F.max(col(c)).cast("double")}
            aggs += [a.alias(f"{n}{i}") for n, a in got.items()]
            rows.append(F.struct(
                F.lit(c).alias("column"), F.lit(kind.value).alias("type"),
                *[
                    (F.col(f"{n}{i}") if n in got else F.lit(None)).cast(t).alias(n)
                    for n, t in empty.items() if not n.startswith("p")
                ],
            ))
        aggs = aggs or [F.count(F.lit(1)).alias("n")]
        bounds = df.agg(*aggs).select(F.inline(F.array(*rows)))
        if of[Semantic.NUMERICAL]:
            q = long_quantiles(df, of[Semantic.NUMERICAL], [0.25, 0.5, 0.75]).select(
                "column", *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))]
            )
            bounds = bounds.join(q, "column", "left")
        parts.append(shaped(bounds))
    return reduce(DataFrame.unionByName, parts).orderBy("column", "option")


def clip_upper(df: DataFrame, column: str, limit: float) -> DataFrame:
    """``column`` capped at ``limit``, with ``above_limit`` marking the rows that were above."""
    above = F.coalesce(col(column) > limit, F.lit(False))
    return df.withColumn("above_limit", above).withColumn(
        column, F.when(F.col("above_limit"), F.lit(limit)).otherwise(col(column))
    )


def preview(df: DataFrame, rows: int = 100, columns: int = 10, order_by: Sequence[str] = ()) -> DataFrame:
    """The first rows of the first columns; ordered previews plan as a top-k."""
    ordered = df.orderBy(*map(col, order_by)) if order_by else df
    return ordered.select(*map(col, df.columns[:columns])).limit(rows)


def select_columns(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """The named columns that exist; all of them when none are named."""
    if columns is None:
        return df
    return df.select(*[col(c) for c in columns if c in df.columns])
