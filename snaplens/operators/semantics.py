"""Semantic column types: detection, casts and missing-value fill."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplens.roles import Roles, col, find_column


class Semantic(str, Enum):
    CATEGORICAL = "categorical"
    NUMERICAL = "numerical"
    DATE = "date"
    TEXT = "text"
    BOOLEAN = "boolean"


# Thresholds of the detection rules.
NUMERIC_CATEGORY_SHARE, NUMERIC_CATEGORY_LIMIT = 0.05, 20
STRING_CATEGORY_SHARE, STRING_CATEGORY_LIMIT = 0.5, 50
DATE_SHARE = 0.8
# The snapshot column's own format, other accepted formats, boolean spellings.
SNAPSHOT_FORMATS = ("M/d/yyyy",)
DATE_FORMATS = (
    "M/d/yyyy",
    "M/d/yyyy H:mm",
    "M/d/yyyy H:mm:ss",
    "yyyy/M/d",
    "yyyyMMdd",
    "d-MMM-yyyy",
    "d MMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
)
BOOLEAN_WORDS = {"True": True, "TRUE": True, "true": True, "False": False, "FALSE": False, "false": False}
KEPT_LOG2 = 10  # hashes kept per column, as a power of two; the rules ask for 50 at most
FILL = {Semantic.CATEGORICAL: "Unknown", Semantic.TEXT: ""}

_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_SHORTEST_DATE, _LONGEST_DATE = 8, 40
_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[Ii]nf(inity)?)$"


def _shape(date_format: str) -> str:
    """Regular expression of the texts a date format can match at all."""
    runs = re.findall(r"([A-Za-z])(\1*)|([^A-Za-z])", date_format)
    parts = []
    for letter, rest, other in runs:
        width = 1 + len(rest)
        if other:
            parts.append(re.escape(other))
        elif letter == "M" and width > 2:
            parts.append("[A-Za-z]+")
        else:
            parts.append(r"\d{1,2}" if width == 1 else r"\d{%d}" % width)
    return "^" + "".join(parts) + "$"


def parse_date(value: Column, formats: Sequence[str] = DATE_FORMATS, iso: bool = True) -> Column:
    """First format that fits, else null; ``iso`` also takes what a plain cast accepts.

    A failed parse is costly, so only texts shaped like one of the formats are parsed.
    """
    text = F.trim(value)
    shapes = [_shape(f) for f in formats]
    parsed = [
        F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz"))
        for f, shape in zip(formats, shapes)
    ]
    likely = F.length(text).between(_SHORTEST_DATE, _LONGEST_DATE) & text.rlike("|".join(shapes))
    date = F.when(likely, F.coalesce(*parsed))
    if iso:
        date = F.coalesce(F.when(F.length(text) <= _LONGEST_DATE, text.try_cast("timestamp_ntz")), date)
    return date


def parse_number(value: Column) -> Column:
    text = F.trim(value)
    # A failed cast is costly; texts that are no number skip it.
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(number), number)


def is_number(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def present(df: DataFrame, name: str) -> Column:
    """The column, where NaN counts as missing."""
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return F.nullif(col(name), F.lit(float("nan"))) if floating else col(name)


def blank_nan(df: DataFrame) -> DataFrame:
    """NaN counts as missing."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.nullif(col(c), F.lit(float("nan"))).alias(c) if c in floats else col(c) for c in df.columns]
    )


def detect_types(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, Semantic]:
    """Semantic type per column, from names, physical types and values, in one pass.

    Every cell becomes a row of its column: a 64-bit hash, and the text where the type hangs on it. Per
    column the smallest ``2**KEPT_LOG2`` different hashes are kept as mergeable state, so that
    distinct counts are exact up to there (no rule asks further), beside the counts of texts that parse.
    One row of counts per column reaches the driver.
    """
    columns = list(df.columns if columns is None else columns)
    if not columns:
        return {}
    seen = type_counts(df, columns)
    kind = {f.name: f.dataType for f in df.schema}
    return {c: _rule(c, kind[c], seen[c]) for c in columns}


def type_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, int]]:
    """Per column: ``n`` values, ``distinct`` ones, and how many are written as ``number``, ``bool`` and ``date``."""
    kind = {f.name: f.dataType for f in df.schema}

    def cell(c: str) -> Column:
        open_ = _by_name(c) is None
        text = isinstance(kind[c], T.StringType)
        value = col(c) if open_ and text else F.lit(None).cast("string")
        digest = F.xxhash64(col(c)) if open_ and (text or is_number(kind[c])) else F.lit(None).cast("bigint")
        return F.struct(
            F.lit(c).alias("column"), col(c).isNotNull().alias("present"),
            F.when(col(c).isNotNull(), digest).alias("digest"), value.alias("value"))

    value = F.col("value")
    counted = (
        df.select(F.inline(F.array(*[cell(c) for c in columns])))
        .groupBy("column")
        .agg(
            F.count_if("present").alias("n"),
            F.theta_sketch_estimate(F.theta_sketch_agg("digest", KEPT_LOG2)).alias("distinct"),
            F.count(parse_number(value)).alias("number"),
            F.count_if(value.isin(*BOOLEAN_WORDS)).alias("bool"),
            F.count(parse_date(value)).alias("date"),
        )
    )
    none = dict.fromkeys(("n", "distinct", "number", "bool", "date"), 0)
    found = {r["column"]: r.asDict() for r in counted.collect()}
    return {c: none | found.get(c, {}) for c in columns}


def _by_name(name: str) -> Semantic | None:
    lower = name.lower()
    if "date" in lower or "time" in lower:
        return Semantic.DATE
    return Semantic.CATEGORICAL if lower.endswith("id") else None


def _rule(name: str, kind: T.DataType, seen: Mapping[str, int]) -> Semantic:
    n, by_name = seen["n"], _by_name(name)
    if n == 0:
        return Semantic.TEXT
    if by_name is not None:
        return by_name
    if isinstance(kind, _DATES):
        return Semantic.DATE
    if isinstance(kind, T.BooleanType) or seen["bool"] == n:
        return Semantic.BOOLEAN
    if is_number(kind) or seen["number"] == n:
        few = seen["distinct"] / n < NUMERIC_CATEGORY_SHARE and seen["distinct"] < NUMERIC_CATEGORY_LIMIT
        return Semantic.CATEGORICAL if few else Semantic.NUMERICAL
    if isinstance(kind, T.StringType):
        if seen["date"] / n > DATE_SHARE:
            return Semantic.DATE
        if seen["distinct"] / n < STRING_CATEGORY_SHARE and seen["distinct"] < STRING_CATEGORY_LIMIT:
            return Semantic.CATEGORICAL
    return Semantic.TEXT


def type_table(df: DataFrame, types: Mapping[str, Semantic] | None = None) -> DataFrame:
    """Columns ``column``, ``position``, ``type`` and ``non_null``, one row per column, from one pass over ``df``."""
    kind = {f.name: f.dataType for f in df.schema}
    names = [c for c in df.columns if types is None or c in types]
    if types is None:
        seen = type_counts(df, names)
        types = {c: _rule(c, kind[c], seen[c]) for c in names}
        counts = {c: seen[c]["n"] for c in names}
    else:
        row = df.agg(*[F.count(col(c)) for c in names]).first() if names else ()
        counts = dict(zip(names, row))
    rows = [(c, i, types[c].value, counts[c]) for i, c in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "column string, position int, type string, non_null bigint")


def extend_types(df: DataFrame, types: Mapping[str, Semantic]) -> dict[str, Semantic]:
    """``types`` for the columns of ``df``, detecting only those added since."""
    known = {c: types[c] for c in df.columns if c in types}
    fresh = detect_types(df, [c for c in df.columns if c not in types])
    return {c: known.get(c) or fresh[c] for c in df.columns}


def cast_types(
    df: DataFrame,
    types: Mapping[str, Semantic],
    roles: Roles = Roles(),
    snapshot_formats: Sequence[str] = SNAPSHOT_FORMATS,
    date_formats: Sequence[str] = DATE_FORMATS,
) -> DataFrame:
    """Cast every column to its type in one projection; what does not parse becomes null."""
    snapshot = find_column(df, roles.snapshot)

    def cast(field: T.StructField) -> Column:
        value, kind = col(field.name), field.dataType
        wanted = types.get(field.name)
        text = isinstance(kind, T.StringType)
        if wanted is Semantic.DATE:
            if text and field.name == snapshot:
                value = parse_date(value, snapshot_formats, iso=False)
            elif text:
                value = parse_date(value, date_formats)
            elif isinstance(kind, _DATES):
                value = value.cast("timestamp_ntz")
            else:
                value = parse_date(value.cast("string"), date_formats)
        elif wanted is Semantic.NUMERICAL and text:
            value = parse_number(value)
        elif wanted is Semantic.BOOLEAN and text:
            yes = [w for w, truth in BOOLEAN_WORDS.items() if truth]
            value = F.when(value.isin(*BOOLEAN_WORDS), value.isin(*yes))
        elif wanted in (Semantic.CATEGORICAL, Semantic.TEXT):
            value = value.cast("string")
        return value.alias(field.name, metadata={"semantic": wanted.value if wanted else ""})

    return df.select(*[cast(f) for f in df.schema])


def canonical_names(df: DataFrame, roles: Roles) -> DataFrame:
    """Rename the id and snapshot columns to the spelling in ``roles``."""
    for name in (roles.id, roles.snapshot):
        found = find_column(df, name)
        if found is not None and found != name:
            df = df.withColumnRenamed(found, name)
    return df


def fill_missing(df: DataFrame, types: Mapping[str, Semantic], roles: Roles = Roles()) -> DataFrame:
    """Missing categories become ``Unknown``, missing texts empty; ids are never filled."""
    keep = find_column(df, roles.id)
    strings = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    fill = {
        c: FILL[kind] for c, kind in types.items() if kind in FILL and c in strings and c != keep
    }
    return df.select(
        *[F.coalesce(col(c), F.lit(fill[c])).alias(c) if c in fill else col(c) for c in df.columns]
    )
