"""Column statistics and snapshot-table checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplens.functions.dates import days_between
from snaplens.functions.numbers import kurt, ratio, skew, std
from snaplens.operators.quantiles import long_quantiles
from snaplens.operators.semantics import Semantic, blank_nan
from snaplens.roles import Roles, col

GROUP = "group"

# Output name -> type, for the statistics that one pass of aggregates gives.
_MOMENTS = {
    "mean": "double", "std": "double", "min": "double", "max": "double",
    "skew": "double", "kurt": "double",
    "earliest": "timestamp_ntz", "latest": "timestamp_ntz", "range_days": "bigint",
    "avg_length": "double", "max_length": "bigint", "min_length": "bigint",
}


def column_stats(
    df: DataFrame, types: Mapping[str, Semantic], group: str | None = None
) -> DataFrame:
    """One row per column (and group): counts for all, the rest by semantic type.

    Moments, dates and lengths come from one pass; frequencies and quantiles from
    one pre-aggregated pass each. Rows without a group value drop out. NaN is missing.
    """
    df = blank_nan(df)
    columns = [c for c in df.columns if c in types and c != group]
    if not columns:
        raise ValueError("no column to describe")
    keys = []
    if group is not None:
        df = df.filter(col(group).isNotNull()).withColumn("__group", col(group).cast("string"))
        keys = ["__group"]
    of = {kind: [c for c in columns if types[c] is kind] for kind in Semantic}

    stats = _moments(df, columns, types, keys)
    if of[Semantic.NUMERICAL]:
        q = long_quantiles(df, of[Semantic.NUMERICAL], [0.25, 0.5, 0.75], keys)
        q = q.select(*keys, "column", *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "median", "q75"))])
        stats = stats.join(q, [*keys, "column"], "left")
    else:
        stats = stats.select("*", *[F.lit(None).cast("double").alias(n) for n in ("q25", "median", "q75")])
    stats = stats.join(
        _frequencies(df, of[Semantic.CATEGORICAL], of[Semantic.TEXT], keys), [*keys, "column"], "left"
    )
    names = [
        "column", "position", "type", "count", "non_null", "missing", "missing_pct",
        "mean", "median", "std", "min", "max", "q25", "q75", "skew", "kurt",
        "distinct", "mode", "mode_count", "rare", "rare_count",
        "earliest", "latest", "range_days", "avg_length", "max_length", "min_length",
    ]
    return stats.select(*[F.col(k).alias(GROUP) for k in keys], *names)


def _moments(
    df: DataFrame, columns: Sequence[str], types: Mapping[str, Semantic], keys: Sequence[str]
) -> DataFrame:
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(columns):
        value, kind = col(c), types[c]
        found: dict[str, Column] = {}
        if kind is Semantic.NUMERICAL:
            v = value.cast("double")
            found = {"mean": F.avg(v), "std": std(v), "min": F.min(v), "max": F.max(v), "skew": skew(v), "kurt": kurt(v)}
        elif kind is Semantic.DATE:
            v = value.cast("timestamp_ntz")
            found = {"earliest": F.min(v), "latest": F.max(v), "range_days": days_between(F.max(v), F.min(v))}
        elif kind is Semantic.TEXT:
            v = F.length(value.cast("string"))
            found = {"avg_length": F.avg(v), "max_length": F.max(v), "min_length": F.min(v)}
        aggs.append(F.count(value).alias(f"n{i}"))
        aggs += [agg.alias(f"{name}{i}") for name, agg in found.items()]
        full = F.col(f"n{i}")
        rows.append(F.struct(
            F.lit(c).alias("column"),
            F.lit(i).alias("position"),
            F.lit(kind.value).alias("type"),
            F.col("n").alias("count"),
            full.alias("non_null"),
            (F.col("n") - full).alias("missing"),
            ratio(F.col("n") - full, F.col("n"), 100.0).alias("missing_pct"),
            *[
                (F.col(f"{name}{i}") if name in found else F.lit(None)).cast(t).alias(name)
                for name, t in _MOMENTS.items()
            ],
        ))
    return df.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*rows)))


def _frequencies(
    df: DataFrame, categories: Sequence[str], texts: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Distinct count, and for categories the most and least frequent value.

    Counting per value first keeps a frequent column or group off one task. Texts
    travel as a digest. Ties go to the smaller value.
    """
    pairs = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in categories]
    pairs += [F.struct(F.lit(c).alias("column"), F.md5(col(c).cast("string")).alias("value")) for c in texts]
    if not pairs:  # keep the schema
        pairs = [F.struct(F.lit("").alias("column"), F.lit(None).cast("string").alias("value"))]
    counted = (
        df.select(*keys, F.inline(F.array(*pairs)))
        .filter("value is not null")
        .groupBy(*keys, "column", "value")
        .agg(F.count("*").alias("n"))
    )
    named = F.col("column").isin(*categories) if categories else F.lit(False)
    most, least = F.struct(-F.col("n"), "value"), F.struct("n", "value")

    def category(column: Column) -> Column:
        return F.when(named, column)

    return counted.groupBy(*keys, "column").agg(
        F.count("*").alias("distinct"),
        F.min_by("value", category(most)).alias("mode"),
        F.max(category(F.col("n"))).alias("mode_count"),
        F.min_by("value", category(least)).alias("rare"),
        F.min(category(F.col("n"))).alias("rare_count"),
    )


def validate(df: DataFrame, roles: Roles) -> DataFrame:
    """Findings as rows ``severity``, ``check``, ``detail``, ``n``; none means nothing to report."""
    r = roles.bind(df)
    stage = r.stage or next((c for c in df.columns if "stage" in c.lower()), None)
    findings = []
    for part, name, wanted in (
        (r.id, "id", roles.id), (r.snapshot, "snapshot", roles.snapshot), (stage, "stage", roles.stage)
    ):
        if part is None:
            findings.append(("warning", f"missing_{name}", wanted))
    spark = df.sparkSession
    out = spark.createDataFrame(
        [(*f, 0) for f in findings], "severity string, check string, detail string, n bigint"
    )
    if stage is not None:
        unexpected = (
            df.filter(~col(stage).isin(*roles.stages))
            .groupBy(col(stage).cast("string").alias("detail"))
            .agg(F.count("*").alias("n"))
        )
        out = out.unionByName(unexpected.select(
            F.lit("suggestion").alias("severity"), F.lit("unexpected_stage").alias("check"), "detail", "n"
        ))
    if r.id is not None and r.snapshot is not None:
        per_id = df.filter(col(r.id).isNotNull()).groupBy(col(r.id)).agg(F.count("*").alias("rows"))
        repeats = per_id.agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("n")).filter("n > 0")
        out = out.unionByName(repeats.select(
            F.lit("suggestion").alias("severity"), F.lit("duplicate_ids").alias("check"),
            F.lit(r.id).alias("detail"), "n",
        ))
    return out
