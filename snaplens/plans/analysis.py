"""One analysis from a loaded table to the working table and its written summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplens.operators.features import add_features
from snaplens.operators.filters import Filter, apply_filters
from snaplens.operators.outliers import OutlierSpec, Rule, exclude_outliers, exclusion_info, outlier_rules, outlier_stats
from snaplens.operators.profile import column_stats
from snaplens.operators.semantics import Semantic
from snaplens.roles import Roles


@dataclass(frozen=True)
class Analysis:
    """Filters first, then outliers among the rows that are left, then features."""

    roles: Roles
    filters: Sequence[Filter] = ()
    outliers: OutlierSpec | None = None
    features: Sequence[str] = field(default_factory=tuple)

    def run(self, df: DataFrame) -> DataFrame:
        df = apply_filters(df, self.filters)
        if self.outliers is not None:
            df = exclude_outliers(df, self.outliers)
        return add_features(df, self.roles, self.features) if self.features else df


def _line(section: str, item: Column, metric: str, value: Column | None = None, text: Column | None = None) -> Column:
    return F.struct(
        F.lit(section).alias("section"),
        item.alias("item"),
        F.lit(metric).alias("metric"),
        (F.lit(None) if value is None else value).cast("double").alias("value"),
        (F.lit(None) if text is None else text).cast("string").alias("text"),
    )


def _setting(f: Filter) -> str:
    """Mode and bounds, selected values or search text of a filter."""
    given = [f"{name}={getattr(f, name)}" for name in ("low", "high", "search") if getattr(f, name, None) is not None]
    given += [", ".join(map(str, f.values))] if hasattr(f, "values") else []
    return ": ".join([getattr(f, "mode", "include"), *([" ".join(given)] if given else [])])


def summary(
    df: DataFrame,
    types: Mapping[str, Semantic],
    filters: Sequence[Filter] = (),
    outliers: OutlierSpec | None = None,
) -> DataFrame:
    """The analysis in long form: ``section``, ``item``, ``metric``, ``value``, ``text``.

    ``df`` is the loaded table; totals and statistics describe what filters and
    outlier exclusion leave of it.
    """
    kept = apply_filters(df, filters)
    rules: list[Rule] = outlier_rules(kept, outliers) if outliers else []
    working = exclude_outliers(kept, outliers, rules) if outliers else kept

    none = F.lit(None).cast("string")
    lines = [
        _line("data", none, "records", F.col("n")),
        _line("data", none, "columns", F.lit(len(df.columns))),
    ]
    for f in filters:
        if f.active and f.column in df.columns:
            lines.append(_line("filters", F.lit(f.column), type(f).__name__, text=F.lit(_setting(f))))
    out = working.agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(*lines)))

    if outliers:
        info = exclusion_info(kept, outliers, rules).select(F.inline(F.array(
            _line("outliers", none, "excluded_rows", F.col("excluded_rows")),
            _line("outliers", none, "exclusion_pct", F.col("exclusion_pct")),
            _line("outliers", none, "method", text=F.col("method")),
            _line("outliers", none, "sensitivity", text=F.col("sensitivity")),
            _line("outliers", none, "columns", text=F.col("columns")),
            _line("outliers", none, "combination", text=F.col("combination")),
        )))
        per_column = outlier_stats(kept, outliers, rules).select(F.inline(F.array(
            _line("outliers", F.col("column"), "outliers", F.col("outliers")),
            _line("outliers", F.col("column"), "pct", F.col("pct")),
        )))
        out = out.unionByName(info).unionByName(per_column)

    stats = column_stats(working, types)
    of = {k: F.col("type") == k.value for k in Semantic}
    shown = [
        (F.lit(True), _line("columns", F.col("column"), "type", text=F.col("type"))),
        (F.lit(True), _line("columns", F.col("column"), "count", F.col("count"))),
        (F.lit(True), _line("columns", F.col("column"), "missing", F.col("missing"))),
        (F.lit(True), _line("columns", F.col("column"), "missing_pct", F.col("missing_pct"))),
        *[
            (of[Semantic.NUMERICAL], _line("columns", F.col("column"), m, F.col(m)))
            for m in ("mean", "median", "std", "min", "max")
        ],
        (of[Semantic.CATEGORICAL], _line("columns", F.col("column"), "distinct", F.col("distinct"))),
        (of[Semantic.CATEGORICAL], _line("columns", F.col("column"), "mode", F.col("mode_count"), F.col("mode"))),
        (of[Semantic.DATE], _line("columns", F.col("column"), "earliest", text=_stamp("earliest"))),
        (of[Semantic.DATE], _line("columns", F.col("column"), "latest", text=_stamp("latest"))),
        (of[Semantic.DATE], _line("columns", F.col("column"), "range_days", F.col("range_days"))),
    ]
    lines = F.array_compact(F.array(*[F.when(test, line) for test, line in shown]))
    return out.unionByName(stats.select(F.inline(lines)))


def _stamp(name: str) -> Column:
    return F.date_format(F.col(name), "yyyy-MM-dd HH:mm:ss")
