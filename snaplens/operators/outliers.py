"""Outlier rules per numeric column, combined over columns, and row exclusion.

Every rule comes down to a few numbers per column. They are computed first, by
aggregates that combine map-side, and then applied as literals, so the row
predicate is plain codegen and can reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplens.functions.numbers import ratio
from snaplens.operators.isolation import TREE_ROWS, TREES, grow_forest, share_cut, short_intervals, step_counts, within
from snaplens.operators.quantiles import column_quantiles
from snaplens.operators.semantics import blank_nan, is_number
from snaplens.roles import col

# Sensitivity presets per method, and the scale of the modified z-score.
PRESETS = {
    "conservative": {"iqr": 3.0, "z_score": 3.5, "modified_z_score": 3.5, "isolation_forest": 0.05},
    "moderate": {"iqr": 2.0, "z_score": 3.0, "modified_z_score": 3.0, "isolation_forest": 0.10},
    "aggressive": {"iqr": 1.5, "z_score": 2.5, "modified_z_score": 2.5, "isolation_forest": 0.15},
    "very_aggressive": {"iqr": 1.2, "z_score": 2.0, "modified_z_score": 2.0, "isolation_forest": 0.20},
}
METHODS = ("iqr", "z_score", "modified_z_score", "isolation_forest")
COMBINATIONS = ("any", "all", "majority")
MAD_SCALE = 0.6745
MIN_VALUES = 10


@dataclass(frozen=True)
class OutlierSpec:
    """One method and sensitivity for all columns.

    For the isolation forest: ``row_key`` identifies a row when sampling (default: its position),
    ``trees`` and ``tree_rows`` give the forest's size.
    """

    columns: Sequence[str]
    method: str = "iqr"
    sensitivity: str = "moderate"
    combine: str = "any"
    row_key: Sequence[str] = ()
    trees: int = TREES
    tree_rows: int = TREE_ROWS

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method!r}")
        if self.sensitivity not in PRESETS:
            raise ValueError(f"unknown sensitivity {self.sensitivity!r}")
        if self.trees < 1 or self.tree_rows < 2:
            raise ValueError("a forest needs a tree, and a tree two rows")

    @property
    def threshold(self) -> float:
        return PRESETS[self.sensitivity][self.method]


@dataclass(frozen=True)
class Rule:
    """What was learnt about one column. ``flag`` is None when the rule does not apply.

    ``has_nan``: the column held NaN when the rule was learnt. Only then is it tested
    for, because that test keeps the predicate from reaching the scan.
    """

    column: str
    lower: float | None = None
    upper: float | None = None
    center: float | None = None
    scale: float | None = None
    flag: Column | None = field(default=None, compare=False)
    has_nan: bool = False

    def outlier(self) -> Column:
        """Never null, and in a form whose negation the scan can take."""
        if self.flag is None:
            return F.lit(False)
        present = col(self.column).isNotNull()
        return (present & ~F.isnan(col(self.column)) if self.has_nan else present) & self.flag


def outlier_rules(df: DataFrame, spec: OutlierSpec) -> list[Rule]:
    """Learn one rule per column of ``spec``; a few numbers per column reach the driver.

    Columns that are absent, not numeric or have under ten values get no rule. NaN is
    a missing value: it takes no part in what is learnt and is never an outlier.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    numeric = [c for c in dict.fromkeys(spec.columns) if c in kinds and is_number(kinds[c])]
    if not numeric:
        return [Rule(c) for c in spec.columns]
    raw, df = df, blank_nan(df)
    seen = raw.agg(*[
        agg
        for i, c in enumerate(numeric)
        for value in [F.when(~F.isnan(col(c)), col(c))]
        for agg in (
            F.count(value).alias(f"n{i}"),
            F.avg(value).alias(f"mean{i}"),
            F.stddev_pop(value).alias(f"pop{i}"),
            F.when(F.count(value) > 1, F.stddev_samp(value)).alias(f"samp{i}"),
            (F.count(col(c)) > F.count(value)).alias(f"nan{i}"),
        )
    ]).first()
    moments = {
        c: {k: seen[f"{k}{i}"] for k in ("n", "mean", "pop", "samp")} for i, c in enumerate(numeric)
    }
    usable = [c for c in numeric if moments[c]["n"] >= MIN_VALUES]
    learn: Callable[..., dict[str, Rule]] = {
        "iqr": _iqr, "z_score": _z_score, "modified_z_score": _modified_z_score,
        "isolation_forest": _isolation_forest,
    }[spec.method]
    rules = learn(df, usable, moments, spec) if usable else {}
    nan = {c: seen[f"nan{i}"] for i, c in enumerate(numeric)}
    return [replace(rules[c], has_nan=nan[c]) if c in rules else Rule(c) for c in spec.columns]


def _iqr(df, columns, moments, spec) -> dict[str, Rule]:
    rules = {}
    for c, (q1, median, q3) in column_quantiles(df, columns, [0.25, 0.5, 0.75]).items():
        reach = spec.threshold * (q3 - q1)
        lower, upper = q1 - reach, q3 + reach
        flag = (col(c) < lower) | (col(c) > upper)
        rules[c] = Rule(c, lower, upper, median, q3 - q1, flag)
    return rules


def _z_score(df, columns, moments, spec) -> dict[str, Rule]:
    rules = {}
    for c in columns:
        mean, scale = moments[c]["mean"], moments[c]["pop"]
        rules[c] = _centred(c, mean, scale, spec.threshold, 1.0)
    return rules


def _modified_z_score(df, columns, moments, spec) -> dict[str, Rule]:
    medians = {c: q[0] for c, q in column_quantiles(df, columns, [0.5]).items()}
    gaps = df.select(*[F.abs(col(c) - F.lit(medians[c])).alias(c) for c in columns])
    mads = {c: q[0] for c, q in column_quantiles(gaps, columns, [0.5]).items()}
    return {
        c: _centred(c, medians[c], mads[c] or moments[c]["samp"], spec.threshold, MAD_SCALE)
        for c in columns
    }


def _centred(c: str, center: float, scale: float, threshold: float, weight: float) -> Rule:
    if not scale:  # a constant column has no outliers
        return Rule(c, center, center, center, scale)
    reach = threshold * scale / weight
    flag = F.abs(F.lit(weight) * (col(c) - F.lit(center)) / F.lit(scale)) > threshold
    return Rule(c, center - reach, center + reach, center, scale, flag)


def _isolation_forest(df, columns, moments, spec) -> dict[str, Rule]:
    rules = {}
    for c in columns:
        forest = grow_forest(df, c, moments[c]["n"], spec.row_key, spec.trees, spec.tree_rows)
        counts = step_counts(df, c, forest)
        cut = share_cut(forest.heights, counts, spec.threshold)
        flag = within(col(c).cast("double"), short_intervals(forest, counts, cut))
        rules[c] = Rule(c, center=cut, flag=flag)
    return rules


def outlier_flag(rules: Sequence[Rule], combine: str = "any") -> Column:
    """One boolean per row over the columns' rules; ``majority`` means more than half of them."""
    flags = [rule.outlier() for rule in rules]
    if not flags:
        return F.lit(False)
    if combine == "all":
        return reduce(and_, flags)
    if combine == "majority":
        return reduce(add, [f.cast("int") for f in flags]) > F.lit(len(flags) / 2)
    return reduce(or_, flags)


def flag_outliers(df: DataFrame, spec: OutlierSpec, rules: Sequence[Rule] | None = None) -> DataFrame:
    """``df`` with a boolean column ``is_outlier``."""
    rules = outlier_rules(df, spec) if rules is None else rules
    return df.withColumn("is_outlier", outlier_flag(rules, spec.combine))


def exclude_outliers(df: DataFrame, spec: OutlierSpec, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Rows that are no outlier; missing values never are."""
    rules = outlier_rules(df, spec) if rules is None else rules
    return df.filter(~outlier_flag(rules, spec.combine))


def exclusion_info(df: DataFrame, spec: OutlierSpec, rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row: counts before and after exclusion, and how it was done."""
    rules = outlier_rules(df, spec) if rules is None else rules
    counts = df.agg(
        F.count(F.lit(1)).alias("original_rows"),
        F.count_if(outlier_flag(rules, spec.combine)).alias("excluded_rows"),
    )
    return counts.select(
        "original_rows",
        (F.col("original_rows") - F.col("excluded_rows")).alias("filtered_rows"),
        "excluded_rows",
        ratio(F.col("excluded_rows"), F.col("original_rows"), 100.0).alias("exclusion_pct"),
        F.lit(spec.method).alias("method"),
        F.lit(spec.sensitivity).alias("sensitivity"),
        F.lit(spec.combine).alias("combination"),
        F.lit(", ".join(spec.columns)).alias("columns"),
    )


def outlier_stats(df: DataFrame, spec: OutlierSpec, rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per column: bounds, center and scale, and how many values fall outside."""
    rules = outlier_rules(df, spec) if rules is None else rules
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for i, rule in enumerate(rules):
        valid = F.lit(0).cast("bigint")
        if rule.column in df.columns:
            value = col(rule.column)
            valid = F.count(F.when(~F.isnan(value), value) if rule.has_nan else value)
        aggs += [valid.alias(f"valid{i}"), F.count_if(rule.outlier()).alias(f"outliers{i}")]
        rows.append(F.struct(
            F.lit(rule.column).alias("column"),
            F.lit(spec.method).alias("method"),
            F.lit(spec.sensitivity).alias("sensitivity"),
            F.col("n"),
            F.col(f"valid{i}").alias("valid"),
            *[F.lit(getattr(rule, k)).cast("double").alias(k) for k in ("lower", "upper", "center", "scale")],
            F.col(f"outliers{i}").alias("outliers"),
            ratio(F.col(f"outliers{i}"), F.col("n"), 100.0).alias("pct"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))
