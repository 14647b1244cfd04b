"""Snapshot-table analytics on PySpark."""

from snaplens.operators.features import add_features, available_features, features, register_feature
from snaplens.operators.filters import (
    BooleanFilter,
    CategoricalFilter,
    DateFilter,
    NumericFilter,
    TextFilter,
    apply_filters,
    clip_upper,
    filter_options,
    preview,
    select_columns,
)
from snaplens.operators.outliers import (
    OutlierSpec,
    exclude_outliers,
    exclusion_info,
    flag_outliers,
    outlier_rules,
    outlier_stats,
)
from snaplens.operators.profile import column_stats, validate
from snaplens.operators.semantics import Semantic, cast_types, detect_types, extend_types, fill_missing, type_table
from snaplens.operators.snapshots import first_snapshot, latest_per_period, latest_snapshot
from snaplens.plans.analysis import Analysis, summary
from snaplens.plans.reports import (
    bar_chart,
    box_plot,
    check_axes,
    correlation_matrix,
    descriptive_statistics,
    histogram,
    line_chart,
    scatter_plot,
    time_series,
    upper_limit_options,
)
from snaplens.roles import Roles
from snaplens.session import configure, local_session
from snaplens.sources.export import export_info, order_columns, write_csv, write_parquet
from snaplens.sources.tables import load, read_csv, read_quoted_csv, read_table

__all__ = [name for name in dir() if not name.startswith("_")]
