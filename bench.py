"""Headline queries, timed end to end into the no-op sink. Prints one JSON line."""

import json
import os
import platform
import time

from registry import QUERIES
from snaplens import local_session

HEADLINE = [
    "latest_snapshot", "latest_snapshot_by_month", "first_snapshot",
    "feat_all_entity", "feat_days_in_stage_lines", "feat_span_days", "feat_win_rate", "feat_activity",
    "filter_combined", "filter_text_contains", "filter_options",
    "profile_types", "profile_stats", "validate", "load_strings",
    "outlier_iqr", "outlier_mad", "outlier_majority", "outlier_iforest",
    "rpt_describe", "rpt_hist", "rpt_bar_sum", "rpt_bar_median", "rpt_bar_grouped", "rpt_scatter_sized",
    "rpt_line", "rpt_corr", "rpt_box", "rpt_ts_m", "rpt_ts_grouped", "analysis_run", "summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "bench")
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()  # start-up

    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")),
        "config": {"master": f"local[{cpus}]", "spark": spark.version, "machine": platform.machine()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
