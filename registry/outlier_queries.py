"""Outlier rules, combination, exclusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import query, table, tidy, with_nan
from snaplens import OutlierSpec, exclude_outliers, exclusion_info, flag_outliers, outlier_stats

DOC_SQL = """SELECT doc_id, n_chars, len(string_split(text, ' ')) AS n_words,
    len(string_split(text, chr(10))) AS n_lines FROM documents"""
MEASURES = ["n_chars", "n_words", "n_lines"]


def measured_documents(spark, folder):
    words = F.size(F.split("text", " ")).cast("bigint").alias("n_words")
    lines = F.size(F.split("text", "\n")).cast("bigint").alias("n_lines")
    return table(spark, folder, "documents").select("doc_id", "n_chars", words, lines)


def fence(c, m, source="d"):
    q1 = f"(SELECT quantile_cont({c}, 0.25) FROM {source})"
    q3 = f"(SELECT quantile_cont({c}, 0.75) FROM {source})"
    return f"({c} < {q1} - {m} * ({q3} - {q1}) OR {c} > {q3} + {m} * ({q3} - {q1}))"


def z_test(c, t, source="d"):
    return f"(abs({c} - (SELECT avg({c}) FROM {source})) / (SELECT stddev_pop({c}) FROM {source}) > {t})"


def mad_test(c, t, source="d"):
    middle = f"(SELECT median({c}) FROM {source})"
    return f"(abs(0.6745 * ({c} - {middle}) / (SELECT mad({c}) FROM {source})) > {t})"


def flagged_events(name, method, sensitivity, test):
    @query(name, f"WITH d AS (SELECT event_id, value FROM events) SELECT *, {test} AS is_outlier FROM d")
    def _(spark, folder):
        df = table(spark, folder, "events").select("event_id", "value")
        return flag_outliers(df, OutlierSpec(["value"], method, sensitivity))


flagged_events("outlier_iqr", "iqr", "moderate", fence("value", 2.0))
flagged_events("outlier_iqr_conservative", "iqr", "conservative", fence("value", 3.0))
flagged_events("outlier_z", "z_score", "aggressive", z_test("value", 2.5))
flagged_events("outlier_mad", "modified_z_score", "very_aggressive", mad_test("value", 2.0))


def flagged_with_nan(name, method, sensitivity, test):
    sql = "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events"

    @query(name, f"WITH d AS ({sql}) SELECT event_id, coalesce({test}, false) AS is_outlier FROM d")
    def _(spark, folder):
        df = with_nan(table(spark, folder, "events").select("event_id", "value"))
        return flag_outliers(df, OutlierSpec(["value"], method, sensitivity)).select("event_id", "is_outlier")


flagged_with_nan("outlier_iqr_with_nan", "iqr", "moderate", fence("value", 2.0))
flagged_with_nan("outlier_z_with_nan", "z_score", "aggressive", z_test("value", 2.5))
flagged_with_nan("outlier_mad_with_nan", "modified_z_score", "very_aggressive", mad_test("value", 2.0))


def combined(name, how, sql):
    @query(name, f"WITH d AS ({DOC_SQL}) SELECT * FROM d WHERE NOT ({sql})")
    def _(spark, folder):
        spec = OutlierSpec(MEASURES, "iqr", "aggressive", how)
        return exclude_outliers(measured_documents(spark, folder), spec)


FENCES = [fence(c, 1.5) for c in MEASURES]
MAJORITY = " + ".join(f"CAST({f} AS INT)" for f in FENCES) + " > 1.5"
combined("outlier_any", "any", " OR ".join(FENCES))
combined("outlier_all", "all", " AND ".join(FENCES))
combined("outlier_majority", "majority", MAJORITY)


@query(
    "outlier_exclude_unusable",
    f"WITH d AS ({DOC_SQL}) SELECT * FROM d WHERE NOT {fence('n_chars', 2.0)}",
)
def _(spark, folder):
    df = measured_documents(spark, folder)
    return exclude_outliers(df, OutlierSpec(["n_chars", "no_such_column"], "iqr", "moderate"))


def _stats_sql(c, method, lower, upper, center, scale, test):
    return f"""SELECT '{c}' AS column, '{method}' AS method, 'moderate' AS sensitivity, count(*) AS n,
    count({c}) AS valid, round({lower}, 6) AS lower, round({upper}, 6) AS upper, round({center}, 6) AS center,
    round({scale}, 6) AS scale, count(*) FILTER ({test}) AS outliers,
    round(100.0 * count(*) FILTER ({test}) / count(*), 6) AS pct FROM d"""


def _iqr_stats(c):
    q1, q3 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
    return _stats_sql(
        c, "iqr", f"{q1} - 2.0 * ({q3} - {q1})", f"{q3} + 2.0 * ({q3} - {q1})", f"quantile_cont({c}, 0.5)",
        f"{q3} - {q1}", fence(c, 2.0),
    )


def _z_stats(c):
    mean, sd = f"avg({c})", f"stddev_pop({c})"
    return _stats_sql(c, "z_score", f"{mean} - 3.0 * {sd}", f"{mean} + 3.0 * {sd}", mean, sd, z_test(c, 3.0))


def _mad_stats(c):
    reach = f"3.0 * mad({c}) / 0.6745"
    return _stats_sql(
        c, "modified_z_score", f"median({c}) - {reach}", f"median({c}) + {reach}", f"median({c})", f"mad({c})",
        mad_test(c, 3.0),
    )


for _name, _method, _sql in (
    ("outlier_stats", "iqr", _iqr_stats),
    ("outlier_stats_z", "z_score", _z_stats),
    ("outlier_stats_mad", "modified_z_score", _mad_stats),
):
    def _build(spark, folder, method=_method):
        return tidy(outlier_stats(measured_documents(spark, folder), OutlierSpec(["n_chars", "n_words"], method)))

    query(_name, f"WITH d AS ({DOC_SQL}) " + " UNION ALL ".join(_sql(c) for c in ("n_chars", "n_words")))(_build)


@query(
    "outlier_info",
    f"""WITH d AS ({DOC_SQL}), t AS (SELECT count(*) AS n, count(*) FILTER ({MAJORITY}) AS x FROM d)
    SELECT n AS original_rows, n - x AS filtered_rows, x AS excluded_rows, round(100.0 * x / n, 6) AS exclusion_pct,
    'iqr' AS method, 'aggressive' AS sensitivity, 'majority' AS combination,
    'n_chars, n_words, n_lines' AS columns FROM t""",
)
def _(spark, folder):
    spec = OutlierSpec(MEASURES, "iqr", "aggressive", "majority")
    return tidy(exclusion_info(measured_documents(spark, folder), spec))


def forest_flags(spark, folder):
    df = table(spark, folder, "events").select("event_id", "value")
    return flag_outliers(df, OutlierSpec(["value"], "isolation_forest", "moderate", row_key=["event_id"]))


query("outlier_iforest")(forest_flags)


@query(
    "outlier_iforest_check",
    """SELECT count(*) AS n, count(value) AS valid, true AS share_holds, true AS maximum_flagged,
    CAST(0 AS BIGINT) AS missing_flagged FROM events""",
)
def _(spark, folder):
    """The forest is random, so SQL states what must hold: no row lost, at most the contamination flagged, the extreme among them."""
    flagged = F.count_if("is_outlier")
    return forest_flags(spark, folder).agg(
        F.count("*").alias("n"),
        F.count("value").alias("valid"),
        ((flagged > 0) & (flagged <= 0.10 * F.count("value"))).alias("share_holds"),
        F.max_by("is_outlier", "value").alias("maximum_flagged"),
        F.count_if(F.col("is_outlier") & F.col("value").isNull()).alias("missing_flagged"),
    )
