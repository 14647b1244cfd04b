"""Type detection, casts, fill, column statistics, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registry.base import ORDERS_ROLES, ORDERS_SQL, query, table, tidy
from snaplens import (
    Roles,
    Semantic,
    cast_types,
    column_stats,
    detect_types,
    extend_types,
    fill_missing,
    load,
    type_table,
    validate,
)

# Physical kinds of the columns, for the SQL form of the detection rules.
SHAPES = {
    "orders": dict(o_orderkey="n", o_custkey="n", o_orderstatus="s", o_totalprice="n", o_orderdate="d", o_orderpriority="s"),
    "customer": dict(c_custkey="n", c_name="s", c_nationkey="n", c_acctbal="n", c_mktsegment="s"),
    "events": dict(event_id="n", ts="d", user_id="n", event_type="s", value="n", props="s"),
    "lineitem": dict(
        l_orderkey="n", l_partkey="n", l_suppkey="n", l_linenumber="n", l_quantity="n", l_extendedprice="n",
        l_discount="n", l_tax="n", l_returnflag="s", l_linestatus="s", l_shipdate="d",
    ),
    "documents": dict(doc_id="n", text="s", lang="s", source="s", n_chars="n"),
    "part": dict(p_partkey="n", p_name="s", p_brand="s", p_type="s", p_size="n", p_retailprice="n"),
}


def type_sql(column, kind):
    """The detection rules as a CASE over one column's counts."""
    d, n = f"count(DISTINCT {column})", f"count({column})"
    rules = [f"WHEN {n} = 0 THEN 'text'"]
    if "date" in column or "time" in column:
        rules.append(f"WHEN {n} > 0 THEN 'date'")
    if column.endswith("id"):
        rules.append(f"WHEN {n} > 0 THEN 'categorical'")
    if kind == "d":
        rules.append(f"WHEN {n} > 0 THEN 'date'")
    if kind == "n":
        rules.append(f"WHEN {d} / {n} < 0.05 AND {d} < 20 THEN 'categorical' WHEN {n} > 0 THEN 'numerical'")
    if kind == "s":
        rules.append(f"WHEN count(TRY_CAST({column} AS TIMESTAMP)) / {n} > 0.8 THEN 'date'")
        rules.append(f"WHEN {d} / {n} < 0.5 AND {d} < 50 THEN 'categorical'")
    return f"CASE {' '.join(rules)} ELSE 'text' END"


def _types_sql():
    return " UNION ALL ".join(
        f"SELECT '{t}' AS source, '{c}' AS column, {i} AS position, {type_sql(c, kind)} AS type, "
        f"count({c}) AS non_null FROM {t}"
        for t, columns in SHAPES.items()
        for i, (c, kind) in enumerate(columns.items())
    )


@query("profile_types", _types_sql())
def _(spark, folder):
    tables = [
        type_table(table(spark, folder, t)).select(F.lit(t).alias("source"), "*") for t in SHAPES
    ]
    return reduce(DataFrame.unionByName, tables)


@query(
    "profile_types_text_dates",
    """SELECT 'shipped' AS column, 0 AS position, CASE WHEN count(*) FILTER (l_linenumber < 7) / count(*) > 0.8 THEN 'date'
        ELSE 'text' END AS type, count(*) AS non_null FROM lineitem
    UNION ALL SELECT 'noted', 1, CASE WHEN count(*) FILTER (l_linenumber < 6) / count(*) > 0.8 THEN 'date' ELSE 'text' END,
        count(*) FROM lineitem""",
)
def _(spark, folder):
    """Texts that are dates but for some line numbers: one column above four fifths of them, one below."""
    day = F.date_format("l_shipdate", "d-MMM-yyyy")
    other = F.concat(F.lit("line "), F.col("l_orderkey").cast("string"))
    return type_table(table(spark, folder, "lineitem").select(
        F.when(F.col("l_linenumber") < 7, day).otherwise(other).alias("shipped"),
        F.when(F.col("l_linenumber") < 6, day).otherwise(other).alias("noted")))


@query(
    "profile_types_added",
    f"""SELECT 'o_totalprice' AS column, 0 AS position, 'numerical' AS type, count(o_totalprice) AS non_null FROM orders
    UNION ALL SELECT 'price_band', 1, {type_sql("price_band", "n")}, count(price_band)
    FROM (SELECT CAST(floor(o_totalprice / 100000) AS BIGINT) AS price_band FROM orders)""",
)
def _(spark, folder):
    df = table(spark, folder, "orders").select(
        "o_totalprice", F.floor(F.col("o_totalprice") / 100000).alias("price_band")
    )
    return type_table(df, extend_types(df, {"o_totalprice": Semantic.NUMERICAL}))


STATS_BLANK = (
    "NULL::DOUBLE AS mean, NULL::DOUBLE AS median, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max, "
    "NULL::DOUBLE AS q25, NULL::DOUBLE AS q75, NULL::DOUBLE AS skew, NULL::DOUBLE AS kurt, NULL::BIGINT AS distinct, "
    "NULL::VARCHAR AS mode, NULL::BIGINT AS mode_count, NULL::VARCHAR AS rare, NULL::BIGINT AS rare_count, "
    "NULL::TIMESTAMP AS earliest, NULL::TIMESTAMP AS latest, NULL::BIGINT AS range_days, NULL::DOUBLE AS avg_length, "
    "NULL::BIGINT AS max_length, NULL::BIGINT AS min_length"
)


def stats_sql(source, columns, group=None):
    """Column statistics of ``source``: one SELECT per column, by semantic type."""
    g, by = (f'CAST({group} AS VARCHAR) AS "group", ', f"WHERE {group} IS NOT NULL GROUP BY {group}") if group else ("", "")
    blank_group = "NULL::VARCHAR AS \"group\", " if group else ""
    parts = [
        f"SELECT {blank_group}'x' AS column, 0 AS position, 'x' AS type, 0::BIGINT AS count, 0::BIGINT AS non_null, "
        f"0::BIGINT AS missing, 0::DOUBLE AS missing_pct, {STATS_BLANK} WHERE false"
    ]
    for i, (c, kind) in enumerate(columns.items()):
        head = (
            f"SELECT {g}'{c}' AS column, {i} AS position, '{kind}' AS type, count(*) AS count, count({c}) AS non_null, "
            f"count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_pct"
        )
        if kind == "numerical":
            parts.append(f"""{head}, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median,
            round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
            round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.75), 6) AS q75,
            round(skewness({c}), 6) AS skew, round(kurtosis({c}), 6) AS kurt FROM {source} {by}""")
        elif kind == "date":
            parts.append(f"""{head}, min({c}) AS earliest, max({c}) AS latest,
            CAST(floor(epoch(max({c}) - min({c})) / 86400) AS BIGINT) AS range_days FROM {source} {by}""")
        elif kind == "text":
            parts.append(f"""{head}, count(DISTINCT {c}) AS distinct, round(avg(length({c})), 6) AS avg_length,
            max(length({c})) AS max_length, min(length({c})) AS min_length FROM {source} {by}""")
        elif kind == "categorical":
            gk = f"{group} AS g" if group else "1 AS g"
            freq = (
                f"SELECT {gk}, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {source} "
                f"WHERE {c} IS NOT NULL {f'AND {group} IS NOT NULL' if group else ''} GROUP BY ALL"
            )
            gs = 'CAST(g AS VARCHAR) AS "group", ' if group else ""
            parts.append(f"""SELECT t.*, f.distinct, f.mode, f.mode_count, f.rare, f.rare_count FROM ({head} FROM {source} {by}) t
            JOIN (SELECT {gs}count(*) AS distinct, arg_min(v, (-n, v)) AS mode, max(n) AS mode_count,
                arg_min(v, (n, v)) AS rare, min(n) AS rare_count FROM ({freq}) GROUP BY g) f
            ON {'t."group" = f."group"' if group else 'true'}""")
        else:
            parts.append(f"{head} FROM {source} {by}")
    return " UNION ALL BY NAME ".join(parts)


ORDER_TYPES = {
    "o_orderkey": "numerical", "o_custkey": "numerical", "o_orderstatus": "categorical",
    "o_totalprice": "numerical", "o_orderdate": "date", "o_orderpriority": "categorical",
}
DOCUMENT_TYPES = {
    "doc_id": "categorical", "text": "text", "lang": "categorical", "source": "categorical", "n_chars": "numerical",
}


@query("profile_stats", stats_sql("orders", ORDER_TYPES))
def _(spark, folder):
    df = table(spark, folder, "orders")
    return tidy(column_stats(df, detect_types(df)), std=4)


@query("profile_stats_documents", stats_sql("documents", DOCUMENT_TYPES))
def _(spark, folder):
    df = table(spark, folder, "documents")
    return tidy(column_stats(df, detect_types(df)), std=4)


@query(
    "profile_stats_with_gaps",
    stats_sql(
        "(SELECT nullif(event_type, 'click') AS kind, CASE WHEN value > 10 THEN value END AS value, "
        "CASE WHEN event_type <> 'view' THEN ts END AS ts, value > 50 AS large FROM events)",
        {"kind": "categorical", "value": "numerical", "ts": "date", "large": "boolean"},
    ),
)
def _(spark, folder):
    df = table(spark, folder, "events").select(
        F.nullif("event_type", F.lit("click")).alias("kind"),
        F.when(F.col("value") > 10, F.col("value")).alias("value"),
        F.when(F.col("event_type") != "view", F.col("ts")).alias("ts"),
        (F.col("value") > 50).alias("large"),
    )
    return tidy(column_stats(df, detect_types(df)), std=4)


@query(
    "validate",
    f"""WITH b AS ({ORDERS_SQL})
    SELECT 'suggestion' AS severity, 'unexpected_stage' AS "check", o_orderstatus AS detail, count(*) AS n
    FROM b WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY ALL
    UNION ALL SELECT 'suggestion', 'duplicate_ids', 'o_custkey', count(o_custkey) - count(DISTINCT o_custkey) FROM b""",
)
def _(spark, folder):
    return validate(table(spark, folder, "orders"), ORDERS_ROLES)  # the owner is not looked at


@query(
    "validate_missing",
    """SELECT 'warning' AS severity, 'missing_id' AS "check", 'Id' AS detail, 0::BIGINT AS n
    UNION ALL SELECT 'warning', 'missing_snapshot', 'Snapshot Date', 0
    UNION ALL SELECT 'suggestion', 'unexpected_stage', l_returnflag, count(*) FROM lineitem GROUP BY ALL""",
)
def _(spark, folder):
    df = table(spark, folder, "lineitem").withColumnRenamed("l_returnflag", "line_stage")
    return validate(df, Roles())


GAPS = {
    "doc_id": Semantic.CATEGORICAL, "quality": Semantic.CATEGORICAL, "text": Semantic.TEXT, "remark": Semantic.TEXT,
    "toxic": Semantic.NUMERICAL,
}


@query(
    "fill_missing",
    """SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, coalesce(CAST(quality AS VARCHAR), 'Unknown') AS quality,
    md5(coalesce(text, '')) AS text, CASE WHEN quality IS NULL THEN '' ELSE text END = '' AS no_remark, toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(spark, folder):
    """Labels cover some documents; the others miss their quality, a number and a remark."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"), "toxic")
    df = table(spark, folder, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("doc_id"), "quality", "text",
        F.when(F.col("quality").isNotNull(), F.col("text")).alias("remark"), "toxic")
    filled = fill_missing(df, GAPS, Roles(id="doc_id"))
    return filled.select("doc_id", "quality", F.md5("text").alias("text"), (F.col("remark") == "").alias("no_remark"), "toxic")


@query(
    "cast_types",
    """SELECT CASE WHEN n_chars % 7 <> 0 THEN n_chars::DOUBLE END AS amount, doc_id % 2 = 0 AS even,
    TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 300 AS INT)) AS "Snapshot Date",
    CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 300 AS INT)) END AS created_date,
    CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text FROM documents""",
)
def _(spark, folder):
    """Strings of every kind, some of them unparseable, cast back to their types."""
    doc = F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (doc % 300).cast("int"))
    df = table(spark, folder, "documents").select(
        F.when(F.col("n_chars") % 7 != 0, F.col("n_chars").cast("string")).otherwise("not_a_number").alias("amount"),
        F.when(doc % 2 == 0, "True").otherwise("false").alias("even"),
        F.date_format(day, "M/dd/yyyy").alias("Snapshot Date"),
        F.when(doc % 3 == 0, day.cast("string")).otherwise("someday").alias("created_date"),
        "doc_id", "text",
    )
    types = {
        "amount": Semantic.NUMERICAL, "even": Semantic.BOOLEAN, "Snapshot Date": Semantic.DATE,
        "created_date": Semantic.DATE, "doc_id": Semantic.CATEGORICAL, "text": Semantic.TEXT,
    }
    return cast_types(df, types).withColumn("text", F.md5("text"))


@query(
    "load_strings",
    """SELECT o_orderkey::DOUBLE AS o_orderkey, CAST(o_custkey AS VARCHAR) AS "Id", o_orderstatus AS "Stage",
    o_totalprice, o_orderdate AS "Snapshot Date", coalesce(nullif(o_orderpriority, '5-LOW'), 'Unknown') AS o_orderpriority
    FROM orders""",
)
def _(spark, folder):
    """Orders as a CSV reader would deliver them: strings, loosely spelled names, gaps."""
    raw = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string"),
        F.col("o_custkey").cast("string").alias("ID"),
        F.col("o_orderstatus").alias("Stage"),
        F.col("o_totalprice").cast("string"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("snapshot date"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
    )
    return load(raw).df
