"""Every registered query against its SQL on the supplied tables."""

import glob
import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = contract.queries(), contract.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def cell(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(value + 0.0)
        return repr(value)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def test_only_the_forest_lacks_sql():
    own = {name for name in QUERIES if name != "pipeline" and not re.match(r"op\d+_", name)}
    assert own - set(SQL) == {"outlier_iforest"} and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.filterwarnings("ignore:feature 'no_such_feature'")
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), columns)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["c_mktsegment", "value"] and df.count() == 5
