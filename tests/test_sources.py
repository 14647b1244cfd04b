"""CSV in and out, typing of strings, fill, export."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from snaplens import (
    Roles,
    Semantic,
    detect_types,
    export_info,
    extend_types,
    load,
    order_columns,
    read_csv,
    read_table,
    type_table,
    validate,
    write_csv,
)
from snaplens.operators.semantics import DATE_FORMATS, parse_date


def csv(tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


HEADER = "id,snapshot date,Stage,Amount,Active,Close date,Notes\n"


def test_load_csv(spark, tmp_path):
    notes = [f'"note {i}, with ""quotes"" and ünïcode"' for i in range(60)]
    lines = [
        f"{'' if i == 3 else i % 20},{1 + i % 12}/{1 + i % 28}/2024,{'NA' if i == 5 else 'Lead'},"
        f"{'null' if i == 7 else i * 1.5},{'True' if i % 2 else 'False'},2024-02-{1 + i % 28:02d},{notes[i]}"
        for i in range(60)
    ]
    loaded = load(read_csv(spark, csv(tmp_path, HEADER + "\n".join(lines) + "\n")))
    assert loaded.types == {
        "Id": Semantic.CATEGORICAL, "Snapshot Date": Semantic.DATE, "Stage": Semantic.CATEGORICAL,
        "Amount": Semantic.NUMERICAL, "Active": Semantic.BOOLEAN, "Close date": Semantic.DATE, "Notes": Semantic.TEXT,
    }
    rows = loaded.df.collect()
    assert rows[0]["Snapshot Date"] == datetime(2024, 1, 1) and rows[0]["Close date"] == datetime(2024, 2, 1)
    assert rows[3]["Id"] is None  # an id is never filled
    assert rows[5]["Stage"] == "Unknown" and rows[7]["Amount"] is None and rows[1]["Active"] is True
    assert rows[2]["Notes"] == 'note 2, with "quotes" and ünïcode'
    stats = {r["column"]: r for r in loaded.stats.collect()}
    assert stats["Stage"]["missing"] == 1  # counted before the fill
    assert loaded.df.schema["Amount"].metadata == {"semantic": "numerical"}


def test_none_is_an_ordinary_category(spark, tmp_path):
    df = read_csv(spark, csv(tmp_path, "Id,Level\n1,None\n2,N/A\n3,High\n"))
    assert [r["Level"] for r in df.collect()] == ["None", None, "High"]


def test_line_breaks_in_cells(spark, tmp_path):
    path = csv(tmp_path, 'Id,Text\n1,"two\nlines"\n')
    assert read_csv(spark, path, multiline=True).first()["Text"] == "two\nlines"


def test_bad_inputs(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        read_csv(spark, csv(tmp_path, "Id,Stage\n"))
    with pytest.raises(ValueError, match="unsupported"):
        read_table(spark, str(tmp_path / "book.xlsx"))


def test_round_trip(spark, golden, tmp_path, roles):
    folder = str(tmp_path / "out.csv")
    write_csv(golden, folder)
    text = read_table(spark, folder)
    assert sorted(r["Owner"] for r in text.collect()) == sorted(r["Owner"] for r in golden.collect())
    info = export_info(golden).first()
    size = sum(p.stat().st_size for p in (tmp_path / "out.csv").glob("*.csv"))
    parts = len(list((tmp_path / "out.csv").glob("*.csv")))
    header = len(",".join(golden.columns)) + 1
    assert info["csv_bytes"] == size - (parts - 1) * header
    assert (info["row_count"], info["column_count"]) == (12, 9)


def test_parquet_source(spark, golden, tmp_path):
    golden.write.parquet(str(tmp_path / "t.parquet"))
    assert read_table(spark, str(tmp_path / "t.parquet")).count() == 12


@pytest.mark.parametrize("text, expected", [
    ("01/05/2024", datetime(2024, 1, 5)), ("1/5/2024", datetime(2024, 1, 5)), ("2024-01-05", datetime(2024, 1, 5)),
    ("2024-01-05 10:30:00", datetime(2024, 1, 5, 10, 30)), ("2024/1/5", datetime(2024, 1, 5)),
    ("20240105", datetime(2024, 1, 5)), ("5-Jan-2024", datetime(2024, 1, 5)), ("Jan 5, 2024", datetime(2024, 1, 5)),
    ("January 5, 2024", datetime(2024, 1, 5)), (" 1/5/2024 ", datetime(2024, 1, 5)), ("2/30/2024", None),
    ("13/45/2024", None), ("10", None), ("1.5", None), ("Q1 2023", None), ("Ann", None), ("", None),
    ("4-NOT SPECIFIED", None), ("x" * 1000, None),
])
def test_dates(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string").select(parse_date(F.col("t"), DATE_FORMATS))
    assert df.first()[0] == expected


def types_of(spark, values, kind="string", name="c"):
    return detect_types(spark.createDataFrame([(v,) for v in values], f"`{name}` {kind}"))[name]


def test_type_rules(spark):
    assert types_of(spark, [None, None]) is Semantic.TEXT
    assert types_of(spark, ["a", "b"], name="Update Count") is Semantic.DATE  # the name holds "date"
    assert types_of(spark, [1, 2], "int", "Sentiment") is Semantic.DATE  # the name holds "time"
    assert types_of(spark, [1, 2], "int", "Paid") is Semantic.CATEGORICAL
    assert types_of(spark, [True, None], "boolean") is Semantic.BOOLEAN
    assert types_of(spark, [1.0] * 19 + [2.0] * 2, "double") is Semantic.NUMERICAL  # 2 of 21 is over 5 %
    assert types_of(spark, [1.0] * 40 + [2.0] * 2, "double") is Semantic.CATEGORICAL
    assert types_of(spark, list(range(20)) * 30, "int") is Semantic.NUMERICAL  # 20 is not under 20
    assert types_of(spark, list(range(19)) * 30, "int") is Semantic.CATEGORICAL
    assert types_of(spark, ["a"] * 3 + ["b"]) is Semantic.TEXT  # exactly half distinct
    assert types_of(spark, ["a"] * 4 + ["b"]) is Semantic.CATEGORICAL
    assert types_of(spark, [str(i) for i in range(50)] * 3 + ["x"] * 200) is Semantic.TEXT  # 51 values
    assert types_of(spark, ["1/2/2024"] * 5 + ["?"]) is Semantic.DATE
    assert types_of(spark, ["1/2/2024"] * 4 + ["?"]) is Semantic.CATEGORICAL  # 80 % is not over 80 %
    assert types_of(spark, ["1", "2.5", None, "-3e2"]) is Semantic.NUMERICAL


def test_added_columns_are_typed_once(spark, golden):
    types = {c: Semantic.TEXT for c in golden.columns}  # kept as given
    more = golden.selectExpr("*", "SellPrice / 2 as half")
    assert extend_types(more, types) == {**types, "half": Semantic.NUMERICAL}
    assert [r["column"] for r in type_table(more, {"half": Semantic.NUMERICAL}).collect()] == ["half"]


def test_malformed_table(spark):
    rows = [("OPP-1", "01/01/2024", "Lead", "100"), (None, "not a date", None, "not_a_number"),
            ("", "2024-13-45", "", "-5"), ("OPP-2", None, "Closed - WON", None)]
    loaded = load(spark.createDataFrame(rows, "Id string, `Snapshot Date` string, Stage string, SellPrice string"))
    got = loaded.df.collect()
    assert [r["Snapshot Date"] for r in got] == [datetime(2024, 1, 1), None, None, None]
    assert [r["Id"] for r in got] == ["OPP-1", None, "", "OPP-2"]


def test_invalid_stages_are_reported(spark, golden, roles):
    df = golden.selectExpr(*[f"`{c}`" for c in golden.columns if c != "Stage"],
                           "case when SellPrice = 0 then 'Bogus' when SellPrice > 400000 then null else Stage end as Stage")
    found = {(r["check"], r["detail"]): r["n"] for r in validate(df, roles).collect()}
    assert found == {("unexpected_stage", "Bogus"): 1, ("duplicate_ids", "Id"): 8}
    bare = {r["check"] for r in validate(golden.select("Owner"), Roles()).collect()}
    assert bare == {"missing_id", "missing_snapshot", "missing_stage"}


def test_export_order(golden):
    out = order_columns(golden, ["Owner", "Id", "gone"], ["GM%"])
    assert out.columns[:3] == ["Owner", "Id", "GM%"] and sorted(out.columns) == sorted(golden.columns)


def test_manifest_tells_changed_and_extra_files(spark, tmp_path):
    from snaplens.sources.export import check_manifest, write_csv

    folder = tmp_path / "out"
    rows = [(i, f' "{i}", \n and more ') for i in range(50)]
    write_csv(spark.createDataFrame(rows, "n int, t string").repartition(3), str(folder), manifest=True)
    assert check_manifest(spark, str(folder)).count() == 0
    first = sorted(folder.glob("part-*.csv"))[0]
    first.write_text(first.read_text() + "99,late\n")
    (folder / "part-extra.csv").write_text("n,t\n1,x\n")
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    found = {r["problem"] for r in check_manifest(spark, str(folder)).collect()}
    assert found == {"changed", "not listed"}


def test_cells_keep_spaces_quotes_and_line_breaks(spark, tmp_path):
    from snaplens.sources.export import write_csv
    from snaplens.sources.tables import read_csv

    texts = [' "quoted", \n and more ', "a,b", 'say ""hi""', "\ttab ", "ends with backslash \\"]
    write_csv(spark.createDataFrame(list(enumerate(texts)), "n int, t string"), str(tmp_path / "o"))
    back = {int(r["n"]): r["t"] for r in read_csv(spark, str(tmp_path / "o"), multiline=True).collect()}
    assert back == dict(enumerate(texts))


@pytest.fixture
def tiny_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_csv_is_cut_where_records_end(spark, tmp_path, tiny_splits, end):
    from snaplens import read_quoted_csv

    texts = ["plain", "two\nlines", 'a ""quoted"" word,\n\n and, more ', "long " * 40 + "\n" + '""' * 3, "", " x ", "é\n" * 30, '""', "NA"]
    rows = [(str(i), texts[i % len(texts)]) for i in range(60)]
    body = end.join(["Id,Text,Last", *[f'{i},"{t}",{i}' for i, t in rows], ""])
    path = tmp_path / "in.csv"
    path.write_bytes(body.encode())
    df = read_quoted_csv(spark, str(path))
    wanted = {i: None if t in ("", "NA") else t.replace('""', '"') for i, t in rows}
    got = [(r["Id"], r["Text"], r["Last"]) for r in df.collect()]
    assert len(got) == 60 and {i: t for i, t, _ in got} == wanted and all(i == last for i, _, last in got)
    assert spark.read.text(str(path)).select(F.spark_partition_id()).distinct().count() > 5


def test_quoted_csv_of_several_files_and_bad_records(spark, tmp_path, tiny_splits):
    from snaplens import read_quoted_csv

    rows = [(i, f' "{i}", \n and more ') for i in range(50)]
    write_csv(spark.createDataFrame(rows, "n int, t string").repartition(3), str(tmp_path / "o"))
    assert {int(r["n"]): r["t"] for r in read_quoted_csv(spark, str(tmp_path / "o")).collect()} == dict(rows)
    found = read_quoted_csv(spark, csv(tmp_path, 'a,b\n1,2\n\n3\n4,"x\ny",6\n'), bad="why").collect()
    assert sorted(r["why"] or "" for r in found) == ["", "3", '4,"x\ny",6'] and {r["a"] for r in found} == {"1", "3", "4"}
    assert read_quoted_csv(spark, csv(tmp_path, "a,b\n", "none.csv")).count() == 0
    with pytest.raises(ValueError, match="other half"):
        read_quoted_csv(spark, csv(tmp_path, 'a,b\n1,5" pipe\n', "odd.csv"))


def test_exported_files_follow_the_table(spark, tmp_path, monkeypatch):
    from registry import QUERIES, files

    rows = spark.range(0, 12000, 1, 6).selectExpr(
        "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS l_orderkey", "'N' AS l_returnflag",
        "CAST(id AS DOUBLE) AS l_extendedprice", "md5(CAST(id AS STRING)) AS note")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(files, "new_path", lambda spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20KB")
    try:
        got = [tuple(r) for r in QUERIES["export_round_trip"](spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert got == [("N", 12000, 71994000.0, 0, 12000)]
    sizes = [f.stat().st_size for f in (tmp_path / "export").glob("part-*.csv")]
    assert len(sizes) > 8 and max(sizes) < sum(sizes) / 5  # an order or null ids with a third of the rows fill several
