"""Files, tables, workbooks and incremental ingest."""

import json

import pytest
from pyspark.sql import types as T

from tablewright.catalogue.source_queries import workbook_bytes
from tablewright.durable import scratch_path
from tablewright.plans import flow
from tablewright.sources import files, naming, tables, workbooks
from tablewright.streaming import landing


def write(path, text):
    path.write_text(text)
    return str(path)


def test_ragged_csv_drops_long_rows_and_pads_short_ones(spark, tmp_path):
    path = write(tmp_path / "r.csv", 'a,b,c\n1,2,3\n4,5\n6,7,8,9\n6,7,8,9,10\n"x, y",2,3\n')
    out = files.read_csv_robust(spark, path, "a string, b int, c int")
    assert sorted(map(tuple, out.collect())) == [("1", 2, 3), ("4", 5, None), ("x, y", 2, 3)]
    assert out.select("b").count() == 3 and out.count() == 3
    assert files.read_csv_robust(spark, path).columns == ["a", "b", "c"]


def test_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'a,b\n"one\ntwo",2\n')
    assert files.read_csv_robust(spark, path, "a string, b int", multi_line=True).collect()[0]["a"] == "one\ntwo"


def test_json_array_and_lines(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    array = write(tmp_path / "a.json", json.dumps(rows))
    lines = write(tmp_path / "l.jsonl", "\n".join(json.dumps(r) for r in rows))
    assert files.read_json_records(spark, array).count() == 2
    assert files.read_table_file(spark, lines).count() == 2
    assert files.read_table_file(spark, array).columns == ["a", "b"]
    with pytest.raises(ValueError):
        files.read_table_file(spark, "x.avro")


def test_csv_round_trip_keeps_nulls_quotes_and_spaces(spark, tmp_path):
    rows = [(" ", None), (" a ", "x,y"), (None, 'say "hi"'), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    files.export_csv(df, str(tmp_path / "out"))
    back = files.read_csv_robust(spark, str(tmp_path / "out"), df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_empty_strings_are_written_quoted_and_read_as_null(spark, tmp_path):
    df = spark.createDataFrame([("", "x")], "a string, b string").coalesce(1)
    files.export_csv(df, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()][1:] == ['"",x']
    assert files.read_csv_robust(spark, str(tmp_path / "out"), df.schema).first()["a"] is None


def test_names():
    assert naming.table_name("2024 Sales-Q1.csv") == "_sales_q1"
    assert naming.table_name("123.csv") == "data_table"
    assert naming.stage_names("/x/My File_clean.csv") == ("my_file_raw", "my_file_clean")
    assert naming.column_names([" A-b ", "a b", "$", None, "x__y_"]) == ["a_b", "a_b_2", "unnamed_column", "unnamed_column_2", "x_y"]
    assert naming.is_identifier("a_1") and not naming.is_identifier("1a") and not naming.is_identifier("a" * 129)
    assert not naming.is_identifier("a\n")


def test_preview_bounds(spark):
    df = spark.range(3000).toDF("k")
    assert [r["k"] for r in tables.preview(df, 2, ["k"]).collect()] == [0, 1]
    for n in (0, 1001):
        with pytest.raises(ValueError):
            tables.preview(df, n, ["k"])
    assert tables.page(df, ["k"], 2000).count() == 2000
    assert tables.page(df, ["k"]).count() == 100
    for n in (0, 10_001):
        with pytest.raises(ValueError):
            tables.page(df, ["k"], n)


def test_table_names_are_checked(spark):
    with pytest.raises(ValueError):
        tables.replace_table(spark.range(1), "x; DROP TABLE y")


def test_workbooks(spark, tmp_path):
    first = workbook_bytes({"One": [["A b", "N"], ["x & y", 1], [None, 2.5]], "Two": [["A b"], ["z"]]})
    (tmp_path / "f.xlsx").write_bytes(first)
    (tmp_path / "ignored.txt").write_text("no")
    rows = workbooks.read_workbooks(spark, str(tmp_path))
    header = workbooks.sheet_header(rows)
    assert header == ["A b", "N"]
    table = workbooks.sheet_table(rows, header)
    assert [(r["a_b"], r["n"]) for r in table.orderBy("n").collect()] == [("x & y", "1"), (None, "2.5")]
    assert workbooks.sheet_table(rows, header, ["N", "zzz"]).columns == ["workbook", "sheet", "n"]
    every = workbooks.read_workbooks(spark, str(tmp_path), sheet="*")
    assert {r["sheet"] for r in every.collect()} == {"One", "Two"}
    assert workbooks.read_workbooks(spark, str(tmp_path), sheet="Two", skip_rows=1).collect()[0]["cells"] == ["z"]


def test_wide_columns():
    assert [workbooks._column_index(r) for r in ("A1", "Z9", "AA1", "AB7")] == [0, 25, 26, 27]


def test_stream_takes_new_files_once(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = T.StructType([T.StructField("id", T.LongType())])
    spark.range(5).write.parquet(source)
    assert landing.ingest_stream(spark, source, target, state, schema).count() == 5
    spark.range(5, 8).write.mode("append").parquet(source)
    assert landing.ingest_stream(spark, source, target, state, schema).count() == 8
    assert landing.ingest_stream(spark, source, target, state, schema, files_per_batch=1).count() == 8


def test_flow_from_a_csv_file(spark, tmp_path):
    path = write(
        tmp_path / "orders.csv",
        "order_id,category,amount\n1, a ,10\n2,b,\n2,b,\n3,a,$30\n4,,5\n5,a,5,surplus\n",
    )
    done = flow.run_flow(spark, path, scratch_path(spark, "flow-test"))
    assert done.clean.count() == 4
    report = {r["category"]: (r["record_count"], r["total_amount"]) for r in done.report.collect()}
    assert report == {"a": (3, 45.0), "b": (1, 10.0)}  # the fill is the median: 5, 10 and 30 are skewed
    assert [(r["name"], r["row_count"]) for r in done.steps.collect()] == [("ingest", 5), ("clean", 4), ("report", 2)]


def test_rejected_lines(spark, tmp_path):
    from pyspark.sql import Observation

    lines = ["a,b", "1,x", "2", "3,y,", '4,"p, q"', '5,"p, q",z', "bad,w", "6,a,b,c", '7,"say ""x, y"""']
    (tmp_path / "r.csv").write_text("\n".join(lines))
    counted = Observation()
    kept, rejected = files.read_csv_with_rejects(spark, str(tmp_path), "a int, b string", counted=counted)
    rows = sorted((tuple(r) for r in kept.collect()), key=str)
    assert rows == sorted([(1, "x"), (2, None), (4, "p, q"), (None, "w"), (7, 'say "x, y"')], key=str)
    assert counted.get == {"kept": 5, "rejected": 3}
    assert sorted(r["line"] for r in rejected.collect()) == ["3,y,", '5,"p, q",z', "6,a,b,c"] and rejected.count() == 3


def test_folder_of_workbooks_with_headers_of_their_own(spark, tmp_path):
    import datetime

    day = datetime.date(2024, 2, 29)
    (tmp_path / "a.xlsx").write_bytes(workbook_bytes({"S": [["Id", "When", "Note"], [1, day, "x"], [9007199254740993, None, "7"]]}))
    (tmp_path / "b.xlsx").write_bytes(workbook_bytes({"S": [["Note", "Id"], ["y", 2, "surplus"]]}))
    (tmp_path / "c.xlsx").write_bytes(workbook_bytes({"S": []}))
    found = workbooks.folder_table(workbooks.read_workbooks(spark, str(tmp_path))).drop("workbook", "sheet")
    assert {f.name: f.dataType.simpleString() for f in found.schema.fields} == {"id": "bigint", "note": "string", "when": "timestamp_ntz", "unnamed_column": "string"}
    rows = [(r.id, r.when, r.note, r.unnamed_column) for r in found.orderBy("id").collect()]
    assert rows == [(1, datetime.datetime(2024, 2, 29), "x", None), (2, None, "y", "surplus"), (9007199254740993, None, "7", None)]


def test_a_failed_replace_leaves_the_old_table(spark, tmp_path):
    from pyspark.sql import functions as F

    tables.replace_table(spark.range(3), "kept_table", str(tmp_path))
    try:
        broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
        with pytest.raises(Exception, match="no"):
            tables.replace_table(broken, "kept_table", str(tmp_path))
        assert spark.table("kept_table").count() == 3
        tables.replace_table(spark.table("kept_table").where("id > 0"), "kept_table", str(tmp_path))
        assert sorted(r.id for r in spark.table("kept_table").collect()) == [1, 2]
    finally:
        spark.sql("DROP TABLE IF EXISTS kept_table")


def test_describe_with_samples(spark):
    df = spark.createDataFrame([(2, None), (1, "b"), (3, "c")], "k int, v string")
    found = {r.column_name: r.sample_values for r in tables.describe_with_samples(df, ["k"], 2).collect()}
    assert found == {"k": ["1", "2"], "v": ["b", None]}
    assert [r.sample_values for r in tables.describe_with_samples(df.limit(0), ["k"]).collect()] == [[], []]
