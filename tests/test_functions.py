"""Column expressions on small inline tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from tablewright.functions import measures, parse, tagging, text


def one(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", build(F.col("v")).alias("o")).orderBy("i").collect()]


def test_strip_removes_all_white_space(spark):
    assert one(spark, [" a b ", "\t\n", " x ", None], text.strip) == ["a b", "", "x", None]
    assert one(spark, ["  ", "x ", None], text.blank_to_null) == [None, "x", None]


def test_number_words_cover_zero_to_ninety_nine(spark):
    tens, small = ["", "", *text.ROUND_TENS], list(text.SMALL_NUMBERS)
    words = [
        small[n] if n < 20 else (tens[n // 10] + ("-" + small[n % 10] if n % 10 else ""))
        for n in range(100)
    ]
    assert one(spark, words, text.number_words) == [str(n) for n in range(100)]


def test_number_words_leave_the_rest_alone(spark):
    values = ["Twenty  One", "one hundred", "twenty one two", "n/a", "12", "", None, " FORTY "]
    assert one(spark, values, text.number_words) == ["21", "one hundred", "twenty one two", "n/a", "12", "", None, "40"]


def test_canonical_labels(spark):
    values = ["f", " FEMALE ", "M", "nb", "Non-Binary", "unknown", None]
    assert one(spark, values, text.canonical) == ["Female", "Female", "Male", "Other", "Other", "unknown", None]


def test_parse_number_rejects_what_java_would_take(spark):
    values = ["1.5", " 7 ", "1e-5", "1e16", "1d", "1f", "NaN", "Infinity", "0x10", "", "-.5", None]
    expected = [1.5, 7.0, 1e-5, 1e16, None, None, None, None, None, None, -0.5, None]
    assert one(spark, values, parse.parse_number) == expected


def test_parse_messy_number(spark):
    values = ["$1,234.50 USD", "twenty one", "Thirty-Five", "N/A", "12%", "1e16", "--", "(5)", "a 1 b 2", None]
    expected = [1234.5, 21.0, 35.0, None, 12.0, 1e16, None, 5.0, 12.0, None]
    assert one(spark, values, parse.parse_messy_number) == expected


def test_parse_timestamp_formats(spark):
    day = datetime.datetime(2024, 1, 5)
    values = [
        "2024-01-05", "2024-1-5", "2024-01-05T00:00:00", "01/05/2024", "2024/01/05", "Jan 5 2024", "Jan 5, 2024",
        "January 5, 2024", "5 Jan 2024", "5 January 2024",
    ]
    assert one(spark, values, parse.parse_timestamp) == [day] * len(values)
    # Month first, day first only where the month would be impossible.
    assert one(spark, ["03/04/2024", "31/12/2024"], parse.parse_timestamp) == [
        datetime.datetime(2024, 3, 4), datetime.datetime(2024, 12, 31)
    ]
    bad = ["bad date", "2024", "2024-13-01", "2024-02-30", "2024-01-05 extra", "", "12", "99/99/2024", None]
    assert one(spark, bad, parse.parse_timestamp) == [None] * len(bad)
    assert one(spark, ["2024-01-05 10:11:12.5"], parse.parse_timestamp) == [datetime.datetime(2024, 1, 5, 10, 11, 12, 500000)]


def test_half_even_integer(spark):
    assert one(spark, [2.5, 3.5, -1.7, 1e30, None], parse.half_even_integer, "double") == [2, 4, -2, None, None]


def test_corrected_skew(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, None), (3.0, 5.0, None), (10.0, 5.0, 2.0)], "a double, b double, c double")
    row = df.agg(*[measures.corrected_skew(F.col(c)).alias(c) for c in "abc"]).first()
    assert row["a"] == pytest.approx(1.763632614803888)
    assert row["b"] == 0.0 and row["c"] == 0.0


def test_correlation_with_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, None), (4.0, 5.0, 8.0)], "a double, b double, c double")
    row = df.agg(
        measures.pairwise_corr(F.col("a"), F.col("b")).alias("ab"), measures.pairwise_corr(F.col("a"), F.col("c")).alias("ac")
    ).first()
    assert row["ab"] == 0.0
    assert row["ac"] == pytest.approx(1.0)


def test_command_intents_keep_their_order(spark):
    commands = ["download the file", "clean data", "hello", "monthly summary", "What is this", "ETL now", "export it", None]
    expected = ["ingest", "transform", "help", "query", "analyze", "pipeline", "report", "help"]
    assert one(spark, commands, tagging.command_intent) == expected


def test_statement_screening(spark):
    statements = ["DROP TABLE t", "SELECT 1; SELECT 2", "INSERT INTO t VALUES (1)", "select a from t;", "copy x from 'http://y'"]
    verdicts = one(spark, statements, lambda c: tagging.statement_verdict(c)["is_safe"])
    assert verdicts == [False, False, True, True, False]
    strict = one(spark, statements, lambda c: tagging.statement_verdict(c, strict=True)["is_safe"])
    assert strict == [False, True, False, True, True]
    assert one(spark, ["drop  table x"], lambda c: tagging.statement_verdict(c)["reason"]) == ["DROP TABLE is not allowed"]


def test_requested_limit(spark):
    questions = ["Top 7 products", "first 3", "limit 12", "the best product", "top three", "Top ten", "all", None]
    assert one(spark, questions, tagging.requested_limit) == [7, 3, 12, 1, 3, 10, 10, 10]


def test_question_pattern(spark):
    questions = ["top products", "sales by region", "trading volume", "broker", "nothing here", None]
    assert one(spark, questions, tagging.question_pattern) == [
        "top_products", "by_region", "daily_volume", "broker_comparison", None, None
    ]
    only = lambda c: tagging.question_pattern(c, ["by_sector", "top_holdings"])
    assert one(spark, ["portfolio by sector"], only) == ["by_sector"]


def test_constants_stay_constant_when_partial_results_are_merged(spark):
    df = spark.range(1000).repartition(13).select(
        F.lit(0.1).alias("a"), F.lit(7.3).alias("b"), F.col("id").cast("double").alias("c"),
        F.when(F.col("id") % 3 == 0, F.col("id")).cast("double").alias("d"),
    )
    row = df.agg(
        measures.corrected_skew(F.col("a")).alias("skew"), measures.variance(F.col("b")).alias("variance"),
        measures.pairwise_corr(F.col("a"), F.col("c")).alias("ac"), measures.pairwise_corr(F.col("b"), F.col("d")).alias("bd"),
    ).first()
    assert tuple(row) == (0.0, 0.0, 0.0, 0.0)


def test_more_date_forms(spark):
    values = ["2024-01-05T10:00:00Z", "2024-01-05T12:00:00+02:00", "25-01-2024", "05-01-2024", "01/25/24", "01/05/2024 10:30", "01/05/2024 10:30 PM",
              "2024-01-05 10:30 AM", "20240105", "5-Jan-2024", "20241305", "32-01-2024", "12345678"]
    found = [None if v is None else v.isoformat() for v in one(spark, values, parse.parse_timestamp)]
    assert found == [
        "2024-01-05T10:00:00", "2024-01-05T10:00:00", "2024-01-25T00:00:00", "2024-05-01T00:00:00", "2024-01-25T00:00:00", "2024-01-05T10:30:00",
        "2024-01-05T22:30:00", "2024-01-05T10:30:00", "2024-01-05T00:00:00", "2024-01-05T00:00:00", None, None, None,
    ]
