"""Cleaning, fills and numbering against small brute-force results."""

import datetime
import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import clean as c, ordering


def column(df, name, order="k"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_plan_from_meaning():
    columns = [
        {"column_name": "n", "type": "int64", "semantic": "id"}, {"column_name": "p", "type": "object", "semantic": "money"},
        {"column_name": "d", "type": "object", "semantic": "datetime"}, {"column_name": "e", "type": "object", "semantic": "email"},
        {"column_name": "t", "type": "object", "semantic": "name"},
    ]
    assert c.heuristic_plan(columns) == {
        "n": ["normalize_empty_to_null", "parse_numeric", "drop_row_if_null"],
        "p": ["normalize_empty_to_null", "parse_numeric"],
        "d": ["trim", "normalize_empty_to_null", "parse_date"],
        "e": ["trim", "normalize_empty_to_null", "lowercase"],
        "t": ["trim", "normalize_empty_to_null", "drop_row_if_null"],
    }
    given = {"n": ["trim", "trim", "explode"], "zzz": ["trim"], "t": ["explode"]}
    assert c.validated_plan(given, ["n", "t"]) == {"n": ["trim"]}


def test_numbers_are_not_reparsed(spark):
    df = spark.createDataFrame([(1, 1e16), (2, 1e-5)], "k int, price double")
    out = c.apply_plan(df, {"price": ["normalize_empty_to_null", "parse_numeric"]})
    assert column(out, "price") == [1e16, 1e-5]


def test_numeric_fill_by_skew(spark):
    df = spark.createDataFrame(
        [(i, float(i) if i < 9 else None, (1.0 if i < 8 else 1000.0) if i < 9 else None) for i in range(10)],
        "k int, even double, tail double",
    )
    out = c.impute(df)
    assert column(out, "even")[-1] == 4.0
    assert column(out, "tail")[-1] == 1.0


def test_two_values_have_no_skew(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 100.0), (3, None)], "k int, v double")
    assert column(c.impute(df), "v")[-1] == 50.5


def test_intent_below_threshold_uses_the_median(spark):
    values = ["x", "y", "z", "w", "v", "7", None]
    df = spark.createDataFrame(list(enumerate(values)), "k int, age string")
    assert column(c.impute(df), "age") == [7.0] * 7


def test_intent_without_any_number_is_left_null(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "k int, price string")
    _, choices = c.fill_choices(df, {})
    assert [x.strategy for x in choices] == ["numeric_intent_skip_no_valid_values"]
    assert column(c.apply_choices(df, choices), "price") == [None, None]


def test_text_is_filled_with_its_mode(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", None), (3, None, None)], "k int, word string, nothing string")
    out = c.impute(df)
    assert column(out, "word") == ["b", "a", "a"]
    assert column(out, "nothing") == ["Unknown"] * 3


def test_coercion_only_where_nulls_remain(spark):
    df = spark.createDataFrame([(1, "5", "5"), (2, "6", None)], "k int, full string, partial string")
    out = c.impute(df)
    assert column(out, "full") == ["5", "6"]
    assert column(out, "partial") == [5.0, 5.0]


def test_boolean_fill_keeps_its_type(spark):
    df = spark.createDataFrame([(1, True), (2, True), (3, False), (4, None)], "k int, flag boolean")
    assert column(c.impute(df), "flag") == [True, True, False, True]


def test_mostly_missing_and_unimportant_is_skipped(spark):
    df = spark.createDataFrame([(i, "x" if i == 0 else None) for i in range(10)], "k int, memo string")
    _, choices = c.fill_choices(df, {}, {"memo": 0.1, "k": 5.0})
    assert choices[0].strategy == "skipped_low_priority_high_missing"
    _, choices = c.fill_choices(df, {}, {"memo": 9.0, "k": 5.0})
    assert choices[0].strategy == "mode"


def test_date_fill_needs_an_order(spark):
    df = spark.createDataFrame([(1, None), (2, datetime.datetime(2024, 1, 2))], "k int, at timestamp_ntz")
    with pytest.raises(ValueError, match="order_by"):
        c.impute(df)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_ordered_fill_equals_pandas(spark, partitions):
    rng = random.Random(partitions)
    n = 400
    rows = [
        (k, "hot" if rng.random() < 0.4 else f"g{rng.randrange(20)}", rng.randrange(1000) if rng.random() < 0.2 and k > 30 else None)
        for k in range(n)
    ]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, g string, v int").repartition(partitions)
    pdf = pd.DataFrame(sorted(rows), columns=["k", "g", "v"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep several range partitions
    try:
        whole = ordering.forward_backward_fill(df, ["v"], ["k"]).orderBy("k").toPandas()
        grouped = ordering.forward_backward_fill(df, ["v"], ["k"], ["g"]).orderBy("k").toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert whole["v"].tolist() == pdf["v"].ffill().bfill().tolist()
    expected = pdf.groupby("g")["v"].transform(lambda s: s.ffill().bfill())
    assert grouped["v"].fillna(-1).tolist() == expected.fillna(-1).tolist()


def test_ordered_fill_with_tied_keys(spark):
    rows = [(1, None), (2, 5), (2, None), (2, 9), (3, None), (None, None), (None, 4)]
    df = spark.createDataFrame(rows, "k int, v int")
    out = sorted(ordering.forward_backward_fill(df, ["v"], ["k"]).collect(), key=lambda r: (r["k"] is None, r["k"], r["v"]))
    assert [tuple(r) for r in out] == [(1, 9), (2, 5), (2, 9), (2, 9), (3, 9), (None, 4), (None, 4)]


def test_numbering_is_consecutive(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), "id").repartition(9)
    out = ordering.number_rows(df, ["g"]).orderBy("_record_id").collect()
    assert [r["_record_id"] for r in out] == list(range(1, 1001))
    assert [(r["g"], r["id"]) for r in out] == sorted((r["g"], r["id"]) for r in out)


def test_basic_clean(spark):
    rows = [(1, " a "), (1, " a "), (2, "nan"), (None, None)]
    out = c.basic_clean(spark.createDataFrame(rows, "k int, t string"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a"), (2, None)]


def dirty(spark):
    rows = [
        (1, " f ", "twenty one", "$1,200.50", "2024-01-01", "x@Y.z "), (2, "Male", "40", "300", None, None),
        (3, "NB", None, "N/A", "01/03/2024", "a@b.c"), (3, "NB", None, "N/A", "01/03/2024", "a@b.c"),
        (4, None, "n/a", None, "bad", "a@b.c"),
    ]
    return spark.createDataFrame(rows, "order_id int, gender_type string, age string, price string, order_date string, email string")


def test_the_whole_run(spark):
    done = c.clean(dirty(spark), order_by=["order_id"])
    out = done.data.orderBy("order_id").collect()
    assert [r["order_id"] for r in out] == [1, 2, 3, 4]
    assert [r["gender_type"] for r in out] == ["Female", "Male", "Other", "Other"]
    assert [r["age"] for r in out] == [21.0, 40.0, 30.5, 30.5]
    assert [r["price"] for r in out] == [1200.5, 300.0, 750.25, 750.25]
    days = [r["order_date"].date().isoformat() for r in out]
    assert days == ["2024-01-01", "2024-01-01", "2024-01-03", "2024-01-03"]
    assert [r["email"] for r in out] == ["x@y.z", "a@b.c", "a@b.c", "a@b.c"]
    log = done.log.collect()
    assert log[-1]["strategy"] == "deduplicate" and log[-1]["rows_removed"] == 1
    price = [r for r in log if r["column_name"] == "price"]
    assert [(r["operation"], r["missing_before"], r["missing_after"]) for r in price] == [
        ("preclean", 1, 3), ("missing_value_imputation", 3, 0)
    ]


def test_cleaning_twice_changes_nothing(spark):
    once = c.clean(dirty(spark), order_by=["order_id"]).data
    twice = c.clean(once, order_by=["order_id"]).data
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_lazy_parts_agree_with_the_written_stage(spark):
    a = c.clean(dirty(spark), order_by=["order_id"], materialise=False).data
    b = c.clean(dirty(spark), order_by=["order_id"]).data
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_a_plan_may_keep_copies(spark):
    done = c.clean(dirty(spark), plan={"price": ["parse_numeric"]}, order_by=["order_id"], drop_duplicates=False)
    assert done.data.count() == 5 and done.plan == {"price": ["parse_numeric"]}


def test_whole_numbers_and_amounts_stay_exact(spark):
    ids = [9007199254740992, 9007199254740993, None, 9007199254740992]
    df = spark.createDataFrame([(i, None if i is None else Decimal(i) / 4) for i in ids], "k long, amount decimal(25, 2)")
    out = c.impute(df)
    assert out.schema.simpleString() == "struct<k:bigint,amount:decimal(25,2)>"
    assert {r["k"] for r in out.collect()} >= set(ids) - {None}
    assert {r["amount"] for r in out.collect()} >= {Decimal("2251799813685248.00"), Decimal("2251799813685248.25")}


def test_empty_and_incomplete_rows_are_not_filled(spark):
    rows = [(1, 2.0, "a"), (2, None, "b"), (None, 5.0, "c"), (None, None, None), (3, 4.0, None)]
    done = c.clean(spark.createDataFrame(rows, "order_id long, amount double, note string"))
    assert sorted(r["order_id"] for r in done.data.collect()) == [1, 2, 3]
    removed = {r["strategy"]: r["rows_removed"] for r in done.log.collect() if r["rows_removed"]}
    assert removed == {"all_columns_null": 1, "required_columns_null": 1}


def test_dates_without_order_fail_before_the_work(spark):
    df = spark.createDataFrame([(1, None), (2, datetime.datetime(2024, 1, 1))], "k long, day timestamp_ntz")
    with pytest.raises(ValueError, match="order_by"):
        c.clean(df)


def test_digit_text_keeps_every_digit(spark):
    """Texts beyond what doubles tell apart: whole numbers, decimals, and what no type holds."""
    whole = ["9007199254740992", "9007199254740993", "9007199254740994", None]
    long = ["123456789012345678901", "123456789012345678902", "123456789012345678903", None]
    part = ["12345678901234567.01", "12345678901234567.02", "12345678901234567.03", None]
    huge = ["1e300", "9007199254740993", "9007199254740992", None]
    few = ["1.5", "2.5", "4", None]
    rows = list(zip(range(4), whole, long, part, huge, few))
    df = spark.createDataFrame(rows, "k int, whole string, long string, part string, huge string, few string")
    done = c.impute(df)
    assert [f.dataType.simpleString() for f in done.schema.fields] == ["int", "bigint", "decimal(21,0)", "decimal(19,2)", "string", "double"]
    assert [str(x) for x in column(done, "whole")[:3]] == whole[:3] and [str(x) for x in column(done, "long")[:3]] == long[:3]
    assert [str(x) for x in column(done, "part")[:3]] == part[:3] and column(done, "huge")[:3] == huge[:3]
    assert all(x is not None for name in df.columns for x in column(done, name))


def test_cleaning_digit_text_loses_no_row(spark):
    """Numbers one apart above 2^53 in a column that the plan parses, and in one that it does not."""
    rows = [(f"{9007199254740992 + i}", f"${9007199254740992 + i}", "x") for i in range(40)] + [(None, None, "y")]
    df = spark.createDataFrame(rows, "reference string, amount string, note string")
    done = c.clean(df).data
    assert done.count() == 41 and done.where("reference is not null").select("reference").distinct().count() >= 40
    assert done.schema["amount"].dataType.simpleString() == "bigint"
    assert {r[0] for r in done.select("amount").collect()} >= {9007199254740992 + i for i in range(40)}


def test_digit_facts(spark):
    from tablewright.functions import parse

    texts = ["007", "-1.500", "+.25", "0", "12e3", "bad", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(parse.number_text(F.col("t")).alias("d"))
    row = df.agg(*[v.alias(k) for k, v in parse.digit_facts(F.col("d")).items()]).first().asDict()
    assert row == {"whole": 2, "scale": 2, "digits": 2, "exponents": 1}
    assert parse.exact_type({"whole": 20, "scale": 19, "digits": 39, "exponents": 0}) is None
    assert parse.exact_type({"whole": None, "scale": None, "digits": None, "exponents": 0}) == "double"
