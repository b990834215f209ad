"""Profiles, roles and meaning."""

import datetime

import pytest
from pyspark.sql import functions as F

from tablewright.operators import frequency, profile as p, quantiles


def by_column(df):
    return {r["column_name"]: r.asDict() for r in df.collect()}


def test_profile_counts_nulls_nan_and_all_null_columns(spark):
    df = spark.createDataFrame(
        [(1, "a", float("nan"), None, "2024-01-01"), (2, "a", 1.0, None, "2024-01-02"), (3, None, -0.0, None, None), (4, "b", 0.0, None, "01/02/2024")],
        "id_no int, kind string, x double, empty string, start_date string",
    )
    found = by_column(p.with_role(p.with_semantic(p.column_profile(df))))
    assert found["kind"]["unique_count"] == 2 and found["kind"]["null_count"] == 1 and found["kind"]["null_pct"] == 25.0
    assert found["kind"]["sample_values"] == ["a", "b"]
    assert found["x"]["null_count"] == 1 and found["x"]["unique_count"] == 2  # NaN is missing, -0.0 is 0.0
    assert found["empty"]["type"] == "unknown" and found["empty"]["semantic"] == "unknown"
    assert found["empty"]["null_count"] == 4 and found["empty"]["nullable"]
    assert found["start_date"]["type"] == "datetime" and found["start_date"]["role"] == "date"
    assert found["id_no"]["role"] == "id" and found["id_no"]["sample_values"] == ["1", "2", "3"]


def test_profile_of_an_empty_table(spark):
    found = by_column(p.with_semantic(p.column_profile(spark.createDataFrame([], "a string, b double"))))
    assert found["a"]["type"] == "unknown" and found["a"]["row_count"] == 0 and found["a"]["null_pct"] == 0.0


def test_long_values_are_counted_exactly(spark):
    base = "x" * 5000
    df = spark.createDataFrame([(base + s,) for s in "aabbc"] + [("short",)], "t string")
    assert by_column(p.column_profile(df))["t"]["unique_count"] == 4


def test_names_that_collide_keep_the_first_rule(spark):
    df = spark.createDataFrame(
        [("country",), ("dividend_yield",), ("customer_name",), ("exam",), ("headline",), ("zzz",), ("Sales",)], "n string"
    )
    found = {r["n"]: r["s"] for r in df.select("n", p.name_semantic(F.col("n")).alias("s")).collect()}
    assert found == {
        "country": "count", "dividend_yield": "id", "customer_name": "person", "exam": "score", "headline": "text",
        "zzz": "generic", "Sales": "generic",
    }
    whole = {r["n"]: r["s"] for r in df.select("n", p.name_semantic(F.col("n"), tokens=True).alias("s")).collect()}
    assert whole["country"] == "location" and whole["dividend_yield"] == "generic"




def test_cardinality_rules(spark):
    rows = [
        (0, "sector", "object", "object", False, 100, 100, 0, 0.0, 14, []),
        (1, "code", "object", "object", False, 100, 100, 0, 0.0, 95, []),
        (2, "word", "object", "object", False, 100, 100, 0, 0.0, 50, []),
        (3, "few", "object", "object", False, 50, 50, 0, 0.0, 50, []),
        (4, "weight", "float64", "float64", False, 100, 100, 0, 0.0, 50, []),
    ]
    profile = spark.createDataFrame(
        rows,
        "position int, column_name string, dtype string, type string, nullable boolean, row_count long, total_count long, "
        "null_count long, null_pct double, unique_count long, sample_values array<string>",
    )
    found = {k: v["semantic"] for k, v in by_column(p.with_semantic(profile)).items()}
    assert found == {"sector": "category", "code": "id", "word": "generic", "few": "generic", "weight": "count"}


def test_dataset_type_ties_go_to_the_first_and_no_hit_is_generic(spark):
    def kind(names):
        rows = spark.createDataFrame([(n,) for n in names], "column_name string")
        return tuple(p.dataset_type(rows).first())

    assert kind(["ticker", "price", "volume"]) == ("finance", 5)
    assert kind(["Amount"]) == ("sales", 4)  # counted with both weights
    assert kind(["grade", "patient"]) == ("education", 3)
    assert kind(["foo"]) == ("generic", 0)


def test_suggestions_and_description():
    roles = {"numeric": ["price"], "categorical": ["city"], "date": ["day"], "text": [], "id": ["order_id"]}
    assert p.suggested_queries(roles, "sales") == [
        "Show top 10 by price", "Total price by city", "Average price", "Distribution of city",
        "price trend over time", "Bottom 5 city by price",
    ]
    assert p.suggested_queries({}, "sales") == ["Show all records", "Count total records"]
    names = ["order_id", "price", "city", "day", "a", "b"]
    assert p.describe_dataset(roles, names, "sales", 1234) == (
        "Sales dataset with 1,234 rows and 6 columns (1 numeric, 1 categorical, 1 date/time). "
        "Key columns: ‘order_id’, ‘price’, ‘city’, ‘day’, ‘a’, ‘and 1 more’."
    )


def test_importance_formula(spark):
    df = spark.createDataFrame(
        [(i, float(i * i), f"c{i % 6}", "k", datetime.date(2024, 1, 1)) for i in range(100)],
        "n int, sq double, city string, one string, day date",
    )
    found = {r["feature"]: r for r in p.feature_importance(df).collect()}
    assert "day" not in found
    assert found["city"]["importance_score"] == pytest.approx(0.136)  # u = 0.06
    assert found["n"]["variance"] == pytest.approx(841.666667)
    r = found["n"]["mean_abs_correlation"]
    assert found["n"]["importance_score"] == pytest.approx(0.7 * 841.666667 + 0.3 * r, abs=1e-5)
    assert list(found) == ["sq", "n", "city", "one"]
    given = {"city": 0.73, "one": 0.01}
    shared = {r["feature"]: r for r in p.feature_importance(df, ratios=given).collect()}
    assert shared["city"]["importance_score"] == pytest.approx(0.446)


def test_recorded_importance_score():
    assert round(0.7 * 841.666667 + 0.3 * 0.029977, 5) == 589.17566


def test_quality(spark):
    df = spark.createDataFrame([(i, None if i < 3 else "x", None if i < 1 else i) for i in range(12)], "k int, a string, b int")
    profile = p.with_semantic(p.column_profile(df))
    quality = {r["column_name"]: r for r in p.quality_report(profile).collect()}
    assert quality["k"]["quality"] == "good" and quality["k"]["all_unique"]
    assert quality["a"]["quality"] == "poor" and quality["b"]["quality"] == "moderate"
    score = p.quality_score(profile).first()
    assert score["total_issues"] == 2 and score["overall_score"] == round(1 - 4 / 36 - 0.1, 2)
    nulls = p.null_summary(profile).first()
    assert tuple(nulls) == (4, 2, 11.1)


@pytest.mark.parametrize("small", [1, 7, 10_000])
def test_medians_are_exact_for_any_interval_bound(spark, small):
    import random
    import statistics

    rng = random.Random(5)
    hot = [3.0] * 400 + [rng.uniform(0, 10) for _ in range(801)]
    even = [float(i) for i in range(1000)] + [None] * 201
    tail = [rng.lognormvariate(0, 3) for _ in range(1201)]
    df = spark.createDataFrame(list(zip(hot, even, tail)), "hot double, even double, tail double").repartition(5)
    found = quantiles.medians(df, {c: F.col(c) for c in df.columns}, small=small)
    assert found["hot"] == statistics.median(hot)
    assert found["even"] == 499.5
    assert found["tail"] == statistics.median(tail)


def test_median_of_constants_and_of_nothing(spark):
    df = spark.createDataFrame([(2.0, None)] * 50, "a double, b double")
    assert quantiles.medians(df, {"a": F.col("a"), "b": F.col("b")}, small=1) == {"a": 2.0, "b": None}


def test_modes_take_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,), (None,), (None,)], "v string")
    assert tuple(frequency.modes(df).first()) == ("v", "a", 2)


def test_correlations_do_not_depend_on_the_number_of_columns(spark):
    import random

    rng = random.Random(3)

    def row(i):
        a = rng.gauss(1e9, 5.0)
        values = [a, -2 * a + rng.gauss(0, 1), rng.random(), 7.0, float(i)] + [rng.random() for _ in range(7)]
        return tuple(None if j in (1, 2) and rng.random() < 0.3 else v for j, v in enumerate(values)) + (None,)

    names = "abcdefghijklm"
    df = spark.createDataFrame([row(i) for i in range(500)], ", ".join(f"{c} double" for c in names)).repartition(7)
    wide = {(r["x"], r["y"]): r["value"] for r in p.correlations(df, df.columns).collect()}
    narrow = {(r["x"], r["y"]): r["value"] for r in p.correlations(df, ["a", "b", "d"]).collect()}
    assert len(wide) == 78 and set(narrow) == {("a", "b"), ("a", "d"), ("b", "d")}
    pandas = (df.toPandas() - [1e9, -2e9, *[0.0] * 11]).corr().fillna(0)
    for (x, y), value in wide.items():
        assert value == pytest.approx(pandas.loc[x, y], abs=1e-6), (x, y)
    for pair, value in narrow.items():
        assert value == pytest.approx(wide[pair], abs=1e-12)


def test_no_pairs(spark):
    assert p.correlations(spark.createDataFrame([(1.0,)], "a double"), ["a"]).collect() == []
