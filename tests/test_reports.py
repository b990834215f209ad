"""Query shapes, chart tables, models and declarations on small inline tables."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from tablewright.operators import charts, questions as q
from tablewright.plans import models, patterns, presets, spec as specs


@pytest.fixture(scope="module")
def shares(spark):
    rows = [("NASDAQ", 48.67), ("NASDAQ", 728.45), ("NYSE", 52.87), ("NYSE", None), (None, 10.0), ("EMPTY", None)]
    return spark.createDataFrame(rows, "exchange string, price double")


def plain(df):
    return [tuple(r) for r in df.collect()]


def test_group_report(shares):
    assert plain(charts.group_report(shares, "exchange", "price")) == [
        ("NASDAQ", 2, 777.12, 388.56, 48.67, 728.45), ("NYSE", 2, 52.87, 52.87, 52.87, 52.87),
        (None, 1, 10.0, 10.0, 10.0, 10.0), ("EMPTY", 1, None, None, None, None),
    ]
    assert charts.group_report(shares).columns == ["record_count"]
    assert charts.short_report(shares, "exchange", "price").columns == ["exchange", "record_count", "total_price", "avg_price"]


def test_bar_keeps_the_null_group_and_sums_nulls_to_zero(shares):
    assert plain(charts.bar(shares, "exchange", "price")) == [("NASDAQ", 777.12), ("NYSE", 52.87), (None, 10.0), ("EMPTY", 0.0)]
    assert plain(charts.pie(shares, "exchange", n=2)) == [("NASDAQ", 2.0), ("NYSE", 2.0)]


def test_sorting_puts_nulls_last_both_ways(shares):
    assert plain(q.ranked(shares.select("price"), "price", ascending=True))[-1] == (None,)
    assert plain(q.ranked(shares.select("price"), "price"))[-1] == (None,)


@pytest.mark.parametrize(
    "values, bins", [([0.0, 1.0, 2.0, 12.0], 12), ([5.0, 5.0, 5.0], 3), ([0.0, 0.0], 4), ([-3.0, 0.1, 0.2, 0.3, 7.7, 48.67], 12)]
)
def test_histogram_equals_pandas(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
    out = charts.histogram(df, "v", bins).collect()
    expected = pd.cut(pd.Series(values), bins=bins).value_counts(sort=False)
    assert [r["count"] for r in out] == expected.tolist()
    assert out[0]["lower_edge"] == pytest.approx(expected.index[0].left, abs=1e-2)
    assert sum(r["count"] for r in out) == len(values)


def test_histogram_of_decimal_edges_equals_pandas(spark):
    values = [round(0.1 * i, 1) for i in range(121)] + [0.3, 0.7, 1.1]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    expected = pd.cut(pd.Series(values), bins=12).value_counts(sort=False).tolist()
    assert [r["count"] for r in charts.histogram(df, "v").collect()] == expected


def test_histogram_of_nothing(spark):
    assert charts.histogram(spark.createDataFrame([(None,)], "v double"), "v").collect() == []


def test_heatmap_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0)], "a double, b double, c double")
    found = {(r["x"], r["y"]): r["value"] for r in charts.heatmap(df, ["a", "b", "c"]).collect()}
    assert len(found) == 9 and found[("a", "b")] == found[("b", "a")] == 1.0
    assert found[("a", "a")] == 1.0 and found[("c", "c")] == 0.0 and found[("a", "c")] == 0.0


def test_trend_keeps_the_last_or_first_months(spark):
    days = [datetime.date(2022 + i // 12, i % 12 + 1, 3) for i in range(20)]
    df = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days)] + [(None, 1.0)], "d date, v double")
    last, first = charts.monthly_trend(df, "d", "v").collect(), charts.dashboard_trend(df, "d", "v").collect()
    assert [r["period"] for r in last] == [d.isoformat()[:7] for d in days[8:]]
    assert [r["period"] for r in first] == [d.isoformat()[:7] for d in days[:12]]


def test_view_filter(spark):
    df = spark.createDataFrame([("5", "a.c", 1.0), ("7", "abc", None), ("9", "A.C!", 3.0)], "t string, w string, x double")
    assert charts.view_filter(df, "t", ">= 7").count() == 2
    assert charts.view_filter(df, "t", "7").count() == 1
    assert charts.view_filter(df, "w", "a.c").count() == 2  # literal, not a pattern
    assert charts.view_filter(df, "w", "> 1").count() == 0  # not a numeric column: looked up as text
    assert charts.view_filter(df, "x", "3").count() == 1  # a third is missing: substring of 3.0


def test_drilldown_compares_as_text(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "k int, v string")
    assert [r["v"] for r in charts.drilldown(df, "k", "1").collect()] == ["a", "c"]


def test_trend_defaults_to_years(spark):
    df = spark.createDataFrame([(datetime.date(2023, 1, 1), 1.0), (datetime.date(2023, 5, 1), 2.0)], "d date, v double")
    assert plain(q.trend(df, "d", "v")) == [("2023", 3.0)]


def test_aggregates_need_a_column():
    with pytest.raises(ValueError):
        q.aggregate(None, "sum")


def test_percentages_sum_to_hundred(shares):
    assert sum(r["percentage"] for r in q.distribution(shares, "exchange").collect()) == pytest.approx(100, abs=0.05)


def test_mart_keeps_every_row_and_starts_no_job(spark):
    rows = [("hot", float(i)) for i in range(300)] + [(f"g{i}", 1.0) for i in range(50)] + [(None, 2.0)]
    staged = spark.createDataFrame(rows, "g string, v double")
    spark.sparkContext.setJobGroup("mart", "")
    joined = models.mart(staged, models.intermediate(staged, "g", "v"), "g", "v")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("mart")
    assert "hint" not in joined._jdf.queryExecution().optimizedPlan().toString().lower()
    found = joined.collect()
    assert len(found) == len(rows)
    assert {r["record_count"] for r in found if r["g"] == "hot"} == {300}


def test_staging_keeps_every_column_with_a_role(spark):
    names = {"id": ["i1", "i2", "i3", "i4"], "categorical": ["c1", "c2", "c3", "c4"], "numeric": ["n1", "n2", "n3", "n4"], "date": ["d1", "d2", "d3"]}
    kinds = {"id": "long", "categorical": "string", "numeric": "double", "date": "date"}
    df = spark.createDataFrame([], ", ".join(f"{c} {kinds[k]}" for k, cs in names.items() for c in cs))
    assert models.staging(df, names).columns == [*(c for cs in names.values() for c in cs), "_loaded_at"]


@pytest.mark.parametrize("wanted, found", [(">5", 4), (" = 2 ", 1), ("<=1", 2)])
def test_typed_numbers_are_compared_however_many_are_null(spark, wanted, found):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(None,)] * 30, "x double")
    assert charts.view_filter(df, "x", wanted).count() == found


def test_data_tests_find_planted_failures(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "c"), (None, "d")], "k int, v string")
    out = models.data_tests({"m": df}, [("m", "k", "unique"), ("m", "k", "not_null"), ("m", "v", "not_null")])
    found = {(r["column_name"], r["test"]): (r["failures"], r["passed"]) for r in out.collect()}
    assert found == {("k", "unique"): (2, False), ("k", "not_null"): (2, False), ("v", "not_null"): (1, False)}


def test_spec_survives_json(tmp_path):
    for spec in presets.PRESETS.values():
        path = str(tmp_path / f"{spec.name}.json")
        spec.save(path)
        assert specs.DatasetSpec.load(path) == spec


def test_declared_schema_and_types(spark):
    schema = presets.MEDICAL.schema()
    assert schema["age"].dataType == T.IntegerType() and not schema["age"].nullable and schema["cost"].nullable
    assert specs.ColumnSpec("x", "whatever").spark_type == T.StringType()
    assert specs.empty_table(spark, presets.SALES).count() == 0


def test_typed_casts(spark):
    df = spark.createDataFrame([("2.5", "1d", "31/12/2024", 3.5), ("x", "1e3", "bad", -1.7)], "a string, b string, c string, d double")
    spec = specs.DatasetSpec("t", columns=[
        specs.ColumnSpec("a", "integer"), specs.ColumnSpec("b", "float"), specs.ColumnSpec("c", "date"), specs.ColumnSpec("d", "integer"),
    ])
    assert plain(specs.cast_by_spec(df, spec)) == [(2, None, datetime.date(2024, 12, 31), 4), (None, 1000.0, None, -2)]


def test_violations_are_counted(spark):
    df = spark.createDataFrame(
        [("p1", -1, "M"), ("p1", 200, "X"), ("p2", None, None), (None, 5, "F")], "patient_id string, age int, gender string"
    )
    found = {(r["column_name"], r["rule"]): r["violations"] for r in specs.violations(df, presets.MEDICAL).collect()}
    assert found[("age", "positive")] == 1 and found[("age", "range_0_150")] == 2 and found[("age", "valid_age")] == 2
    assert found[("gender", "valid_genders")] == 1 and found[("age", "required")] == 1
    assert found[("patient_id", "unique")] == 2 and found[("patient_id", "required")] == 1


def test_text_standardisation(spark):
    df = spark.createDataFrame([(" T ", "POLITICS", " Web ")], "title string, category string, source string")
    assert plain(specs.standardise(df, presets.NEWS)) == [("T", "politics", " web ")]


def test_every_preset_has_its_patterns():
    assert {k: len(v) for k, v in patterns.PATTERNS.items()} == {"sales": 7, "news": 10, "medical": 10, "financial": 8}
    names = [s["pattern"] for s in patterns.pattern_suggestions(presets.NEWS)]
    assert names == list(patterns.PATTERNS["news"])
    assert patterns.pattern_suggestions(presets.FINANCIAL)[4]["question"] == "Show portfolio summary"


def test_today_is_an_argument(spark):
    df = spark.createDataFrame([(datetime.date(2024, 2, 20), None, 10, 5.0)], "admission_date date, discharge_date date, age int, cost double")
    row = specs.with_calculated(df, presets.MEDICAL, "2024-03-01").first()
    assert (row["length_of_stay"], row["age_group"], row["cost_category"]) == (10, "Child", "Low")


def test_cast_by_schema_requires_ids(spark):
    df = spark.createDataFrame([("1", "2.5"), (None, "7")], "order_id string, price string")
    columns = [
        {"column_name": "order_id", "type": "object", "semantic": "id", "nullable": True},
        {"column_name": "price", "type": "object", "semantic": "money", "nullable": False},
    ]
    assert plain(models.cast_by_schema(df, columns)) == [("1", 2.5)]
    assert models.cast_by_schema(df, columns, stamped=True, loaded_at=F.lit(0)).count() == 2


def test_charts_of_raw_text(spark):
    """Texts of numbers and dates are charted, bad ones left out; the rows keep their texts."""
    rows = [("a", "10", "2024-01-05"), ("b", "20.5", "01/09/2024"), ("a", "n/a", "2024-02-01"), ("b", "1", "soon"), ("a", "2", "2024-02-03"), (None, "3", "2024-03-01")]
    view = charts.report_view(spark.createDataFrame(rows, "kind string, amount string, day string"), sort_by="amount")
    assert plain(view["bar"]) == [("b", 21.5), ("a", 12.0), (None, 3.0)]
    assert plain(view["line"]) == [("2024-01", 30.5), ("2024-02", 2.0), ("2024-03", 3.0)]
    assert [r[0] for r in plain(view["heatmap"])] == ["amount"] and sum(r["count"] for r in view["histogram"].collect()) == 5
    assert {r["amount"] for r in view["rows"].collect()} == {r[1] for r in rows}


def test_mostly_bad_text_is_not_typed(spark):
    rows = [("x", "1"), ("x", "bad"), ("y", "worse"), ("y", None)]
    view = charts.report_view(spark.createDataFrame(rows, "kind string, amount string"))
    assert "line" not in view and "histogram" not in view and plain(view["bar"]) == [("x", 2.0), ("y", 2.0)]
    empty = charts.report_view(spark.createDataFrame([], "kind string, amount string"))
    assert plain(empty["total"]) == [(0,)] and plain(empty["bar"]) == []


def test_shares_and_null_counts_shuffle_no_values(spark):
    from tablewright.operators import profile as p

    df = spark.range(100).select(F.col("id").cast("string").alias("a"), F.lit("x" * 500).alias("b"))
    for found in (p.likeness(df, ["a", "b"]), p.null_counts(df)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == plan.count("Exchange SinglePartition") <= 2 and "hashpartitioning" not in plan
    assert [tuple(r) for r in p.null_counts(df).select("column_name", "row_count", "null_count").collect()] == [("a", 100, 0), ("b", 100, 0)]
