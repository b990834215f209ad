"""Parameterised queries, aggregations, filters, the join, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalogue import views
from tablewright.catalogue.registry import DIGITS, query, rounded, table
from tablewright.functions.measures import corrected_skew, pairwise_corr
from tablewright.operators import charts, frequency, quantiles, questions as q
from tablewright.plans import models, patterns


def sales_sql(then: str) -> str:
    return views.with_views(views.SALES_SQL, then=then)


def medical_sql(then: str) -> str:
    return views.with_views(views.MEDICAL_SQL, then=then)


def dirty_sql(then: str) -> str:
    return views.with_views(views.DIRTY_SQL, then=then)


# ---------------------------------------------------------------- Q: query shapes


# Unit prices have up to seven decimals: at eight, no value lies between two roundings.
UNIT_DIGITS = 8


def sales_query(name: str, then: str, build, digits: int = DIGITS) -> None:
    @query(name, sales_sql(then.replace(f", {DIGITS})", f", {digits})")))
    def run(spark, sf_dir):
        return rounded(build(views.sales(spark, sf_dir)), digits)


sales_query(
    "q01_top_groups",
    "SELECT product, ROUND(SUM(total_revenue), 4) AS total_total_revenue FROM sales GROUP BY product ORDER BY SUM(total_revenue) DESC, product LIMIT 10",
    lambda df: q.top_n_by_group(df, "product", "total_revenue"),
)
sales_query(
    "q01_top_groups_by_average",
    "SELECT product, ROUND(AVG(sales), 4) AS total_sales FROM sales GROUP BY product ORDER BY AVG(sales) DESC, product LIMIT 5",
    lambda df: q.top_n_by_group(df, "product", "sales", "avg", 5),
)
sales_query(
    "q02_top_values",
    "SELECT quantity, CAST(SUM(quantity) AS BIGINT) AS total FROM sales GROUP BY quantity ORDER BY total DESC, quantity LIMIT 10",
    lambda df: q.top_values(df, "quantity"),
)
sales_query(
    "q03_top_groups_by_count",
    "SELECT product, COUNT(*) AS count FROM sales GROUP BY product ORDER BY count DESC, product LIMIT 10",
    lambda df: q.count_by_group(df, "product", 10),
)
sales_query(
    "q04_top_rows",
    """SELECT product, region, date, ROUND(sales, 4) AS sales, quantity, ROUND(total_revenue, 4) AS total_revenue FROM sales
    ORDER BY sales.total_revenue DESC, product, region, date LIMIT 10""",
    lambda df: q.top_rows(df, "total_revenue"),
    UNIT_DIGITS,
)
sales_query(
    "q05_bottom_groups",
    "SELECT product, ROUND(SUM(total_revenue), 4) AS total_total_revenue FROM sales GROUP BY product ORDER BY SUM(total_revenue), product LIMIT 10",
    lambda df: q.top_n_by_group(df, "product", "total_revenue", ascending=True),
)
sales_query(
    "q05_bottom_values",
    "SELECT quantity, CAST(SUM(quantity) AS BIGINT) AS total FROM sales GROUP BY quantity ORDER BY total, quantity LIMIT 10",
    lambda df: q.top_values(df, "quantity", ascending=True),
)
sales_query(
    "q06_trend_yearly",
    "SELECT strftime(date, '%Y') AS period, ROUND(SUM(total_revenue), 4) AS value FROM sales GROUP BY period",
    lambda df: q.trend(df, "date", "total_revenue"),
)
sales_query(
    "q06_trend_monthly_average",
    "SELECT strftime(date, '%Y-%m') AS period, ROUND(AVG(total_revenue), 4) AS value FROM sales GROUP BY period",
    lambda df: q.trend(df, "date", "total_revenue", "month", "avg"),
)
sales_query(
    "q06_trend_daily_maximum",
    "SELECT strftime(date, '%Y-%m-%d') AS period, ROUND(MAX(total_revenue), 4) AS value FROM sales GROUP BY period",
    lambda df: q.trend(df, "date", "total_revenue", "day", "max"),
)
sales_query(
    "q07_monthly_count",
    "SELECT strftime(date, '%Y-%m') AS period, COUNT(*) AS count FROM sales GROUP BY period",
    lambda df: q.monthly_count(df, "date"),
)
sales_query(
    "q08_aggregate_by_group",
    "SELECT region, ROUND(MIN(sales), 4) AS min_sales FROM sales GROUP BY region",
    lambda df: q.agg_by_group(df, "region", "sales", "min", "min_sales"),
    UNIT_DIGITS,
)
sales_query(
    "q09_count_by_group",
    "SELECT region, COUNT(*) AS count FROM sales GROUP BY region",
    lambda df: q.count_by_group(df, "region"),
)
sales_query(
    "q10_totals",
    "SELECT ROUND(SUM(total_revenue), 4) AS total_total_revenue, COUNT(*) AS record_count FROM sales",
    lambda df: q.totals(df, "total_revenue"),
)
sales_query("q11_average", "SELECT ROUND(AVG(sales), 4) AS avg_sales FROM sales", lambda df: q.average(df, "sales"))
sales_query(
    "q12_distinct_count",
    "SELECT COUNT(DISTINCT product) AS unique_count FROM sales",
    lambda df: q.distinct_count(df, "product"),
)
sales_query("q13_row_count", "SELECT COUNT(*) AS total_count FROM sales", q.row_count)
sales_query(
    "q14_distinct_values",
    "SELECT DISTINCT product FROM sales ORDER BY product LIMIT 10",
    lambda df: q.distinct_values(df, "product"),
)
sales_query(
    "q15_first_rows",
    """SELECT product, region, date, ROUND(sales, 4) AS sales, quantity, ROUND(total_revenue, 4) AS total_revenue FROM sales
    ORDER BY date, product, region, sales.sales, quantity LIMIT 20""",
    lambda df: q.first_rows(df, ["date", "product", "region", "sales", "quantity"], 20),
    UNIT_DIGITS,
)
sales_query(
    "q16_compare",
    "SELECT region, ROUND(SUM(sales), 4) AS total FROM sales GROUP BY region",
    lambda df: q.compare(df, "region", "sales"),
)
sales_query(
    "q17_distribution",
    """SELECT product, COUNT(*) AS count, ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM sales), 2) AS percentage
    FROM sales GROUP BY product""",
    lambda df: q.distribution(df, "product"),
)
sales_query(
    "q18_latest_rows",
    """SELECT product, region, date, ROUND(sales, 4) AS sales, quantity, ROUND(total_revenue, 4) AS total_revenue FROM sales
    ORDER BY date DESC, product, region, sales.sales, quantity LIMIT 10""",
    lambda df: q.latest(df, "date"),
    UNIT_DIGITS,
)
sales_query(
    "q19_value_series",
    "SELECT date, ROUND(sales, 4) AS sales FROM sales ORDER BY date DESC, sales.sales LIMIT 10",
    lambda df: q.value_series(df, "date", "sales"),
    UNIT_DIGITS,
)


@query("q20_entity_count", medical_sql("SELECT COUNT(DISTINCT patient_id) AS patient_count FROM medical"))
def entity_count(spark, sf_dir):
    return q.entity_count(views.medical(spark, sf_dir), "patient_id", name="patient_count")


@query(
    "q20_entity_count_by_group",
    medical_sql("SELECT department, COUNT(*) AS patient_count FROM medical GROUP BY department"),
)
def entity_count_by_group(spark, sf_dir):
    return q.entity_count(views.medical(spark, sf_dir), "patient_id", "department", "patient_count")


sales_query(
    "q21_revenue",
    "SELECT ROUND(SUM(total_revenue), 4) AS total_revenue FROM sales",
    lambda df: q.revenue(df, "total_revenue"),
)
sales_query(
    "q21_revenue_by_group",
    "SELECT region, ROUND(SUM(total_revenue), 4) AS total FROM sales GROUP BY region",
    lambda df: q.revenue(df, "total_revenue", "region"),
)
sales_query(
    "q22_summary_by_group",
    "SELECT product, ROUND(SUM(sales), 4) AS total FROM sales GROUP BY product ORDER BY SUM(sales) DESC, product LIMIT 20",
    lambda df: q.summary(df, "product", "sales"),
)
sales_query(
    "q22_summary_count",
    "SELECT product, COUNT(*) AS count FROM sales GROUP BY product ORDER BY count DESC, product LIMIT 20",
    lambda df: q.summary(df, "product"),
)
sales_query(
    "q22_summary_total",
    "SELECT ROUND(SUM(sales), 4) AS result, COUNT(*) AS count FROM sales",
    lambda df: q.summary(df, value="sales"),
)
sales_query(
    "q23_sum_and_count",
    "SELECT region, ROUND(SUM(total_revenue), 4) AS total, COUNT(*) AS count FROM sales GROUP BY region",
    lambda df: q.sum_and_count_by_group(df, "region", "total_revenue"),
)
sales_query(
    "q24_monthly_sum",
    "SELECT strftime(date, '%Y-%m') AS period, ROUND(SUM(total_revenue), 4) AS total FROM sales GROUP BY period",
    lambda df: q.monthly_sum(df, "date", "total_revenue"),
)
sales_query(
    "q25_dynamic",
    "SELECT region, MAX(quantity) AS value FROM sales GROUP BY region ORDER BY value DESC, region LIMIT 3",
    lambda df: patterns.dynamic_query(df, "region", "quantity", "max", 3),
)
sales_query(
    "q25_dynamic_count",
    "SELECT COUNT(*) AS value FROM sales",
    lambda df: patterns.dynamic_query(df),
)


# ---------------------------------------------------------------- A: aggregations

LINE_MEASURES = """SUM(l_extendedprice) AS total, AVG(l_extendedprice) AS mean, MIN(l_extendedprice) AS low,
MAX(l_extendedprice) AS high, COUNT(*) AS n"""
LINE_SQL = """ROUND(SUM(l_extendedprice), 2) AS total, ROUND(AVG(l_extendedprice), 4) AS mean,
MIN(l_extendedprice) AS low, MAX(l_extendedprice) AS high, COUNT(*) AS n"""


def _line_measures():
    v = F.col("l_extendedprice")
    return [
        F.round(F.sum(v), 2).alias("total"), F.round(F.avg(v), 4).alias("mean"), F.min(v).alias("low"),
        F.max(v).alias("high"), F.count(F.lit(1)).alias("n"),
    ]


@query("a01_global_aggregates", f"SELECT {LINE_SQL} FROM lineitem")
def global_aggregates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(*_line_measures())


@query("a02_aggregates_by_column", f"SELECT l_returnflag, {LINE_SQL} FROM lineitem GROUP BY l_returnflag")
def aggregates_by_column(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*_line_measures())


@query(
    "a03_aggregates_by_two_columns",
    f"SELECT l_returnflag, l_linestatus, {LINE_SQL} FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
def aggregates_by_two(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(*_line_measures())


@query(
    "a04_distinct_counts",
    """SELECT event_type, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT CAST(ts AS DATE)) AS days
    FROM events GROUP BY event_type""",
)
def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"), F.count_distinct(F.col("ts").cast("date")).alias("days")
    )


@query(
    "a05_having_count",
    medical_sql("""SELECT patient_id, diagnosis, COUNT(*) AS visits, ROUND(SUM(cost), 4) AS total_cost FROM medical
    GROUP BY patient_id, diagnosis HAVING COUNT(*) > 1"""),
)
def having_count(spark, sf_dir):
    metrics = {"visits": F.count(F.lit(1)), "total_cost": F.sum("cost")}
    return rounded(q.frequent_groups(views.medical(spark, sf_dir), ["patient_id", "diagnosis"], metrics, 2, "visits"))


@query(
    "a06_percentage_of_total",
    """SELECT event_type, COUNT(*) AS count, ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM events), 2) AS percentage
    FROM events GROUP BY event_type""",
)
def percentage_of_total(spark, sf_dir):
    return q.distribution(table(spark, sf_dir, "events"), "event_type")


@query(
    "a07_rounded_average",
    "SELECT o_orderpriority, ROUND(AVG(o_totalprice), 2) AS avg_price FROM orders GROUP BY o_orderpriority",
)
def rounded_average(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 2).alias("avg_price"))


@query(
    "a08_statistics",
    dirty_sql("""SELECT ROUND(VAR_SAMP(quantity), 4) AS variance, ROUND(SKEWNESS(skewed_value), 4) AS skew,
    MEDIAN(skewed_value) AS middle,
    (SELECT payment_method FROM dirty WHERE payment_method IS NOT NULL GROUP BY payment_method ORDER BY COUNT(*) DESC, payment_method LIMIT 1) AS most_common,
    ROUND(CORR(quantity, skewed_value), 4) AS correlation FROM dirty"""),
)
def statistics(spark, sf_dir):
    df = views.dirty(spark, sf_dir)
    middle = quantiles.medians(df, {"skewed_value": F.col("skewed_value")})["skewed_value"]
    common = frequency.modes(df, ["payment_method"]).select("value").scalar()
    measured = df.agg(
        F.round(F.var_samp("quantity"), 4).alias("variance"),
        F.round(corrected_skew(F.col("skewed_value")), 4).alias("skew"),
        F.round(pairwise_corr(F.col("quantity"), F.col("skewed_value")), 4).alias("correlation"),
    )
    return measured.select("*", F.lit(middle).alias("middle"), common.alias("most_common"))


@query(
    "a10_null_group_and_zero_sum",
    dirty_sql("""SELECT payment_method AS category, CAST(COALESCE(SUM(CASE WHEN payment_method = '1-URGENT' THEN NULL ELSE quantity END), 0) AS DOUBLE) AS value
    FROM dirty GROUP BY payment_method"""),
)
def null_group(spark, sf_dir):
    df = views.dirty(spark, sf_dir)
    silenced = F.when(F.col("payment_method") == "1-URGENT", None).otherwise(F.col("quantity"))
    return charts.bar(df.withColumn("quantity", silenced), "payment_method", "quantity")


# ---------------------------------------------------------------- F: projections and filters


@query("f01_projection", "SELECT o_orderkey, o_orderpriority FROM orders")
def projection(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")


@query("f02_comparison_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000.5")
def comparison_filter(spark, sf_dir):
    return charts.view_filter(table(spark, sf_dir, "orders"), "o_totalprice", ">= 250000.5").select(
        "o_orderkey", "o_totalprice"
    )


@query(
    "f02_substring_filter",
    "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the')",
)
def substring_filter(spark, sf_dir):
    return charts.view_filter(table(spark, sf_dir, "documents"), "text", " THE ").select("doc_id", "lang")


@query(
    "f02_text_number_filter",
    """SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) < 10""",
)
def text_number_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return charts.view_filter(events, "k", "< 10").select("event_id")


@query("f03_not_null", dirty_sql("SELECT order_id, price FROM dirty WHERE price IS NOT NULL"))
def not_null(spark, sf_dir):
    return views.dirty(spark, sf_dir).where(F.col("price").isNotNull()).select("order_id", "price")


@query(
    "f04_thresholds",
    views.with_views(
        views.NEWS_SQL,
        then="SELECT title, shares, ROUND(sentiment, 4) AS sentiment FROM news WHERE shares > 1000 AND (sentiment > 0.5 OR sentiment < -0.3)",
    ),
)
def thresholds(spark, sf_dir):
    sentiment = F.col("sentiment")
    kept = views.news(spark, sf_dir).where((F.col("shares") > 1000) & ((sentiment > 0.5) | (sentiment < -0.3)))
    return rounded(kept.select("title", "shares", "sentiment"))


@query("f05_equality", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'A'")
def equality(spark, sf_dir):
    kept = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "A")
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "f06_drilldown",
    "SELECT * FROM customer WHERE CAST(c_nationkey AS VARCHAR) = '7' ORDER BY c_custkey LIMIT 100",
)
def drilldown(spark, sf_dir):
    return charts.drilldown(table(spark, sf_dir, "customer"), "c_nationkey", "7")


# ---------------------------------------------------------------- J: join; O: order, limit, union


@query(
    "j01_rows_with_group_aggregates",
    """SELECT o_orderkey, o_orderpriority, o_totalprice, record_count, ROUND(total, 2) AS total_o_totalprice, ROUND(mean, 4) AS avg_o_totalprice
    FROM orders LEFT JOIN (SELECT o_orderpriority AS p, COUNT(*) AS record_count, SUM(o_totalprice) AS total, AVG(o_totalprice) AS mean FROM orders GROUP BY o_orderpriority) a
    ON o_orderpriority = p""",
)
def rows_with_group_aggregates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    grouped = models.intermediate(orders, "o_orderpriority", "o_totalprice")
    joined = models.mart(orders, grouped, "o_orderpriority", "o_totalprice")
    return joined.withColumns({
        "total_o_totalprice": F.round("total_o_totalprice", 2), "avg_o_totalprice": F.round("avg_o_totalprice", 4)
    })


@query(
    "o01_nulls_last_both_ways",
    dirty_sql("""SELECT 'asc' AS direction, CAST(COUNT(*) AS BIGINT) AS place, price FROM dirty d GROUP BY price
    UNION ALL SELECT 'desc', CAST(COUNT(*) AS BIGINT), price FROM dirty d GROUP BY price"""),
)
def nulls_last(spark, sf_dir):
    """Both sort directions; the test suite checks where the nulls stand."""
    counts = views.dirty(spark, sf_dir).groupBy("price").agg(F.count(F.lit(1)).alias("place"))
    up = q.ranked(counts, "price", ascending=True).select(F.lit("asc").alias("direction"), "place", "price")
    down = q.ranked(counts, "price").select(F.lit("desc").alias("direction"), "place", "price")
    return up.unionByName(down)


@query("o02_top_k", "SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def top_k(spark, sf_dir):
    return q.top_rows(table(spark, sf_dir, "part"), "p_retailprice", 25)


@query(
    "o03_union_and_distinct",
    """SELECT DISTINCT name, kind FROM (SELECT c_name AS name, 'customer' AS kind FROM customer
    UNION ALL SELECT s_name, 'supplier' FROM supplier) t""",
)
def union_and_distinct(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    return customers.unionByName(suppliers).distinct()
