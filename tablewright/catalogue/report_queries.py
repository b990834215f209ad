"""Reports, chart tables, dashboards and the report view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalogue import views
from tablewright.catalogue.profile_queries import DATE_SQL, dirty_profile, number_sql
from tablewright.catalogue.registry import query, rounded, table
from tablewright.operators import charts, profile
from tablewright.sources import tables as warehouse

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def sales_sql(then: str) -> str:
    return views.with_views(views.SALES_SQL, then=then)


def dirty_sql(then: str) -> str:
    return views.with_views(views.DIRTY_SQL, then=then)


def report_sql(value: str) -> str:
    return f"""COUNT(*) AS record_count, ROUND(SUM({value}), 4) AS total_{value}, ROUND(AVG({value}), 2) AS avg_{value},
    ROUND(MIN({value}), 4) AS min_{value}, ROUND(MAX({value}), 4) AS max_{value}"""


@query("r01_group_report", dirty_sql(f"SELECT payment_method, {report_sql('skewed_value')} FROM dirty GROUP BY payment_method"))
def group_report(spark, sf_dir):
    return rounded(charts.group_report(views.dirty(spark, sf_dir), "payment_method", "skewed_value"))


@query("r02_group_report_counts", dirty_sql("SELECT payment_method, COUNT(*) AS record_count FROM dirty GROUP BY payment_method"))
def group_report_counts(spark, sf_dir):
    return charts.group_report(views.dirty(spark, sf_dir), "payment_method")


@query("r03_global_report", sales_sql(f"SELECT {report_sql('total_revenue')} FROM sales"))
def global_report(spark, sf_dir):
    return rounded(charts.group_report(views.sales(spark, sf_dir), value="total_revenue"))


@query(
    "r04_report_by_detected_columns",
    dirty_sql("""SELECT gender, COUNT(*) AS record_count, ROUND(SUM(quantity), 4) AS total_quantity, ROUND(AVG(quantity), 2) AS avg_quantity,
    MIN(quantity) AS min_quantity, MAX(quantity) AS max_quantity FROM dirty GROUP BY gender"""),
)
def report_by_detected_columns(spark, sf_dir):
    """Group and value are found from the types and roles; the id column is not summed."""
    df = views.dirty(spark, sf_dir)
    group, value = charts.report_columns(df, profile.roles(dirty_profile(spark, sf_dir)))
    return rounded(charts.group_report(df, group, value))


@query(
    "r04_report_with_ids",
    dirty_sql("""SELECT gender, COUNT(*) AS record_count, CAST(SUM(order_id) AS BIGINT) AS total_order_id, ROUND(AVG(order_id), 2) AS avg_order_id,
    MIN(order_id) AS min_order_id, MAX(order_id) AS max_order_id FROM dirty GROUP BY gender"""),
)
def report_with_ids(spark, sf_dir):
    df = views.dirty(spark, sf_dir)
    group, value = charts.report_columns(df, profile.roles(dirty_profile(spark, sf_dir)), exclude_ids=False)
    return charts.group_report(df, group, value)


# ---------------------------------------------------------------- charts


@query(
    "r05_bar",
    dirty_sql("""SELECT payment_method AS category, ROUND(SUM(quantity), 4) AS value FROM dirty GROUP BY 1 ORDER BY value DESC, category LIMIT 12"""),
)
def bar(spark, sf_dir):
    return rounded(charts.bar(views.dirty(spark, sf_dir), "payment_method", "quantity"))


@query(
    "r05_bar_counts",
    sales_sql("SELECT product AS category, CAST(COUNT(*) AS DOUBLE) AS value FROM sales GROUP BY 1 ORDER BY value DESC, category LIMIT 12"),
)
def bar_counts(spark, sf_dir):
    return charts.bar(views.sales(spark, sf_dir), "product")


@query(
    "r06_pie",
    sales_sql("SELECT product AS name, ROUND(SUM(sales), 4) AS value FROM sales GROUP BY 1 ORDER BY SUM(sales) DESC, name LIMIT 8"),
)
def pie(spark, sf_dir):
    return rounded(charts.pie(views.sales(spark, sf_dir), "product", "sales"))


def histogram_sql(source: str, column: str, bins: int = 12) -> str:
    return f"""SELECT CAST(b AS INTEGER) AS bin, ROUND(CASE WHEN b = 1 THEN lo - (hi - lo) * 0.001 ELSE lo + w * (b - 1) END, 4) AS lower_edge,
    ROUND(CASE WHEN b = {bins} THEN hi ELSE lo + w * b END, 4) AS upper_edge,
    (SELECT COUNT(*) FROM {source} WHERE ({column} > lo + w * (b - 1) OR b = 1) AND ({column} <= lo + w * b OR b = {bins})) AS count
    FROM (SELECT MIN({column}) AS lo, MAX({column}) AS hi, (MAX({column}) - MIN({column})) / {bins} AS w FROM {source}) s, range(1, {bins + 1}) t(b)"""


@query("r07_histogram", histogram_sql("lineitem", "l_quantity"))
def histogram(spark, sf_dir):
    return rounded(charts.histogram(table(spark, sf_dir, "lineitem"), "l_quantity"))


@query("r07_histogram_skewed", dirty_sql(histogram_sql("dirty", "skewed_value")))
def histogram_skewed(spark, sf_dir):
    return rounded(charts.histogram(views.dirty(spark, sf_dir), "skewed_value"))


_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, ROUND(CORR({a}, {b}), 4) + 0.0 AS value FROM lineitem" for a in NUMBERS for b in NUMBERS
)


@query("r08_correlation_heatmap", _PAIRS)
def heatmap(spark, sf_dir):
    return charts.heatmap(table(spark, sf_dir, "lineitem"), NUMBERS)


def months_sql(source: str, date: str, value: str, direction: str) -> str:
    return f"""SELECT strftime({date}, '%Y-%m') AS period, ROUND(SUM({value}), 4) AS value FROM {source} WHERE {date} IS NOT NULL
    GROUP BY period ORDER BY period {direction} LIMIT 12"""


@query("r09_last_months", months_sql("orders", "o_orderdate", "o_totalprice", "DESC"))
def last_months(spark, sf_dir):
    return rounded(charts.monthly_trend(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"))


@query(
    "r09_text_dates",
    views.with_views(
        views.DIRTY_SQL,
        then=months_sql(f"(SELECT {DATE_SQL.format(c='order_date')} AS d, COALESCE({number_sql('price')}, 0) AS v FROM dirty) t", "d", "v", "DESC"),
    ),
)
def text_dates(spark, sf_dir):
    """Dates and values as text, with bad ones among both."""
    return rounded(charts.monthly_trend(views.dirty(spark, sf_dir), "order_date", "price"))


@query(
    "r10_dashboard_primary",
    sales_sql("SELECT region AS category, ROUND(SUM(sales), 4) AS value FROM sales GROUP BY 1 ORDER BY SUM(sales) DESC LIMIT 10"),
)
def dashboard_primary(spark, sf_dir):
    return rounded(charts.dashboard_primary(views.sales(spark, sf_dir), "region", "sales"))


@query(
    "r11_dashboard_secondary",
    sales_sql("SELECT product AS category, COUNT(*) AS value FROM sales GROUP BY 1 ORDER BY value DESC, category LIMIT 10"),
)
def dashboard_secondary(spark, sf_dir):
    return charts.dashboard_secondary(views.sales(spark, sf_dir), "product")


@query("r12_dashboard_trend", months_sql("orders", "o_orderdate", "o_totalprice", ""))
def dashboard_trend(spark, sf_dir):
    return rounded(charts.dashboard_trend(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"))


_VIEW_SQL = f"""WITH kept AS (SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderdate FROM orders WHERE o_totalprice > 200000),
h AS ({histogram_sql('kept', 'o_totalprice')}), m AS ({months_sql('kept', 'o_orderdate', 'o_totalprice', 'DESC')}),
p AS (SELECT o_orderpriority AS label, SUM(o_totalprice) AS value FROM kept GROUP BY 1 ORDER BY value DESC LIMIT 12)
SELECT 'total' AS chart, 'rows' AS label, CAST(COUNT(*) AS DOUBLE) AS value FROM kept
UNION ALL SELECT 'bar', label, ROUND(value, 4) FROM p
UNION ALL SELECT 'pie', label, ROUND(value, 4) FROM (SELECT * FROM p ORDER BY value DESC LIMIT 6) t
UNION ALL SELECT 'histogram', CAST(bin AS VARCHAR), CAST(count AS DOUBLE) FROM h
UNION ALL SELECT 'heatmap', 'o_totalprice|o_totalprice', 1.0
UNION ALL SELECT 'line', period, value FROM m"""


@query("r13_report_view", _VIEW_SQL)
def report_view(spark, sf_dir):
    """All chart tables of a filtered and sorted view."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderpriority", "o_totalprice", "o_orderdate"
    )
    found = charts.report_view(
        orders, filter_column="o_totalprice", filter_value=">200000", sort_by="o_totalprice", descending=True,
        category="o_orderpriority",
    )
    return rounded(charts.chart_rows(found))


_RAW_SQL = f""", raw AS (SELECT payment_method, {DATE_SQL.format(c='order_date')} AS order_date,
  CASE WHEN order_id % 10 <> 0 THEN skewed_value END AS amount FROM dirty WHERE order_id IS NOT NULL),
h AS ({histogram_sql('raw', 'amount')}), m AS ({months_sql('raw', 'order_date', 'amount', 'DESC')}),
p AS (SELECT payment_method AS label, COALESCE(SUM(amount), 0) AS value FROM raw GROUP BY 1 ORDER BY value DESC, label NULLS LAST LIMIT 12)
SELECT 'total' AS chart, 'rows' AS label, CAST(COUNT(*) AS DOUBLE) AS value FROM raw
UNION ALL SELECT 'bar', label, ROUND(value, 4) FROM p
UNION ALL SELECT 'pie', label, ROUND(value, 4) FROM (SELECT * FROM p ORDER BY value DESC LIMIT 6) t
UNION ALL SELECT 'histogram', CAST(bin AS VARCHAR), CAST(count AS DOUBLE) FROM h
UNION ALL SELECT 'heatmap', 'amount|amount', 1.0
UNION ALL SELECT 'line', period, value FROM m"""


@query("r13_report_view_text", dirty_sql(_RAW_SQL))
def report_view_text(spark, sf_dir):
    """All chart tables of a table of texts, a tenth of its amounts and some of its dates being none."""
    rows = views.dirty(spark, sf_dir).where(F.col("order_id").isNotNull())
    amount = F.when(F.col("order_id") % 10 == 0, "unpriced").otherwise(F.col("skewed_value").cast("string"))
    return rounded(charts.chart_rows(charts.report_view(rows.select("payment_method", "order_date", amount.alias("amount")))))


@query(
    "r13_report_view_rows",
    """SELECT * FROM customer WHERE contains(lower(c_mktsegment), 'auto') ORDER BY c_acctbal DESC, c_custkey LIMIT 200""",
)
def report_view_rows(spark, sf_dir):
    found = charts.report_view(
        table(spark, sf_dir, "customer"), filter_column="c_mktsegment", filter_value="Auto", sort_by="c_acctbal",
        descending=True,
    )
    return found["rows"]


@query(
    "r14_run_rollup",
    """SELECT strftime(ts, '%Y-%m') AS date, COUNT(*) AS runs, COUNT(*) FILTER (WHERE event_type <> 'error') AS success,
    ROUND(COUNT(*) FILTER (WHERE event_type <> 'error') * 100.0 / COUNT(*), 1) AS success_rate FROM events GROUP BY 1""",
)
def run_rollup(spark, sf_dir):
    return charts.run_rollup(table(spark, sf_dir, "events"), "ts", F.col("event_type") != "error")


_ALL = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


@query(
    "r15_warehouse_stats",
    f"""SELECT CAST(COUNT(*) AS BIGINT) AS tables, CAST(SUM(n) AS BIGINT) AS total_rows, CAST(MAX(n) AS BIGINT) AS largest FROM
    ({' UNION ALL '.join(f'SELECT COUNT(*) AS n FROM {t}' for t in _ALL)}) t""",
)
def warehouse_stats(spark, sf_dir):
    listed = warehouse.catalog_summary({t: table(spark, sf_dir, t) for t in _ALL})
    return listed.agg(
        F.count(F.lit(1)).alias("tables"), F.sum("row_count").alias("total_rows"), F.max("row_count").alias("largest")
    )


@query(
    "r16_short_report",
    sales_sql("""SELECT region, COUNT(*) AS record_count, ROUND(SUM(quantity), 4)::BIGINT AS total_quantity, ROUND(AVG(quantity), 2) AS avg_quantity
    FROM sales GROUP BY region"""),
)
def short_report(spark, sf_dir):
    return charts.short_report(views.sales(spark, sf_dir), "region", "quantity")
