"""Staged models, data tests and the run from raw data to a report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalogue import views
from tablewright.catalogue.clean_queries import cleaned_sql
from tablewright.catalogue.registry import query, rounded, table
from tablewright.durable import scratch_path
from tablewright.plans import flow, models
from tablewright.sources.tables import replace_files

ROLES = {
    "id": ["transaction_id"], "categorical": ["symbol", "type", "broker"],
    "numeric": ["total_value", "quantity", "fee"], "date": ["date"],
}
STAMP = "TIMESTAMP '2024-03-01 00:00:00'"

STAGING_SQL = f"""staging AS (SELECT transaction_id, trim(symbol) AS symbol, trim(type) AS type, trim(broker) AS broker,
  ROUND(total_value, 2) AS total_value, ROUND(quantity, 2) AS quantity, ROUND(fee, 2) AS fee, date, {STAMP} AS _loaded_at
  FROM financial_view WHERE transaction_id IS NOT NULL)"""
INTERMEDIATE_SQL = """intermediate AS (SELECT symbol, COUNT(*) AS record_count, SUM(total_value) AS total_total_value,
  AVG(total_value) AS avg_total_value, MIN(total_value) AS min_total_value, MAX(total_value) AS max_total_value
  FROM staging GROUP BY symbol)"""


def model_sql(then: str) -> str:
    return views.with_views(views.FINANCIAL_SQL, STAGING_SQL, INTERMEDIATE_SQL, then=then)


def staged(spark, sf_dir):
    stamp = F.lit(views.TODAY).cast("timestamp_ntz")
    return models.staging(views.financial_view(spark, sf_dir), ROLES, stamp)


# Fees are products of two-digit numbers, so they end in 5 at three digits and are left out.
_STAGED = "transaction_id, symbol, type, broker, total_value, quantity, date, _loaded_at"


@query("m01_staging", model_sql(f"SELECT {_STAGED} FROM staging"))
def staging(spark, sf_dir):
    return staged(spark, sf_dir).drop("fee")


@query(
    "m02_intermediate",
    model_sql("""SELECT symbol, record_count, ROUND(total_total_value, 4) AS total_total_value, ROUND(avg_total_value, 4) AS avg_total_value,
    min_total_value, max_total_value FROM intermediate"""),
)
def intermediate(spark, sf_dir):
    return rounded(models.intermediate(staged(spark, sf_dir), "symbol", "total_value"))


@query(
    "m03_mart",
    model_sql("""SELECT transaction_id, s.symbol AS symbol, type, broker, total_value, quantity, date, _loaded_at, record_count,
    ROUND(total_total_value, 4) AS total_total_value, ROUND(avg_total_value, 4) AS avg_total_value
    FROM staging s LEFT JOIN intermediate i ON s.symbol = i.symbol"""),
)
def mart(spark, sf_dir):
    """The intermediate model is written first, so its size is known before the join."""
    rows = staged(spark, sf_dir).drop("fee")
    grouped = replace_files(models.intermediate(rows, "symbol", "total_value"), scratch_path(spark, "intermediate"))
    return rounded(models.mart(rows, grouped, "symbol", "total_value"))


def order_lines(spark, sf_dir):
    """order_id, city, price, quantity: one row per order line."""
    lineitem, orders, customer, nation = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    places = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select("c_custkey", F.col("n_name").alias("city"))
    return (
        lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
        .join(places, orders.o_custkey == places.c_custkey)
        .select(
            F.col("o_orderkey").alias("order_id"), "city",
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"),
        )
    )


LINES_SQL = """lines AS (SELECT o_orderkey AS order_id, n_name AS city, l_extendedprice / l_quantity AS price, l_quantity AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


@query(
    "m04_order_totals",
    views.with_views(LINES_SQL, then="SELECT order_id, city, ROUND(SUM(price * quantity), 2) AS total_sale FROM lines GROUP BY order_id, city"),
)
def order_totals(spark, sf_dir):
    return rounded(models.order_totals(order_lines(spark, sf_dir)), 2)


@query(
    "m04_sales_by_city",
    views.with_views(
        LINES_SQL,
        then="""SELECT city, COUNT(DISTINCT order_id) AS total_orders, ROUND(SUM(price * quantity), 2) AS total_revenue,
        ROUND(SUM(price * quantity) / COUNT(DISTINCT order_id), 2) AS average_order_value FROM lines GROUP BY city""",
    ),
)
def sales_by_city(spark, sf_dir):
    return rounded(models.sales_by_city(models.order_totals(order_lines(spark, sf_dir))), 2)


def _failures(view: str, model: str, column: str, test: str) -> str:
    if test == "unique":
        n = f"(SELECT COALESCE(SUM(n), 0) FROM (SELECT COUNT(*) AS n FROM {view} WHERE {column} IS NOT NULL GROUP BY {column} HAVING COUNT(*) > 1) t)"
    else:
        n = f"(SELECT COUNT(*) FROM {view} WHERE {column} IS NULL)"
    return f"SELECT '{model}' AS model, '{column}' AS column_name, '{test}' AS test, CAST({n} AS BIGINT) AS failures, {n} = 0 AS passed"


_TESTS = models.model_tests(ROLES) + [("staging", "broker", "not_null"), ("orders", "order_id", "unique"), ("orders", "price", "not_null")]


@query(
    "m05_data_tests",
    views.with_views(
        views.FINANCIAL_SQL, STAGING_SQL, INTERMEDIATE_SQL, views.DIRTY_SQL,
        then=" UNION ALL ".join(_failures("dirty" if m == "orders" else m, m, c, t) for m, c, t in _TESTS),
    ),
)
def data_tests(spark, sf_dir):
    """Tests that pass and tests that find the planted nulls and copies."""
    rows = staged(spark, sf_dir)
    built = {
        "staging": rows,
        "intermediate": models.intermediate(rows, "symbol", "total_value"),
        "orders": views.dirty(spark, sf_dir),
    }
    return models.data_tests(built, _TESTS)


@query(
    "m06_ingest_clean_report",
    cleaned_sql("""SELECT gender, COUNT(*) AS record_count, ROUND(SUM(customer_name), 4) AS total_customer_name, ROUND(AVG(customer_name), 2) AS avg_customer_name,
    MIN(customer_name) AS min_customer_name, MAX(customer_name) AS max_customer_name FROM cleaned GROUP BY gender"""),
)
def ingest_clean_report(spark, sf_dir):
    """Raw to report through written stages. Cleaning has made the customer column numeric."""
    done = flow.run_flow(spark, views.dirty(spark, sf_dir), scratch_path(spark, "flow"), order_by=["order_id"])
    return rounded(done.report)


@query(
    "m06_step_log",
    cleaned_sql("""SELECT 0 AS step, 'ingest' AS name, 'raw' AS target, (SELECT COUNT(*) FROM dirty) AS row_count
    UNION ALL SELECT 1, 'clean', 'clean', (SELECT COUNT(*) FROM cleaned)
    UNION ALL SELECT 2, 'report', 'report', (SELECT COUNT(DISTINCT gender) FROM cleaned)"""),
)
def step_log(spark, sf_dir):
    done = flow.run_flow(spark, views.dirty(spark, sf_dir), scratch_path(spark, "flow"), order_by=["order_id"])
    return done.steps
