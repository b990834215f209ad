"""The named queries of the four declared datasets, and what a declaration offers besides."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalogue import views
from tablewright.catalogue.registry import DIGITS, query, rounded
from tablewright.durable import scratch_path
from tablewright.operators.profile import auto_types, column_profile
from tablewright.plans import patterns, presets, spec as specs

LIMIT = 10

VIEWS = {
    "sales": (views.sales, views.SALES_SQL),
    "news": (views.news, views.NEWS_SQL),
    "medical": (views.medical, views.MEDICAL_SQL),
    "financial": (views.financial, views.FINANCIAL_SQL),
}


def _r(expr: str, alias: str) -> str:
    return f"ROUND({expr}, {DIGITS}) AS {alias}"


REVENUE = _r("SUM(total_revenue)", "revenue")
COST = _r("AVG(cost)", "avg_cost")

# (dataset, pattern) -> SQL twin, in inventory order.
TWINS = {
    ("sales", "top_products"): f"SELECT product, {REVENUE} FROM sales GROUP BY product ORDER BY SUM(total_revenue) DESC, product LIMIT {LIMIT}",
    ("sales", "by_region"): f"SELECT region, {REVENUE} FROM sales GROUP BY region",
    ("sales", "monthly_trend"): f"SELECT strftime(date, '%Y-%m') AS month, {REVENUE} FROM sales GROUP BY month",
    ("sales", "total_revenue"): f"SELECT {_r('SUM(total_revenue)', 'total')} FROM sales",
    ("sales", "average_sales"): f"SELECT {_r('AVG(sales)', 'avg_sales')} FROM sales",
    ("sales", "best_product"): f"SELECT product, {REVENUE} FROM sales GROUP BY product ORDER BY SUM(total_revenue) DESC, product LIMIT 1",
    ("sales", "worst_product"): f"SELECT product, {REVENUE} FROM sales GROUP BY product ORDER BY SUM(total_revenue), product LIMIT 1",
    ("news", "top_sources"): f"SELECT source, COUNT(*) AS article_count, CAST(SUM(views) AS BIGINT) AS total_views FROM news GROUP BY source ORDER BY total_views DESC, source, article_count LIMIT {LIMIT}",
    ("news", "by_category"): f"SELECT category, COUNT(*) AS count, {_r('AVG(sentiment)', 'avg_sentiment')} FROM news GROUP BY category",
    ("news", "daily_trend"): f"SELECT published_date AS date, COUNT(*) AS articles, {_r('AVG(sentiment)', 'avg_sentiment')} FROM news GROUP BY published_date",
    ("news", "most_shared"): f"SELECT title, source, shares, {_r('sentiment', 'sentiment')} FROM news ORDER BY shares DESC, title, source LIMIT {LIMIT}",
    ("news", "sentiment_analysis"): f"SELECT category, {_r('AVG(sentiment)', 'avg_sentiment')}, COUNT(*) AS count FROM news GROUP BY category",
    ("news", "top_authors"): f"SELECT author, COUNT(*) AS articles, CAST(SUM(views) AS BIGINT) AS total_views FROM news WHERE author IS NOT NULL GROUP BY author ORDER BY total_views DESC, author LIMIT {LIMIT}",
    ("news", "viral_articles"): f"SELECT title, source, views, shares, engagement_score FROM news WHERE shares > 1000 ORDER BY engagement_score DESC, title LIMIT {LIMIT}",
    ("news", "positive_news"): f"SELECT title, source, {_r('sentiment', 'sentiment')} FROM news WHERE sentiment > 0.5 ORDER BY news.sentiment DESC, title LIMIT {LIMIT}",
    ("news", "negative_news"): f"SELECT title, source, {_r('sentiment', 'sentiment')} FROM news WHERE sentiment < -0.3 ORDER BY news.sentiment, title LIMIT {LIMIT}",
    ("news", "category_breakdown"): f"SELECT category, COUNT(*) AS count, {_r('AVG(views)', 'avg_views')}, {_r('AVG(shares)', 'avg_shares')} FROM news GROUP BY category",
    ("medical", "top_diagnoses"): f"SELECT diagnosis, COUNT(*) AS patient_count, {COST} FROM medical GROUP BY diagnosis ORDER BY patient_count DESC, diagnosis LIMIT {LIMIT}",
    ("medical", "by_department"): f"SELECT department, COUNT(*) AS patients, {COST}, {_r('AVG(length_of_stay)', 'avg_stay')} FROM medical GROUP BY department",
    ("medical", "age_distribution"): f"SELECT age_group, COUNT(*) AS count, {COST} FROM medical GROUP BY age_group",
    ("medical", "gender_breakdown"): f"SELECT gender, COUNT(*) AS count, {_r('AVG(age)', 'avg_age')}, {COST} FROM medical GROUP BY gender",
    ("medical", "monthly_admissions"): f"SELECT strftime(admission_date, '%Y-%m') AS month, COUNT(*) AS admissions, {COST} FROM medical GROUP BY month",
    ("medical", "treatment_outcomes"): f"SELECT outcome, COUNT(*) AS count, {COST} FROM medical WHERE outcome IS NOT NULL GROUP BY outcome",
    ("medical", "insurance_analysis"): f"SELECT insurance, COUNT(*) AS patients, {COST} FROM medical WHERE insurance IS NOT NULL GROUP BY insurance",
    ("medical", "high_cost_patients"): f"SELECT patient_id, diagnosis, {_r('cost', 'cost')}, length_of_stay FROM medical WHERE cost > 10000 ORDER BY medical.cost DESC, patient_id, diagnosis, length_of_stay LIMIT {LIMIT}",
    ("medical", "common_medications"): f"SELECT medication, COUNT(*) AS prescriptions, {COST} FROM medical WHERE medication IS NOT NULL GROUP BY medication ORDER BY prescriptions DESC, medication LIMIT {LIMIT}",
    ("medical", "readmission_risk"): f"SELECT patient_id, diagnosis, COUNT(*) AS visits, {_r('SUM(cost)', 'total_cost')} FROM medical GROUP BY patient_id, diagnosis HAVING COUNT(*) > 1",
    ("financial", "top_holdings"): f"SELECT symbol, {_r('SUM(quantity)', 'total_qty')}, {_r('SUM(total_value)', 'total_value')} FROM financial WHERE type = 'buy' GROUP BY symbol ORDER BY SUM(financial.total_value) DESC, symbol LIMIT {LIMIT}",
    ("financial", "by_sector"): f"SELECT sector, COUNT(*) AS transactions, {_r('SUM(total_value)', 'total_value')} FROM financial WHERE sector IS NOT NULL GROUP BY sector",
    ("financial", "daily_volume"): f"SELECT date, COUNT(*) AS transactions, {_r('SUM(total_value)', 'volume')} FROM financial GROUP BY date",
    ("financial", "profitable_trades"): f"SELECT symbol, {_r('SUM(profit_loss)', 'total_profit')} FROM financial WHERE type = 'sell' GROUP BY symbol ORDER BY SUM(profit_loss) DESC, symbol LIMIT {LIMIT}",
    ("financial", "portfolio_summary"): f"SELECT symbol, type, {_r('SUM(quantity)', 'qty')}, {_r('AVG(price)', 'avg_price')} FROM financial GROUP BY symbol, type",
    ("financial", "broker_comparison"): f"SELECT broker, COUNT(*) AS trades, {_r('SUM(total_value)', 'volume')}, {_r('AVG(fee)', 'avg_fee')} FROM financial WHERE broker IS NOT NULL GROUP BY broker",
    ("financial", "monthly_performance"): f"SELECT strftime(date, '%Y-%m') AS month, type, {_r('SUM(total_value)', 'total')} FROM financial GROUP BY month, type",
    ("financial", "high_value_transactions"): f"SELECT transaction_id, symbol, type, total_value, date FROM financial WHERE total_value > 10000 ORDER BY total_value DESC, transaction_id, symbol, type, date LIMIT {LIMIT}",
}


def _register(number: int, dataset: str, pattern: str, sql: str) -> None:
    view, view_sql = VIEWS[dataset]

    @query(f"n{number:02d}_{dataset}_{pattern}", views.with_views(view_sql, then=sql))
    def run(spark, sf_dir):
        return rounded(patterns.run_pattern(view(spark, sf_dir), presets.PRESETS[dataset], pattern, LIMIT))


for _i, ((_dataset, _pattern), _sql) in enumerate(TWINS.items(), start=1):
    _register(_i, _dataset, _pattern, _sql)


# ---------------------------------------------------------------- declarations


@query(
    "c20_typed_cast",
    """SELECT event_id, CAST(ROUND_EVEN(value, 0) AS INTEGER) AS value_int, CAST(ts AS DATE) AS ts_date,
       TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""",
)
def typed_cast(spark, sf_dir):
    declared = specs.DatasetSpec("casts", columns=[
        specs.ColumnSpec("event_id", "bigint"), specs.ColumnSpec("value_int", "integer"),
        specs.ColumnSpec("ts_date", "date"), specs.ColumnSpec("k", "float"),
    ])
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.col("value").cast("string").alias("value_int"), F.col("ts").alias("ts_date"),
        F.get_json_object("props", "$.k").alias("k"),
    )
    return specs.cast_by_spec(events, declared)


@query(
    "c21_drop_missing_required",
    views.with_views(
        views.DIRTY_SQL,
        then="SELECT order_id, price, payment_method FROM dirty WHERE order_id IS NOT NULL AND price IS NOT NULL AND payment_method IS NOT NULL",
    ),
)
def drop_missing_required(spark, sf_dir):
    declared = specs.DatasetSpec("orders", columns=[
        specs.ColumnSpec("order_id", "integer"), specs.ColumnSpec("price", "string"),
        specs.ColumnSpec("payment_method", "string"), specs.ColumnSpec("notes", "string", is_required=False),
    ])
    kept = specs.drop_missing_required(views.dirty(spark, sf_dir), declared)
    return kept.select("order_id", "price", "payment_method")


@query(
    "c22_keep_positive",
    views.with_views(views.DIRTY_SQL, then="SELECT order_id, quantity, skewed_value FROM dirty WHERE quantity > 0 AND skewed_value > 0"),
)
def keep_positive(spark, sf_dir):
    declared = specs.DatasetSpec("orders", cleaning_rules={"positive_values": ["quantity", "skewed_value"]})
    return specs.keep_positive(views.dirty(spark, sf_dir), declared).select("order_id", "quantity", "skewed_value")


@query(
    "c23_calculated_columns_sales",
    views.with_views(views.SALES_SQL, then="SELECT product, date, quantity, ROUND(total_revenue, 4) AS total_revenue FROM sales"),
)
def calculated_sales(spark, sf_dir):
    return rounded(views.sales(spark, sf_dir).select("product", "date", "quantity", "total_revenue"))


@query(
    "c23_calculated_columns_news",
    views.with_views(
        views.NEWS_SQL,
        then="SELECT title, engagement_score, ROUND(reading_time_minutes, 4) AS reading_time_minutes FROM news",
    ),
)
def calculated_news(spark, sf_dir):
    return rounded(views.news(spark, sf_dir).select("title", "engagement_score", "reading_time_minutes"))


@query(
    "c23_calculated_columns_medical",
    views.with_views(
        views.MEDICAL_SQL,
        then="SELECT patient_id, admission_date, length_of_stay, age_group, cost_category FROM medical",
    ),
)
def calculated_medical(spark, sf_dir):
    return views.medical(spark, sf_dir).select(
        "patient_id", "admission_date", "length_of_stay", "age_group", "cost_category"
    )


@query(
    "c23_calculated_columns_financial",
    views.with_views(
        views.FINANCIAL_SQL,
        then="SELECT transaction_id, ROUND(profit_loss, 4) AS profit_loss, ROUND(net_value, 4) AS net_value FROM financial",
    ),
)
def calculated_financial(spark, sf_dir):
    return rounded(views.financial(spark, sf_dir).select("transaction_id", "profit_loss", "net_value"))


def _violation_sql(view: str, checks: list[tuple[str, str, str]], unique: str | None = None) -> str:
    parts = [
        f"SELECT '{c}' AS column_name, '{rule}' AS rule, CAST(COUNT(*) FILTER (WHERE {broken}) AS BIGINT) AS violations FROM {view}"
        for c, rule, broken in checks
    ]
    if unique:
        parts.append(
            f"SELECT '{unique}', 'unique', CAST(COALESCE(SUM(n), 0) AS BIGINT) FROM "
            f"(SELECT COUNT(*) AS n FROM {view} WHERE {unique} IS NOT NULL GROUP BY {unique} HAVING COUNT(*) > 1) t"
        )
    return " UNION ALL ".join(parts)


def _required(spec: specs.DatasetSpec) -> list[tuple[str, str, str]]:
    return [(c.name, "required", f"{c.name} IS NULL") for c in spec.columns if c.is_required]


CHECKS = {
    "sales": ([("sales", "positive", "sales <= 0"), ("quantity", "positive", "quantity <= 0")], None),
    "news": (
        [("sentiment", "range_-1_1", "NOT sentiment BETWEEN -1 AND 1"), ("word_count", "positive", "word_count <= 0"),
         ("views", "positive", "views <= 0"), ("shares", "positive", "shares <= 0"),
         ("sentiment", "sentiment_range", "NOT sentiment BETWEEN -1 AND 1")],
        None,
    ),
    "medical": (
        [("age", "positive", "age <= 0"), ("age", "range_0_150", "NOT age BETWEEN 0 AND 150"),
         ("cost", "positive", "cost <= 0"),
         ("gender", "valid_genders", "gender NOT IN ('M', 'F', 'Male', 'Female', 'Other')"),
         ("age", "valid_age", "NOT age BETWEEN 0 AND 150")],
        "patient_id",
    ),
    "financial": (
        [("quantity", "positive", "quantity <= 0"), ("price", "positive", "price <= 0"),
         ("total_value", "positive", "total_value <= 0"),
         ("type", "valid_types", "type NOT IN ('buy', 'sell', 'transfer', 'dividend')")],
        "transaction_id",
    ),
}


def _register_checks(dataset: str) -> None:
    rules, unique = CHECKS[dataset]
    declared = presets.PRESETS[dataset]
    raw = getattr(views, f"{dataset}_view")
    sql = _violation_sql(f"{dataset}_view", _required(declared) + rules, unique)

    @query(f"c24_violations_{dataset}", views.with_views(VIEWS[dataset][1], then=sql))
    def run(spark, sf_dir):
        return specs.violations(raw(spark, sf_dir), declared)


for _dataset in CHECKS:
    _register_checks(_dataset)


@query(
    "c25_standardise",
    views.with_views(
        views.MEDICAL_SQL,
        then="""SELECT CASE gender WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' ELSE gender END AS gender,
        COUNT(*) AS patients FROM medical_view GROUP BY 1""",
    ),
)
def standardise(spark, sf_dir):
    fixed = specs.standardise(views.medical_view(spark, sf_dir), presets.MEDICAL)
    return fixed.groupBy("gender").agg(F.count(F.lit(1)).alias("patients"))


@query(
    "c28_declared_schema",
    views.with_views(
        views.MEDICAL_SQL,
        then="""SELECT 'patient_id' AS column_name, 'string' AS data_type, TRUE AS required, TRUE AS is_unique, COUNT(patient_id) AS present FROM medical_view
        UNION ALL SELECT 'age', 'int', TRUE, FALSE, COUNT(age) FROM medical_view
        UNION ALL SELECT 'discharge_date', 'date', FALSE, FALSE, COUNT(discharge_date) FROM medical_view
        UNION ALL SELECT 'cost', 'double', FALSE, FALSE, COUNT(cost) FROM medical_view""",
    ),
)
def declared_schema(spark, sf_dir):
    """The declared table's types and constraints next to what the data holds."""
    wanted = ["patient_id", "age", "discharge_date", "cost"]
    schema, unique = presets.MEDICAL.schema(), presets.MEDICAL.unique_columns()
    data = views.medical_view(spark, sf_dir)
    entries = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(schema[c].dataType.simpleString()).alias("data_type"),
            F.lit(not schema[c].nullable).alias("required"), F.lit(c in unique).alias("is_unique"),
            F.count(c).alias("present"),
        )
        for c in wanted
    ]
    return data.agg(F.array(*entries).alias("e")).select(F.inline("e"))


METRICS = {
    "sales": "product, region, CAST(SUM(quantity) AS BIGINT) AS sum_quantity, ROUND(SUM(total_revenue), 4) AS sum_total_revenue, ROUND(AVG(sales), 4) AS avg_sales, COUNT(*) AS count_all FROM sales GROUP BY product, region",
    "news": "category, source, COUNT(*) AS count_all, ROUND(AVG(sentiment), 8) AS avg_sentiment, CAST(SUM(views) AS BIGINT) AS sum_views, CAST(SUM(shares) AS BIGINT) AS sum_shares FROM news GROUP BY category, source",
    "medical": "diagnosis, department, age_group, COUNT(*) AS count_all, ROUND(AVG(cost), 4) AS avg_cost, ROUND(AVG(length_of_stay), 4) AS avg_length_of_stay FROM medical GROUP BY diagnosis, department, age_group",
    "financial": "symbol, type, sector, ROUND(SUM(total_value), 4) AS sum_total_value, ROUND(SUM(quantity), 4) AS sum_quantity, ROUND(AVG(price), 4) AS avg_price, COUNT(*) AS count_all FROM financial GROUP BY symbol, type, sector",
}


def _register_metrics(dataset: str) -> None:
    view, view_sql = VIEWS[dataset]

    @query(f"a09_declared_metrics_{dataset}", views.with_views(view_sql, then=f"SELECT {METRICS[dataset]}"))
    def run(spark, sf_dir):
        # Averages of a few two-digit numbers end in 5 at four digits, where engines round differently.
        return rounded(specs.declared_metrics(view(spark, sf_dir), presets.PRESETS[dataset]), 8 if dataset == "news" else DIGITS)


for _dataset in METRICS:
    _register_metrics(_dataset)


@query(
    "e01_declared_dataset_from_json",
    views.with_views(
        views.DIRTY_SQL,
        then="""SELECT payment_method, COUNT(*) AS orders, ROUND(SUM(skewed_value), 2) AS total FROM dirty
        WHERE order_id IS NOT NULL AND quantity > 0 GROUP BY payment_method ORDER BY total DESC NULLS LAST LIMIT 3""",
    ),
)
def declared_from_json(spark, sf_dir):
    """A spec detected from the data, extended, saved, loaded and queried by its own SQL pattern."""
    import tempfile

    data = views.dirty(spark, sf_dir)
    types = [r.asDict() for r in auto_types(column_profile(data, samples=0, dates=False)).orderBy("position").collect()]
    found = specs.spec_from_types("dirty_orders", types)
    for c in found.columns:
        c.is_required = c.name == "order_id"
    found.cleaning_rules = {"positive_values": ["quantity"]}
    found.query_patterns = {
        "by_payment": "SELECT payment_method, COUNT(*) AS orders, ROUND(SUM(skewed_value), 2) AS total FROM {table} "
        "GROUP BY payment_method ORDER BY total DESC NULLS LAST LIMIT {limit}"
    }
    with tempfile.NamedTemporaryFile(suffix=".json") as f:  # driver-side settings, read back at once
        found.save(f.name)
        loaded = specs.DatasetSpec.load(f.name)
    kept = specs.keep_positive(specs.drop_missing_required(data, loaded), loaded)
    return patterns.run_pattern(kept, loaded, "by_payment", 3)
