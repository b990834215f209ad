"""Cleaning operators on the dirty orders view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalogue import views
from tablewright.catalogue.profile_queries import (
    DATE_SQL, STRIPPED, dirty_profile, messy_number_sql, number_sql, profile_of,
)
from tablewright.catalogue.registry import query, rounded, table
from tablewright.functions import parse, text
from tablewright.operators import clean as c, ordering
from tablewright.plans import models

WORDS = ["twenty one", "forty", "Thirty-Five"]
GENDER_SQL = """CASE lower({s}) WHEN 'f' THEN 'Female' WHEN 'female' THEN 'Female' WHEN 'm' THEN 'Male' WHEN 'male' THEN 'Male'
  WHEN 'other' THEN 'Other' WHEN 'non-binary' THEN 'Other' WHEN 'nonbinary' THEN 'Other' WHEN 'nb' THEN 'Other' ELSE {c} END"""


def dirty_sql(then: str) -> str:
    return views.with_views(views.DIRTY_SQL, then=then)


def stripped(name: str) -> str:
    return STRIPPED.format(c=name)


# ---------------------------------------------------------------- values


@query("c01_trim", dirty_sql(f"SELECT order_id, {stripped('customer_name')} AS customer_name, {stripped('gender')} AS gender FROM dirty"))
def trim(spark, sf_dir):
    df = c.apply_plan(views.dirty(spark, sf_dir), {"customer_name": ["trim"], "gender": ["trim"]})
    return df.select("order_id", "customer_name", "gender")


@query("c02_lowercase", "SELECT doc_id, md5(lower(text)) AS digest, lower(source) AS source FROM documents")
def lowercase(spark, sf_dir):
    docs = c.apply_plan(table(spark, sf_dir, "documents"), {"text": ["lowercase"], "source": ["lowercase"]})
    return docs.select("doc_id", F.md5("text").alias("digest"), "source")


@query("c03_blank_to_null", dirty_sql(f"SELECT order_id, NULLIF({stripped('customer_name')}, '') AS customer_name FROM dirty"))
def blank_to_null(spark, sf_dir):
    df = c.apply_plan(views.dirty(spark, sf_dir), {"customer_name": ["normalize_empty_to_null"]})
    return df.select("order_id", "customer_name")


@query(
    "c04_parse_numeric",
    dirty_sql(f"SELECT order_id, {messy_number_sql('price')} AS price, {messy_number_sql('age')} AS age, quantity FROM dirty"),
)
def parse_numeric(spark, sf_dir):
    plan = {k: ["normalize_empty_to_null", "parse_numeric"] for k in ("price", "age", "quantity")}
    return c.apply_plan(views.dirty(spark, sf_dir), plan).select("order_id", "price", "age", "quantity")


@query(
    "c05_number_words",
    dirty_sql("""SELECT order_id, CASE age WHEN 'twenty one' THEN '21' WHEN 'forty' THEN '40' WHEN 'Thirty-Five' THEN '35' ELSE age END AS age FROM dirty"""),
)
def number_words(spark, sf_dir):
    return views.dirty(spark, sf_dir).select("order_id", text.number_words(F.col("age")).alias("age"))


@query("c06_parse_date", dirty_sql(f"SELECT order_id, {DATE_SQL.format(c='order_date')} AS order_date FROM dirty"))
def parse_date(spark, sf_dir):
    return c.apply_plan(views.dirty(spark, sf_dir), {"order_date": ["parse_date"]}).select("order_id", "order_date")


@query("c07_drop_incomplete_rows", dirty_sql("SELECT order_id, payment_method FROM dirty WHERE order_id IS NOT NULL AND payment_method IS NOT NULL"))
def drop_incomplete_rows(spark, sf_dir):
    return c.drop_incomplete_rows(views.dirty(spark, sf_dir), ["order_id", "payment_method"]).select("order_id", "payment_method")


@query(
    "c08_canonical_labels",
    dirty_sql(f"SELECT gender, COUNT(*) AS orders FROM (SELECT {GENDER_SQL.format(s=stripped('gender'), c='gender')} AS gender FROM dirty) t GROUP BY gender"),
)
def canonical_labels(spark, sf_dir):
    df = c.canonicalise(views.dirty(spark, sf_dir), {"gender": "category", "age": "category"})
    return df.groupBy("gender").agg(F.count(F.lit(1)).alias("orders"))


# ---------------------------------------------------------------- plans

_PLAN_SQL = """SELECT column_name, CASE
  WHEN type IN ('int64', 'float64') OR semantic IN ('money', 'count', 'score', 'percentage') THEN 'normalize_empty_to_null,parse_numeric'
  WHEN semantic = 'datetime' THEN 'trim,normalize_empty_to_null,parse_date'
  ELSE 'trim,normalize_empty_to_null' END || CASE WHEN semantic IN ('id', 'name') THEN ',drop_row_if_null' ELSE '' END AS operations, null_count FROM profile"""


@query("c09_heuristic_plan", profile_of(_PLAN_SQL))
def heuristic_plan(spark, sf_dir):
    found = [r.asDict() for r in dirty_profile(spark, sf_dir).collect()]  # one row per column
    plan = c.heuristic_plan(found)
    rows = [(r["column_name"], ",".join(plan[r["column_name"]]), r["null_count"]) for r in found]
    return spark.createDataFrame(rows, "column_name string, operations string, null_count long")


@query(
    "c10_validated_plan",
    dirty_sql(f"SELECT order_id, lower({stripped('gender')}) AS gender, payment_method FROM dirty"),
)
def validated_plan(spark, sf_dir):
    """Unknown columns and operations of a given plan have no effect."""
    df = views.dirty(spark, sf_dir)
    given = {
        "gender": ["trim", "explode", "lowercase", "trim"], "nowhere": ["trim"], "payment_method": ["reverse"],
    }
    return c.apply_plan(df, c.validated_plan(given, df.columns)).select("order_id", "gender", "payment_method")


# ---------------------------------------------------------------- imputation


def typical_sql(x: str) -> str:
    return f"CASE WHEN abs(SKEWNESS({x})) > 1 THEN MEDIAN({x}) ELSE AVG({x}) END"


def imputed(spark, sf_dir, *columns, semantics=None, **kwargs):
    df = views.dirty(spark, sf_dir).select("order_id", *columns).where(F.col("order_id").isNotNull())
    return rounded(c.impute(df, semantics, **kwargs))


@query(
    "c11_impute_numeric",
    dirty_sql(f"""SELECT order_id, ROUND(COALESCE(quantity, (SELECT {typical_sql('quantity')} FROM dirty WHERE order_id IS NOT NULL)), 4) AS quantity,
    ROUND(COALESCE(skewed_value, (SELECT {typical_sql('skewed_value')} FROM dirty WHERE order_id IS NOT NULL)), 4) AS skewed_value FROM dirty WHERE order_id IS NOT NULL"""),
)
def impute_numeric(spark, sf_dir):
    return imputed(spark, sf_dir, "quantity", "skewed_value")


def coerced_sql(name: str, expr: str, fill: str | None = None) -> str:
    fill = fill or typical_sql("v")
    return dirty_sql(
        f"""SELECT order_id, ROUND(COALESCE(v, (SELECT {fill} FROM (SELECT {expr} AS v FROM dirty WHERE order_id IS NOT NULL) s)), 4) AS {name}
        FROM (SELECT order_id, {expr} AS v FROM dirty WHERE order_id IS NOT NULL) t"""
    )


@query("c12_impute_coerced_by_intent", coerced_sql("age", messy_number_sql("age")))
def impute_by_intent(spark, sf_dir):
    return imputed(spark, sf_dir, "age")


_PLAIN = "CASE WHEN order_id % 9 <> 0 THEN customer_name END"


@query("c12_impute_coerced_plain", coerced_sql("reference_no", number_sql(f"({_PLAIN})")))
def impute_plain_numbers(spark, sf_dir):
    """Text that is numeric in at least 85 % of its values."""
    df = views.dirty(spark, sf_dir).where(F.col("order_id").isNotNull())
    known = F.when(F.col("order_id") % 9 != 0, F.col("customer_name"))
    return rounded(c.impute(df.select("order_id", known.alias("reference_no"))))


_FILLED = """COALESCE(LAST_VALUE({d} IGNORE NULLS) OVER (PARTITION BY {g} ORDER BY order_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  FIRST_VALUE({d} IGNORE NULLS) OVER (PARTITION BY {g} ORDER BY order_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query(
    "c13_fill_dates_in_order",
    dirty_sql(f"""SELECT order_id, {_FILLED.format(d='d', g='1')} AS order_date
    FROM (SELECT order_id, {DATE_SQL.format(c='order_date')} AS d FROM dirty WHERE order_id IS NOT NULL) t"""),
)
def fill_dates(spark, sf_dir):
    return imputed(spark, sf_dir, "order_date", order_by=["order_id"])


@query(
    "c13_fill_dates_by_group",
    dirty_sql(f"""SELECT order_id, payment_method, {_FILLED.format(d='d', g='payment_method')} AS order_date
    FROM (SELECT order_id, payment_method, {DATE_SQL.format(c='order_date')} AS d FROM dirty WHERE order_id IS NOT NULL) t"""),
)
def fill_dates_by_group(spark, sf_dir):
    df = views.dirty(spark, sf_dir).where(F.col("order_id").isNotNull())
    parsed = df.select("order_id", "payment_method", parse.parse_timestamp(F.col("order_date")).alias("order_date"))
    return ordering.forward_backward_fill(parsed, ["order_date"], ["order_id"], ["payment_method"])


_RARE = """CASE WHEN payment_method = '5-LOW' AND order_id % 2 = 0 THEN CAST(order_id AS VARCHAR)
  WHEN payment_method IS NULL THEN NULL ELSE 'x' END"""


@query("c14_numeric_intent_fallback", coerced_sql("item_count", messy_number_sql(f"({_RARE})"), "MEDIAN(v)"))
def numeric_intent_fallback(spark, sf_dir):
    """A column named like a number in which fewer than a fifth of the values are numbers."""
    df = views.dirty(spark, sf_dir).where(F.col("order_id").isNotNull())
    rare = F.when(
        (F.col("payment_method") == "5-LOW") & (F.col("order_id") % 2 == 0), F.col("order_id").cast("string")
    ).when(F.col("payment_method").isNotNull(), "x")
    return rounded(c.impute(df.select("order_id", rare.alias("item_count"))))


@query(
    "c15_impute_category",
    dirty_sql("""SELECT order_id, COALESCE(payment_method, (SELECT payment_method FROM dirty WHERE payment_method IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)) AS payment_method,
    'Unknown' AS empty FROM dirty WHERE order_id IS NOT NULL"""),
)
def impute_category(spark, sf_dir):
    df = views.dirty(spark, sf_dir).where(F.col("order_id").isNotNull())
    return c.impute(df.select("order_id", "payment_method", F.lit(None).cast("string").alias("empty")))


# Ids above 2^53 that lie one apart, a fifth of them missing. Every known one must survive a fill.
_EXACT_SQL = dirty_sql("""SELECT order_id, CASE WHEN order_id % 5 <> 0 THEN CAST(9007199254740992 + order_id AS VARCHAR) END AS known,
  true AS filled FROM dirty WHERE order_id IS NOT NULL""")


def exact(spark, sf_dir, kind):
    df = views.dirty(spark, sf_dir).where(F.col("order_id").isNotNull())
    known = F.when(F.col("order_id") % 5 != 0, (F.lit(9007199254740992) + F.col("order_id")).cast(kind))
    done = c.impute(df.select("order_id", known.alias("exact")))
    shown = F.when(F.col("order_id") % 5 != 0, F.col("exact").cast("string"))
    return done.select("order_id", shown.alias("known"), F.col("exact").isNotNull().alias("filled"))


@query("c11_impute_bigint", _EXACT_SQL)
def impute_bigint(spark, sf_dir):
    return exact(spark, sf_dir, "bigint")


@query("c11_impute_decimal", _EXACT_SQL)
def impute_decimal(spark, sf_dir):
    return exact(spark, sf_dir, "decimal(20,0)")


# The same as text; the fill is the median, which a few large ones keep away from the mean.
_DIGITS_SQL = """(SELECT CASE WHEN order_id % 5 <> 0 THEN CAST(9007199254740993 + CASE WHEN order_id % 97 = 1 THEN 1000000000000000 + order_id ELSE order_id % 4 END AS VARCHAR) END AS digits
  FROM dirty WHERE order_id IS NOT NULL)"""


@query(
    "c12_impute_digit_text",
    dirty_sql(f"""SELECT COALESCE(CAST(digits AS BIGINT), (SELECT CAST(round_even(median(CAST(digits AS DOUBLE)), 0) AS BIGINT) FROM {_DIGITS_SQL} t)) AS digits, COUNT(*) AS n
    FROM {_DIGITS_SQL} t GROUP BY 1"""),
)
def impute_digit_text(spark, sf_dir):
    """Digits beyond what doubles tell apart become whole numbers; every distinct value stays."""
    df = views.dirty(spark, sf_dir).where(F.col("order_id").isNotNull())
    order_id = F.col("order_id")
    value = F.lit(9007199254740993) + F.when(order_id % 97 == 1, 1000000000000000 + order_id).otherwise(order_id % 4)
    done = c.impute(df.select(F.when(order_id % 5 != 0, value.cast("string")).alias("digits")))
    return done.groupBy("digits").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- rows


@query("c17_drop_empty_rows", dirty_sql(f"SELECT * FROM dirty WHERE NOT ({' AND '.join(f'{n} IS NULL' for n in views.DIRTY_COLUMNS)})"))
def drop_empty_rows(spark, sf_dir):
    return c.drop_empty_rows(views.dirty(spark, sf_dir))


@query("c18_drop_repeated_rows", dirty_sql("SELECT DISTINCT * FROM dirty"))
def drop_repeated_rows(spark, sf_dir):
    return c.drop_repeated_rows(views.dirty(spark, sf_dir))


# ---------------------------------------------------------------- the whole run

# The plan's effect, value by value.
STAGED_SQL = f"""staged AS (SELECT order_id,
  {number_sql('customer_name')} AS customer_name,
  {GENDER_SQL.format(s=stripped('gender'), c=f"NULLIF({stripped('gender')}, '')")} AS gender,
  {messy_number_sql('age')} AS age, {messy_number_sql('price')} AS price, quantity, skewed_value,
  {DATE_SQL.format(c='order_date')} AS order_date, payment_method, notes FROM dirty WHERE order_id IS NOT NULL
), fills AS (SELECT {', '.join(f'{typical_sql(n)} AS {n}' for n in ('customer_name', 'age', 'price', 'quantity', 'skewed_value'))},
  (SELECT gender FROM staged WHERE gender IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) AS gender,
  (SELECT payment_method FROM staged WHERE payment_method IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) AS payment_method FROM staged
), filled AS (SELECT s.order_id, {', '.join(f'COALESCE(s.{n}, f.{n}) AS {n}' for n in ('customer_name', 'gender', 'age', 'price', 'quantity', 'skewed_value', 'payment_method'))},
  s.order_date, s.notes FROM staged s, fills f
), cleaned AS (SELECT DISTINCT order_id, customer_name, gender, age, price, quantity, skewed_value,
  {_FILLED.format(d='order_date', g='1')} AS order_date, payment_method, notes FROM filled)"""


def cleaned_sql(then: str) -> str:
    return f"WITH {views.DIRTY_SQL}, {STAGED_SQL} {then}"


_ROUNDED = ", ".join(
    f"ROUND({n}, 4) AS {n}" if n in ("customer_name", "age", "price", "quantity", "skewed_value") else n
    for n in views.DIRTY_COLUMNS
)


@query("c19_cleaned_table", cleaned_sql(f"SELECT {_ROUNDED} FROM cleaned"))
def cleaned_table(spark, sf_dir):
    return rounded(c.clean(views.dirty(spark, sf_dir), order_by=["order_id"]).data)


# Fixed steps of this view: column, operations, fill strategy. Counts come from the data.
_STEPS = [
    ("order_id", "normalize_empty_to_null,parse_numeric,drop_row_if_null", None),
    ("customer_name", "trim,normalize_empty_to_null", "numeric_coerce"),
    ("gender", "trim,normalize_empty_to_null", "mode"),
    ("age", "trim,normalize_empty_to_null", "numeric_coerce"),
    ("price", "normalize_empty_to_null,parse_numeric", "center"),
    ("quantity", "normalize_empty_to_null,parse_numeric", "mean"),
    ("skewed_value", "normalize_empty_to_null,parse_numeric", "median"),
    ("order_date", "trim,normalize_empty_to_null,parse_date", "forward_backward_fill"),
    ("payment_method", "trim,normalize_empty_to_null", "mode"),
    ("notes", "trim,normalize_empty_to_null", "skipped_low_priority_high_missing"),
]
# What the plan leaves missing in rows that have an id. Coercion to numbers comes after it.
_LEFT = {
    n: f"(SELECT COUNT(*) FROM dirty WHERE order_id IS NOT NULL AND {e} IS NULL)"
    for n, e in {
        **{n: n for n in views.DIRTY_COLUMNS},
        "customer_name": f"NULLIF({stripped('customer_name')}, '')",
        "price": messy_number_sql("price"),
        "order_date": DATE_SQL.format(c="order_date"),
    }.items()
}


def _strategy(name: str, strategy: str) -> str:
    if strategy not in ("numeric_coerce", "center"):
        return f"'{strategy}'"
    prefix = "numeric_coerce_" if strategy == "numeric_coerce" else ""
    return f"(SELECT CASE WHEN abs(SKEWNESS({name})) > 1 THEN '{prefix}median' ELSE '{prefix}mean' END FROM staged)"


# The id has no fill, so the other columns' steps begin at 1.
_LOG_SQL = " UNION ALL ".join(
    f"""SELECT {max(2 * i - 1, 0)} AS step, '{n}' AS column_name, 'preclean' AS operation, '{ops}' AS strategy,
      (SELECT COUNT(*) FROM dirty WHERE {n} IS NULL) AS missing_before, {_LEFT[n]} AS missing_after, CAST(NULL AS BIGINT) AS rows_removed"""
    + (f""" UNION ALL SELECT {2 * i}, '{n}', 'missing_value_imputation', {_strategy(n, s)}, {_LEFT[n]},
      {_LEFT[n] if s.startswith('skipped') else 0}, NULL""" if s else "")
    for i, (n, ops, s) in enumerate(_STEPS)
)


@query(
    "c19_cleaning_log",
    cleaned_sql(f"""{_LOG_SQL} UNION ALL SELECT 19, NULL, 'row_removal', 'all_columns_null', NULL, NULL,
    (SELECT COUNT(*) FROM dirty WHERE order_id IS NULL) UNION ALL SELECT 21, NULL, 'deduplicate', 'deduplicate', NULL, NULL,
    (SELECT COUNT(*) FROM staged) - (SELECT COUNT(*) FROM cleaned)"""),
)
def cleaning_log(spark, sf_dir):
    return c.clean(views.dirty(spark, sf_dir), order_by=["order_id"]).log.drop("fill_preview")


@query(
    "c19_row_counts",
    cleaned_sql("""SELECT (SELECT COUNT(*) FROM dirty) AS original_count, COUNT(*) AS row_count,
    (SELECT COUNT(*) FROM dirty) - COUNT(*) AS rows_removed FROM (SELECT DISTINCT * FROM dirty) t"""),
)
def row_counts(spark, sf_dir):
    df = views.dirty(spark, sf_dir)
    return c.row_counts(df, c.drop_repeated_rows(df))


@query(
    "c16_fill_strategies",
    cleaned_sql(" UNION ALL ".join(
        f"SELECT '{n}' AS column_name, {_strategy(n, s)} AS strategy, {_LEFT[n]} AS missing" for n, _, s in _STEPS if s
    )),
)
def fill_strategies(spark, sf_dir):
    """Which fill every column gets; a mostly empty unimportant column is left alone."""
    found = c.clean(views.dirty(spark, sf_dir), order_by=["order_id"]).choices
    rows = [(x.column, x.strategy, x.missing) for x in found]
    return spark.createDataFrame(rows, "column_name string, strategy string, missing long")


# ---------------------------------------------------------------- casts and numbering


@query(
    "c26_cast_by_schema",
    dirty_sql(f"""SELECT CAST(order_id AS INTEGER) AS order_id, customer_name, gender, age,
    {number_sql('price')} AS price, CAST(quantity AS INTEGER) AS quantity, CAST(ROUND_EVEN(skewed_value, 0) AS INTEGER) AS skewed_value,
    CAST({DATE_SQL.format(c='order_date')} AS DATE) AS order_date, payment_method, notes FROM dirty WHERE order_id IS NOT NULL"""),
)
def cast_by_schema(spark, sf_dir):
    found = [r.asDict() for r in dirty_profile(spark, sf_dir).orderBy("position").collect()]
    return models.cast_by_schema(views.dirty(spark, sf_dir), found)


@query(
    "c26_cast_by_schema_stamped",
    dirty_sql(f"""SELECT CAST(order_id AS INTEGER) AS order_id, {number_sql('price')} AS price,
    CAST({DATE_SQL.format(c='order_date')} AS DATE) AS order_date, TIMESTAMP '2024-03-01 00:00:00' AS transformed_at FROM dirty"""),
)
def cast_stamped(spark, sf_dir):
    """The model form keeps rows whose key column has nulls, and adds the load time."""
    found = [
        r.asDict() for r in dirty_profile(spark, sf_dir).orderBy("position").collect()
        if r["column_name"] in ("order_id", "price", "order_date")
    ]
    stamp = F.lit(views.TODAY).cast("timestamp_ntz")
    return models.cast_by_schema(views.dirty(spark, sf_dir), found, stamped=True, loaded_at=stamp)


_BASIC = ", ".join(
    f"NULLIF({stripped(n)}, 'nan') AS {n}" if n in views.DIRTY_TEXT else n for n in views.DIRTY_COLUMNS
)


@query(
    "c27_basic_clean_numbered",
    dirty_sql(f"""SELECT *, ROW_NUMBER() OVER (ORDER BY order_id) AS _record_id, TIMESTAMP '2024-03-01 00:00:00' AS _processed_at
    FROM (SELECT {_BASIC} FROM (SELECT DISTINCT * FROM dirty) d WHERE order_id IS NOT NULL) t"""),
)
def basic_clean_numbered(spark, sf_dir):
    cleaned = c.basic_clean(views.dirty(spark, sf_dir))
    return models.with_processing_columns(cleaned, ["order_id"], F.lit(views.TODAY).cast("timestamp_ntz"))
