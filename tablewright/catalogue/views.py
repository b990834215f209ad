"""Datasets of the declared shapes, derived from the given tables.

Each view exists as a DataFrame and as the SQL its oracle reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.catalogue.registry import table
from tablewright.plans import presets, spec as specs

TODAY = "2024-03-01"


# ---------------------------------------------------------------- sales

SALES_SQL = """
sales_view AS (
SELECT p.p_name AS product, r.r_name AS region, CAST(o.o_orderdate AS DATE) AS date,
  l.l_extendedprice / l.l_quantity AS sales, CAST(l.l_quantity AS INTEGER) AS quantity
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN part p ON l.l_partkey = p.p_partkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
), sales AS (
SELECT *, sales * quantity AS total_revenue FROM sales_view WHERE sales > 0 AND quantity > 0
)"""


def sales_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, orders, part, customer, nation, region = (
        table(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "customer", "nation", "region")
    )
    # Customers and their regions first: a narrow table joined once to the orders.
    where = (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select("c_custkey", F.col("r_name").alias("region"))
    )
    return (
        lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
        .join(part, lineitem.l_partkey == part.p_partkey)
        .join(where, orders.o_custkey == where.c_custkey)
        .select(
            F.col("p_name").alias("product"),
            "region",
            F.col("o_orderdate").cast("date").alias("date"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("sales"),
            F.col("l_quantity").cast("int").alias("quantity"),
        )
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.transform(sales_view(spark, sf_dir), presets.SALES)


# ---------------------------------------------------------------- news

NEWS_SQL = """
news_view AS (
SELECT CONCAT(source, '/', CAST(doc_id AS STRING)) AS title, source, lang AS category,
  DATE '2024-01-01' + CAST(doc_id % 90 AS INT) AS published_date,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CONCAT('author', CAST(doc_id % 37 AS STRING)) END AS author,
  text AS content, ((doc_id * 37) % 201 - 100) / CAST(100 AS DOUBLE) AS sentiment,
  CAST(FLOOR(n_chars / CAST(5 AS DOUBLE)) AS INTEGER) AS word_count,
  CAST((doc_id * 7919) % 5000 AS INTEGER) AS views, CAST((doc_id * 104729) % 2500 AS INTEGER) AS shares
FROM documents
), news AS (
SELECT *, views + shares * 2 AS engagement_score, word_count / 200 AS reading_time_minutes FROM news_view
WHERE title IS NOT NULL AND source IS NOT NULL AND category IS NOT NULL AND content IS NOT NULL
)"""


def news_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), doc.cast("string")).alias("title"),
        "source",
        F.col("lang").alias("category"),
        F.date_add(F.lit("2024-01-01").cast("date"), (doc % 90).cast("int")).alias("published_date"),
        F.when(doc % 5 != 0, F.concat(F.lit("author"), (doc % 37).cast("string"))).alias("author"),
        F.col("text").alias("content"),
        (((doc * 37) % 201 - 100) / F.lit(100.0)).alias("sentiment"),
        F.floor(F.col("n_chars") / F.lit(5.0)).cast("int").alias("word_count"),
        ((doc * 7919) % 5000).cast("int").alias("views"),
        ((doc * 104729) % 2500).cast("int").alias("shares"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.transform(news_view(spark, sf_dir), presets.NEWS)


# ---------------------------------------------------------------- medical

MEDICAL_SQL = f"""
medical_view AS (
SELECT CONCAT('P', CAST(user_id AS STRING)) AS patient_id, CAST(user_id % 100 AS INTEGER) AS age,
  CASE user_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'Other' END AS gender, event_type AS diagnosis,
  CONCAT('dept', CAST(event_id % 7 AS STRING)) AS department, CAST(ts AS DATE) AS admission_date,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(ts AS DATE) + CAST(event_id % 15 AS INT) END AS discharge_date,
  CASE WHEN event_id % 8 = 0 THEN NULL ELSE CONCAT('treat', CAST(event_id % 4 AS STRING)) END AS treatment,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE CONCAT('med', CAST(event_id % 11 AS STRING)) END AS medication,
  value * 40 AS cost,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE CONCAT('ins', CAST(user_id % 5 AS STRING)) END AS insurance,
  CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'recovered' ELSE 'ongoing' END AS outcome
FROM events
), medical AS (
SELECT *, CAST(COALESCE(discharge_date, DATE '{TODAY}') - admission_date AS INTEGER) AS length_of_stay,
  CASE WHEN age < 18 THEN 'Child' WHEN age < 65 THEN 'Adult' ELSE 'Senior' END AS age_group,
  CASE WHEN cost < 1000 THEN 'Low' WHEN cost < 10000 THEN 'Medium' ELSE 'High' END AS cost_category
FROM medical_view WHERE cost > 0
)"""


def medical_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    event, user, day = F.col("event_id"), F.col("user_id"), F.col("ts").cast("date")

    def labelled(prefix: str, number: Column) -> Column:
        return F.concat(F.lit(prefix), number.cast("string"))

    return table(spark, sf_dir, "events").select(
        labelled("P", user).alias("patient_id"),
        (user % 100).cast("int").alias("age"),
        F.when(user % 3 == 0, "M").when(user % 3 == 1, "F").otherwise("Other").alias("gender"),
        F.col("event_type").alias("diagnosis"),
        labelled("dept", event % 7).alias("department"),
        day.alias("admission_date"),
        F.when(event % 6 != 0, F.date_add(day, (event % 15).cast("int"))).alias("discharge_date"),
        F.when(event % 8 != 0, labelled("treat", event % 4)).alias("treatment"),
        F.when(event % 4 != 0, labelled("med", event % 11)).alias("medication"),
        (F.col("value") * 40).alias("cost"),
        F.when(event % 10 != 0, labelled("ins", user % 5)).alias("insurance"),
        F.when(event % 9 == 0, None).when(event % 2 == 0, "recovered").otherwise("ongoing").alias("outcome"),
    )


def medical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.transform(medical_view(spark, sf_dir), presets.MEDICAL, TODAY)


# ---------------------------------------------------------------- financial

FINANCIAL_SQL = """
financial_view AS (
SELECT CONCAT(CAST(l.l_orderkey AS STRING), '-', CAST(l.l_linenumber AS STRING)) AS transaction_id,
  CAST(l.l_shipdate AS DATE) AS date,
  CASE l.l_returnflag WHEN 'A' THEN 'buy' WHEN 'R' THEN 'sell' ELSE 'transfer' END AS type,
  p.p_brand AS symbol, l.l_quantity AS quantity, l.l_extendedprice / l.l_quantity AS price,
  l.l_extendedprice AS total_value,
  CASE WHEN l.l_linenumber = 7 THEN NULL ELSE l.l_extendedprice * l.l_tax END AS fee,
  CAST(o.o_custkey AS STRING) AS account,
  CASE WHEN l.l_suppkey % 9 = 0 THEN NULL ELSE s.s_name END AS broker,
  CASE WHEN p.p_size % 10 = 0 THEN NULL ELSE p.p_type END AS sector, l.l_linestatus AS exchange
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
), financial AS (
SELECT *, CASE WHEN type = 'sell' THEN total_value - fee ELSE 0 END AS profit_loss,
  total_value - COALESCE(fee, 0) AS net_value
FROM financial_view WHERE quantity > 0 AND price > 0 AND total_value > 0
)"""


def financial_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, orders, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "supplier"))
    flag = F.col("l_returnflag")
    return (
        lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
        .join(part, lineitem.l_partkey == part.p_partkey)
        .join(supplier, lineitem.l_suppkey == supplier.s_suppkey)
        .select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("transaction_id"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.when(flag == "A", "buy").when(flag == "R", "sell").otherwise("transfer").alias("type"),
            F.col("p_brand").alias("symbol"),
            F.col("l_quantity").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_extendedprice").alias("total_value"),
            F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") * F.col("l_tax")).alias("fee"),
            F.col("o_custkey").cast("string").alias("account"),
            F.when(F.col("l_suppkey") % 9 != 0, F.col("s_name")).alias("broker"),
            F.when(F.col("p_size") % 10 != 0, F.col("p_type")).alias("sector"),
            F.col("l_linestatus").alias("exchange"),
        )
    )


def financial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.transform(financial_view(spark, sf_dir), presets.FINANCIAL)


# ---------------------------------------------------------------- dirty orders

DIRTY_SQL = """
dirty_base AS (
SELECT o_orderstatus,
  o_orderkey AS order_id,
  CASE WHEN o_orderkey % 13 = 0 THEN '   ' WHEN o_orderkey % 3 = 0 THEN CONCAT('  ', CAST(o_custkey AS STRING), ' ') ELSE CAST(o_custkey AS STRING) END AS customer_name,
  CASE o_orderkey % 6 WHEN 0 THEN 'f' WHEN 1 THEN 'Male' WHEN 2 THEN 'NB' WHEN 3 THEN ' FEMALE ' WHEN 4 THEN NULL ELSE 'unknown' END AS gender,
  CASE o_orderkey % 7 WHEN 0 THEN 'twenty one' WHEN 1 THEN 'forty' WHEN 2 THEN 'Thirty-Five' WHEN 3 THEN NULL WHEN 4 THEN 'n/a' ELSE CAST(o_custkey % 90 AS STRING) END AS age,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 'N/A' WHEN o_orderkey % 4 = 0 THEN CONCAT('$1,', CAST(100 + o_custkey % 900 AS STRING), '.50 USD') ELSE CAST(o_custkey % 500 AS STRING) END AS price,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 10 AS DOUBLE) END AS quantity,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 100 = 1 THEN o_totalprice * 50 ELSE o_totalprice END AS skewed_value,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 'bad date' WHEN o_orderkey % 3 = 0 THEN CONCAT(SUBSTRING(CAST(o_orderdate AS STRING), 6, 2), '/', SUBSTRING(CAST(o_orderdate AS STRING), 9, 2), '/', SUBSTRING(CAST(o_orderdate AS STRING), 1, 4)) ELSE SUBSTRING(CAST(o_orderdate AS STRING), 1, 10) END AS order_date,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS payment_method,
  CASE WHEN o_orderkey % 20 = 0 THEN 'x' ELSE NULL END AS notes
FROM orders
), dirty AS (
SELECT * EXCLUDE (o_orderstatus) FROM dirty_base
UNION ALL SELECT * EXCLUDE (o_orderstatus) FROM dirty_base WHERE o_orderstatus = 'P'
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM region
)"""

DIRTY_TEXT = ["customer_name", "gender", "age", "price", "order_date", "payment_method", "notes"]
DIRTY_NUMBERS = ["order_id", "quantity", "skewed_value"]
DIRTY_COLUMNS = [
    "order_id", "customer_name", "gender", "age", "price", "quantity", "skewed_value", "order_date",
    "payment_method", "notes",
]


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with blanks, mixed formats and gaps, a third of them twice, and all-null rows."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    day = F.col("o_orderdate").cast("date")
    iso, american = F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "MM/dd/yyyy")
    copies = F.when(F.col("o_orderstatus") == "P", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    orders = table(spark, sf_dir, "orders").withColumn("copy", F.explode(copies))
    rows = orders.select(
        key.alias("order_id"),
        F.when(key % 13 == 0, "   ")
        .when(key % 3 == 0, F.concat(F.lit("  "), cust.cast("string"), F.lit(" ")))
        .otherwise(cust.cast("string")).alias("customer_name"),
        F.when(key % 6 == 0, "f").when(key % 6 == 1, "Male").when(key % 6 == 2, "NB")
        .when(key % 6 == 3, " FEMALE ").when(key % 6 == 4, None).otherwise("unknown").alias("gender"),
        F.when(key % 7 == 0, "twenty one").when(key % 7 == 1, "forty").when(key % 7 == 2, "Thirty-Five")
        .when(key % 7 == 3, None).when(key % 7 == 4, "n/a").otherwise((cust % 90).cast("string")).alias("age"),
        F.when(key % 11 == 0, None).when(key % 17 == 0, "N/A")
        .when(key % 4 == 0, F.concat(F.lit("$1,"), (100 + cust % 900).cast("string"), F.lit(".50 USD")))
        .otherwise((cust % 500).cast("string")).alias("price"),
        F.when(key % 7 != 0, (key % 10).cast("double")).alias("quantity"),
        F.when(key % 9 == 0, None).when(key % 100 == 1, F.col("o_totalprice") * 50)
        .otherwise(F.col("o_totalprice")).alias("skewed_value"),
        F.when(key % 8 == 0, None).when(key % 19 == 0, "bad date").when(key % 3 == 0, american)
        .otherwise(iso).alias("order_date"),
        F.when(key % 5 != 0, F.col("o_orderpriority")).alias("payment_method"),
        F.when(key % 20 == 0, "x").alias("notes"),
    )
    empty = table(spark, sf_dir, "region").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    return rows.unionByName(empty)


# ---------------------------------------------------------------- commands, statements, questions

COMMANDS_SQL = """
commands AS (
SELECT conv_id, turn, CASE (conv_id + turn) % 12
  WHEN 0 THEN 'Upload the file ' WHEN 1 THEN 'analyze ' WHEN 2 THEN 'Show top ' || CAST(turn + 3 AS STRING) || ' of '
  WHEN 3 THEN 'clean the data in ' WHEN 4 THEN 'run ETL over ' WHEN 5 THEN 'create report for '
  WHEN 6 THEN 'describe ' WHEN 7 THEN 'download ' WHEN 8 THEN 'first  ' || CAST(conv_id % 40 AS STRING) || ' rows of '
  WHEN 9 THEN 'the best of ' WHEN 10 THEN 'top three sector results in ' ELSE '' END || text AS command
FROM conversations
)"""


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation text, most of them behind a command."""
    conv, turn = F.col("conv_id"), F.col("turn")
    starts = [
        F.lit("Upload the file "), F.lit("analyze "),
        F.concat(F.lit("Show top "), (turn + 3).cast("string"), F.lit(" of ")),
        F.lit("clean the data in "), F.lit("run ETL over "), F.lit("create report for "), F.lit("describe "),
        F.lit("download "), F.concat(F.lit("first  "), (conv % 40).cast("string"), F.lit(" rows of ")),
        F.lit("the best of "), F.lit("top three sector results in "),
    ]
    start = F.lit("")
    for i, s in reversed(list(enumerate(starts))):
        start = F.when((conv + turn) % 12 == i, s).otherwise(start)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(start, "text").alias("command"))


STATEMENTS_SQL = """
statements AS (
SELECT event_id, CASE event_id % 14
  WHEN 0 THEN 'drop  table ' || event_type WHEN 1 THEN 'DELETE FROM ' || event_type
  WHEN 2 THEN 'truncate ' || event_type WHEN 3 THEN 'ALTER TABLE ' || event_type || ' ADD x INT'
  WHEN 4 THEN 'create database ' || event_type WHEN 5 THEN 'GRANT ALL TO u' || CAST(user_id AS STRING)
  WHEN 6 THEN 'revoke all' WHEN 7 THEN 'ATTACH ''' || event_type || ''''
  WHEN 8 THEN 'COPY t FROM ''http://x/' || event_type || '''' WHEN 9 THEN 'SELECT 1; SELECT ' || CAST(user_id AS STRING)
  WHEN 10 THEN 'INSERT INTO t VALUES (''' || props || ''')' WHEN 11 THEN 'SELECT dropped FROM ' || event_type
  WHEN 12 THEN 'update t set a = 1' ELSE 'SELECT ' || event_type || ' FROM t WHERE k = ''' || props || '''' END AS statement
FROM events
)"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SQL statement per event, harmless or not."""
    kind, user, props, q = F.col("event_type"), F.col("user_id").cast("string"), F.col("props"), F.lit("'")
    texts = [
        F.concat(F.lit("drop  table "), kind), F.concat(F.lit("DELETE FROM "), kind), F.concat(F.lit("truncate "), kind),
        F.concat(F.lit("ALTER TABLE "), kind, F.lit(" ADD x INT")), F.concat(F.lit("create database "), kind),
        F.concat(F.lit("GRANT ALL TO u"), user), F.lit("revoke all"), F.concat(F.lit("ATTACH '"), kind, q),
        F.concat(F.lit("COPY t FROM 'http://x/"), kind, q), F.concat(F.lit("SELECT 1; SELECT "), user),
        F.concat(F.lit("INSERT INTO t VALUES ('"), props, F.lit("')")), F.concat(F.lit("SELECT dropped FROM "), kind),
        F.lit("update t set a = 1"),
    ]
    text = F.concat(F.lit("SELECT "), kind, F.lit(" FROM t WHERE k = '"), props, q)
    for i, t in reversed(list(enumerate(texts))):
        text = F.when(F.col("event_id") % 14 == i, t).otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", text.alias("statement"))


def with_views(*views: str, then: str) -> str:
    """A query over one or more of the views above."""
    return f"WITH {','.join(views)} {then}"
