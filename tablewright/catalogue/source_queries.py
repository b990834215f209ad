"""Sources and sinks: what is written is read back and compared with the given table."""

from __future__ import annotations

import datetime
import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark.sql import Observation, functions as F, types as T

from tablewright.catalogue import views
from tablewright.catalogue.registry import query, table
from tablewright.catalogue.report_queries import _ALL
from tablewright.durable import scratch_path
from tablewright.sources import files, naming, tables, workbooks
from tablewright.streaming import landing

ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


# ---------------------------------------------------------------- CSV and JSON


def ragged_csv(spark, sf_dir) -> str:
    """Orders as CSV lines: some too short, some too long, the rest with a quoted comma."""
    key = F.col("o_orderkey").cast("string")
    price, priority = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.col("o_orderpriority")
    line = (
        F.when(F.col("o_orderstatus") == "F", F.concat_ws(",", key, price))
        .when(priority == "5-LOW", F.concat_ws(",", key, price, priority, F.lit("surplus")))
        .otherwise(F.concat(key, F.lit(","), price, F.lit(',"'), priority, F.lit(', then"')))
    )
    path = scratch_path(spark, "ragged")
    table(spark, sf_dir, "orders").select(line.alias("line")).write.text(path)
    return path


RAGGED = "order_id bigint, price double, priority string"
RAGGED_SQL = """SELECT o_orderkey AS order_id, o_totalprice AS price,
    CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority || ', then' END AS priority
    FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority <> '5-LOW'"""


@query("s01_robust_csv_scan", RAGGED_SQL)
def robust_csv_scan(spark, sf_dir):
    return files.read_csv_robust(spark, ragged_csv(spark, sf_dir), RAGGED, header=False)


@query(
    "s02_sampled_csv_scan",
    f"SELECT LEAST(2000, COUNT(*)) AS sampled, TRUE AS typed FROM ({RAGGED_SQL}) t",
)
def sampled_csv_scan(spark, sf_dir):
    sample = files.sample_csv(spark, ragged_csv(spark, sf_dir), RAGGED, header=False)
    return sample.agg(F.count(F.lit(1)).alias("sampled"), (F.count("price") == F.count(F.lit(1))).alias("typed"))


# Every seventh line has a surplus field that is empty; it is one field too many all the same.
_REJECTS = "o_orderkey % 7 = 0 OR o_orderpriority = '5-LOW'"


@query(
    "s01_rejected_rows",
    f"""SELECT CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 7 = 0 THEN ',x,' ELSE ',"a, b",x,y' END AS line,
    (SELECT COUNT(*) FROM orders WHERE {_REJECTS}) AS rejected, (SELECT COUNT(*) FROM orders WHERE NOT ({_REJECTS})) AS kept
    FROM orders WHERE {_REJECTS}""",
)
def rejected_rows(spark, sf_dir):
    """The lines that a CSV read leaves out, and how many it left out and kept, counted by the job that writes the kept ones."""
    key = F.col("o_orderkey")
    line = (
        F.when(key % 7 == 0, F.concat(key.cast("string"), F.lit(",x,")))
        .when(F.col("o_orderpriority") == "5-LOW", F.concat(key.cast("string"), F.lit(',"a, b",x,y')))
        .when(key % 2 == 0, key.cast("string"))
        .otherwise(F.concat(key.cast("string"), F.lit(',"c, ""d"""')))
    )
    path, counted = scratch_path(spark, "surplus"), Observation()
    table(spark, sf_dir, "orders").select(line.alias("line")).write.text(path)
    kept, rejected = files.read_csv_with_rejects(spark, path, "order_id bigint, note string", header=False, counted=counted)
    tables.replace_files(kept, scratch_path(spark, "kept"))
    found = counted.get
    return rejected.select("line", F.lit(found["rejected"]).cast("long").alias("rejected"), F.lit(found["kept"]).cast("long").alias("kept"))


@query("s03_json_scan", "SELECT page_id, url, md5(html) AS digest FROM pages")
def json_scan(spark, sf_dir):
    path = scratch_path(spark, "pages_json")
    files.export_json(table(spark, sf_dir, "pages"), path)
    read = files.read_json_records(spark, path, "page_id bigint, url string, html string", lines=True)
    return read.select("page_id", "url", F.md5("html").alias("digest"))


@query("s07_csv_export", views.with_views(views.DIRTY_SQL, then="SELECT * FROM dirty"))
def csv_export(spark, sf_dir):
    """Nulls, blanks and commas survive the way out and back."""
    df = views.dirty(spark, sf_dir)
    path = scratch_path(spark, "dirty_csv")
    files.export_csv(df, path)
    return files.read_csv_robust(spark, path, df.schema)


@query("s08_json_export", "SELECT doc_id, md5(text) AS digest, lang FROM documents")
def json_export(spark, sf_dir):
    path = scratch_path(spark, "documents_json")
    files.export_json(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    read = files.read_json_records(spark, path, "doc_id bigint, text string, lang string", lines=True)
    return read.select("doc_id", F.md5("text").alias("digest"), "lang")


# ---------------------------------------------------------------- workbooks

_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


_DAY_ZERO = datetime.date(1899, 12, 30)
# The second style shows a date, by a format of its own.
_STYLES = (
    f'<styleSheet xmlns="{_MAIN}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts>'
    '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>'
)


def _sheet_xml(rows: list[list]) -> str:
    out = []
    for i, row in enumerate(rows, start=1):
        cells = []
        for j, value in enumerate(row):
            at = f"{chr(ord('A') + j)}{i}"
            if isinstance(value, str):
                cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>')
            elif isinstance(value, datetime.date):
                cells.append(f'<c r="{at}" s="1"><v>{(value - _DAY_ZERO).days}</v></c>')
            elif value is not None:
                cells.append(f'<c r="{at}"><v>{value!r}</v></c>')
        out.append(f'<row r="{i}">{"".join(cells)}</row>')
    return f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(out)}</sheetData></worksheet>'


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A minimal .xlsx file."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        related = "".join(
            f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>'
            for i in range(1, len(sheets) + 1)
        )
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{related}</Relationships>',
        )
        book.writestr("xl/styles.xml", _STYLES)
        for i, rows in enumerate(sheets.values(), start=1):
            book.writestr(f"xl/worksheets/sheet{i}.xml", _sheet_xml(rows))
    return buffer.getvalue()


CUSTOMER_HEADER = ["Customer-Key", "Full Name", "Balance ($)"]


def _workbooks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = batch.astype(object).values.tolist()
        title = ["customer export", None, None]
        content = workbook_bytes({"Notes": [["see Data"]], "Data": [title, CUSTOMER_HEADER, *rows]})
        yield pd.DataFrame({"workbook": [f"customers-{rows[0][0]}.xlsx"], "content": [content]})


@query(
    "s04_workbook_scan",
    "SELECT c_custkey AS customer_key, c_name AS full_name, c_acctbal AS balance FROM customer",
)
def workbook_scan(spark, sf_dir):
    """Customers as one workbook per batch, found again on their second sheet below a title row."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    books = customers.mapInPandas(_workbooks, "workbook string, content binary")
    rows = workbooks.parse_workbooks(books, sheet="Data", skip_rows=1)
    found = workbooks.sheet_table(rows, CUSTOMER_HEADER)
    return found.select(
        F.col("customer_key").cast("bigint").alias("customer_key"), "full_name", F.col("balance").cast("double").alias("balance")
    )


def _written_books(folder: str):
    """Customers as workbook files, every other one with its columns in another order; one row for each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        for batch in batches:
            for i in range(0, len(batch), 400):
                rows = batch.iloc[i : i + 400].astype(object).values.tolist()
                header = ["Customer-Key", "Full Name", "Balance ($)", "Since"]
                if rows[0][0] // 100 % 2:
                    header, rows = ["Since", *header[:3]], [[r[3], *r[:3]] for r in rows]
                name = f"customers-{uuid.uuid4().hex}.xlsx"
                with store.open_output_stream(f"{place}/{name}") as out:
                    out.write(workbook_bytes({"Data": [header, *rows]}))
                yield pd.DataFrame({"name": [name]})

    return run


@query(
    "s04_workbook_folder",
    """SELECT c_custkey AS customer_key, c_name AS full_name, c_acctbal AS balance,
    CAST(DATE '2020-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS TIMESTAMP) AS since FROM customer""",
)
def workbook_folder(spark, sf_dir):
    """A folder of workbooks with two orders of columns, read by their own headers with numbers and dates typed."""
    folder = scratch_path(spark, "workbooks")
    since = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 1000).cast("int"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", since.alias("since"))
    customers.mapInPandas(_written_books(folder if "://" in folder else f"file://{folder}"), "name string").count()
    return workbooks.folder_table(workbooks.read_workbooks(spark, folder)).drop("workbook", "sheet")


# ---------------------------------------------------------------- tables


@query(
    "s05_replace_table",
    "SELECT o_orderstatus, COUNT(*) AS orders FROM orders GROUP BY o_orderstatus",
)
def replace_table(spark, sf_dir):
    """The second write replaces the first."""
    orders, path = table(spark, sf_dir, "orders"), scratch_path(spark, "replaced")
    tables.replace_files(orders.groupBy("o_orderpriority").count(), path)
    return tables.replace_files(orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders")), path)


@query(
    "s05_replace_self",
    """SELECT o_orderkey, o_orderstatus, COUNT(*) OVER (PARTITION BY o_orderstatus) AS peers FROM orders WHERE o_orderstatus <> 'F'""",
)
def replace_self(spark, sf_dir):
    """A catalog table replaced twice by queries that read it, with the same columns and with other ones."""
    path = scratch_path(spark, "replaced")
    name = "replaced_" + path.rsplit("-", 1)[-1]
    now = tables.replace_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), name, path)
    now = tables.replace_table(now.where("o_orderstatus <> 'F'"), name, path)
    peers = now.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("peers"))
    now = tables.replace_table(now.join(peers, "o_orderstatus").select("o_orderkey", "o_orderstatus", "peers"), name, path)
    found = spark.read.schema(now.schema).parquet(*now.inputFiles())
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return found


@query("s06_create_table_if_absent", f"SELECT {ORDERS} FROM orders")
def create_table_if_absent(spark, sf_dir):
    """An empty table is created once, filled, and left alone the second time."""
    orders, path = table(spark, sf_dir, "orders"), scratch_path(spark, "created")
    name = "created_" + path.rsplit("-", 1)[-1]
    tables.create_table_if_absent(spark, name, orders.schema, path)
    orders.write.mode("append").format("parquet").insertInto(name)
    tables.create_table_if_absent(spark, name, orders.schema, path)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return spark.read.schema(orders.schema).parquet(path)


_LISTED = {
    "region": "r_regionkey,r_name", "orders": ORDERS.replace(" ", ""),
    "labels": "doc_id,quality,toxic", "events": "event_id,ts,user_id,event_type,value,props",
}


@query(
    "s09_catalog_listing",
    " UNION ALL ".join(
        f"SELECT 'given_{t}' AS name, COUNT(*) AS row_count, {len(c.split(','))} AS column_count, '{c}' AS columns FROM {t}"
        for t, c in _LISTED.items()
    ),
)
def catalog_listing(spark, sf_dir):
    for t in _LISTED:
        table(spark, sf_dir, t).createOrReplaceTempView(f"given_{t}")
    return tables.list_tables(spark, pattern="given_*")


_ORDER_TYPES = ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"]


@query(
    "s10_describe_table",
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, COUNT(*) AS row_count FROM orders"
        for i, (c, t) in enumerate(zip(ORDERS.split(", "), _ORDER_TYPES))
    ),
)
def describe_table(spark, sf_dir):
    return tables.describe(table(spark, sf_dir, "orders"))


@query(
    "s10_describe_with_samples",
    " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, COUNT(*) AS row_count,
        (SELECT list({f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if t == "timestamp_ntz" else f"CAST({c} AS VARCHAR)"} ORDER BY o_orderkey)
         FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 3) t) AS sample_values FROM orders"""
        for i, (c, t) in enumerate(zip(ORDERS.split(", "), ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"]))
        if c != "o_totalprice"
    ),
)
def describe_samples(spark, sf_dir):
    found = tables.describe_with_samples(table(spark, sf_dir, "orders"), ["o_orderkey"])
    return found.where("column_name <> 'o_totalprice'")  # engines write doubles in their own ways


@query("s11_preview", "SELECT * FROM customer ORDER BY c_custkey LIMIT 20")
def preview(spark, sf_dir):
    return tables.preview(table(spark, sf_dir, "customer"), 20, ["c_custkey"])


@query("s11_page_with_default_limit", "SELECT * FROM customer ORDER BY c_custkey LIMIT 100")
def page(spark, sf_dir):
    return tables.page(table(spark, sf_dir, "customer"), ["c_custkey"])


@query(
    "s12_tagged_union",
    """SELECT c_name AS name, c_acctbal AS acctbal, c_mktsegment AS mktsegment, 'customers' AS _source_sheet FROM customer
    UNION ALL SELECT s_name, s_acctbal, NULL, 'suppliers' FROM supplier""",
)
def tagged_union(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("mktsegment")
    )
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("acctbal"), F.col("s_name").alias("name"))
    return files.union_tagged({"customers": customers, "suppliers": suppliers})


@query(
    "s13_normalised_columns",
    "SELECT p_partkey AS part_key, p_name AS name_of_part, p_size AS size, p_brand AS size_2, p_retailprice AS unnamed_column FROM part",
)
def normalised_columns(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand", "p_retailprice")
    return naming.normalise_columns(part.toDF(" Part-Key ", "Name  of__Part", "Size!", "size", "($)"))


@query("s14_available_columns", "SELECT o_orderkey, o_orderstatus, 'colour' AS missing FROM orders")
def available_columns(spark, sf_dir):
    found, missing = files.project_available(table(spark, sf_dir, "orders"), ["o_orderkey", "colour", "o_orderstatus"])
    return found.withColumn("missing", F.lit(",".join(missing)))


@query(
    "s15_stage_names",
    " UNION ALL ".join(
        f"SELECT '{t}_raw' AS raw_table, '{t}_clean' AS clean_table, COUNT(*) AS row_count FROM {t}" for t in _ALL
    ),
)
def stage_names(spark, sf_dir):
    parts = []
    for t in _ALL:
        raw, clean = naming.stage_names(f"{sf_dir}/{t}_clean.parquet")
        counted = table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("row_count"))
        parts.append(counted.select(F.lit(raw).alias("raw_table"), F.lit(clean).alias("clean_table"), "row_count"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---------------------------------------------------------------- streaming


@query("s16_incremental_ingest", f"SELECT {ORDERS} FROM orders")
def incremental_ingest(spark, sf_dir):
    """Two runs over the same folder: the second finds nothing new."""
    schema: T.StructType = table(spark, sf_dir, "orders").schema
    target, checkpoint = scratch_path(spark, "landed"), scratch_path(spark, "landed-state")
    for _ in range(2):
        landed = landing.ingest_stream(spark, sf_dir, target, checkpoint, schema, glob="orders.parquet")
    return landed.drop("_source_file")
