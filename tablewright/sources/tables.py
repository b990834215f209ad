"""Catalog tables: replace, create, list, describe, preview."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tablewright.operators.frequency import quoted
from tablewright.sources.naming import is_identifier

SAMPLE_LIMIT = 1000
PAGE_LIMIT = 10_000
DEFAULT_PAGE = 100


def checked(name: str) -> str:
    if not is_identifier(name):
        raise ValueError(f"invalid table name: {name!r}")
    return name


def replace_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Materialise ``df`` as a catalog table, replacing any earlier one; ``df`` may read the table itself.

    The rows are written to a fresh folder below ``path`` (or beside the warehouse's tables) first, then the catalog
    points to it: a failed write leaves the old table as it was. Earlier folders stay for readers that still use them
    and for the store's own retention.
    """
    spark, name = df.sparkSession, checked(name)
    root = path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}_versions"
    staged = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(staged)
    if spark.catalog.tableExists(name) and _same_shape(spark.table(name).schema, df.schema):
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{staged}'")
        spark.catalog.refreshTable(name)
    else:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.catalog.createTable(name, path=staged, source="parquet", schema=df.schema)
    return spark.table(name)


def _same_shape(a: T.StructType, b: T.StructType) -> bool:
    return [(f.name, f.dataType) for f in a.fields] == [(f.name, f.dataType) for f in b.fields]


def replace_files(df: DataFrame, path: str) -> DataFrame:
    """Materialise ``df`` as Parquet files and read them back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def create_table_if_absent(spark: SparkSession, name: str, schema: T.StructType, path: str | None = None) -> DataFrame:
    """An empty typed table, unless one of that name exists already."""
    if not spark.catalog.tableExists(checked(name)):
        writer = spark.createDataFrame([], schema).write.mode("ignore").format("parquet")
        (writer.option("path", path) if path else writer).saveAsTable(name)
    return spark.table(name)


def catalog_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, row_count, column_count, columns) of each table, in one job."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("name"),
            "row_count",
            F.lit(len(df.columns)).alias("column_count"),
            F.lit(",".join(df.columns)).alias("columns"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def list_tables(spark: SparkSession, database: str | None = None, pattern: str | None = None) -> DataFrame:
    """The catalog's tables and views with their size."""
    listed = spark.catalog.listTables(database, pattern)
    names = [t.name for t in listed if is_identifier(t.name)]
    return catalog_summary({n: spark.table(f"{database}.{n}" if database else n) for n in names})


def describe(df: DataFrame) -> DataFrame:
    """(position, column_name, data_type, row_count) for each column."""
    columns = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(F.inline(F.array(*columns)), "row_count")


def describe_with_samples(df: DataFrame, order_by: list[str], rows: int = 3) -> DataFrame:
    """``describe`` with ``sample_values``: each column's values in the first rows, nulls as null."""
    some = _first(df, rows, order_by)
    values = [F.struct(F.lit(i).alias("position"), quoted(c).cast("string").alias("value")) for i, c in enumerate(df.columns)]
    numbered = some.select(F.row_number().over(Window.orderBy(*[quoted(c).asc_nulls_last() for c in order_by])).alias("n"), F.explode(F.array(*values)).alias("v"))
    gathered = numbered.groupBy(F.col("v.position").alias("position")).agg(F.sort_array(F.collect_list(F.struct("n", "v.value"))).alias("s"))
    samples = gathered.select("position", F.transform("s", lambda x: x["value"]).alias("sample_values"))
    return describe(df).join(samples, "position", "left").withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))


def _first(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    return df.orderBy(*[quoted(c).asc_nulls_last() for c in order_by]).limit(n)


def preview(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first ``n`` rows; between 1 and 1000 or an error."""
    if not 1 <= n <= SAMPLE_LIMIT:
        raise ValueError(f"limit must be between 1 and {SAMPLE_LIMIT}")
    return _first(df, n, order_by)


def page(df: DataFrame, order_by: list[str], n: int = DEFAULT_PAGE) -> DataFrame:
    """The first ``n`` rows; between 1 and 10000 or an error."""
    if not 1 <= n <= PAGE_LIMIT:
        raise ValueError(f"limit must be between 1 and {PAGE_LIMIT}")
    return _first(df, n, order_by)
