"""CSV and JSON in and out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from tablewright.operators.frequency import quoted

PROFILE_ROWS = 2000
_SURPLUS = "_surplus"
# A quote inside quotes is doubled, as most tools write it.
QUOTE = '"'


def infer_csv_schema(spark: SparkSession, path: str, sampling_ratio: float = 1.0) -> T.StructType:
    """Column names from the header, types inferred over the given share of the file."""
    reader = spark.read.option("header", True).option("inferSchema", True).option("escape", QUOTE)
    return reader.option("samplingRatio", sampling_ratio).csv(path).schema


def read_csv_robust(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    sampling_ratio: float = 1.0,
    header: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """Read CSV, skipping rows that have too many fields.

    Short rows are kept and padded with nulls. One extra text column catches
    the surplus; values that do not fit their type become null, and so do empty
    fields, quoted or not. ``multi_line``
    allows line breaks inside quotes, at the price of one task per file.
    """
    if schema is None:
        schema = infer_csv_schema(spark, path, sampling_ratio)
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    wide = T.StructType([*schema.fields, T.StructField(_SURPLUS, T.StringType())])
    reader = spark.read.schema(wide).option("header", header).option("multiLine", multi_line)
    raw = reader.option("escape", QUOTE).csv(path)
    return raw.where(F.col(_SURPLUS).isNull()).drop(_SURPLUS)


_RAW = "_raw"


def read_csv_with_rejects(
    spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, counted: Observation | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines) of a CSV source; a line is rejected when it has too many fields, empty ones included.

    ``counted`` observes both over the rows that a job reads: ``kept`` and ``rejected``, so that the count costs no
    scan of its own. The rejected lines come as ``line`` with their ``file``. Rows are those of ``read_csv_robust``, but
    for lines with surplus empty fields only, which it keeps.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    # Lines of another number of fields come with their text, which tells short ones from long ones.
    wide = T.StructType([*schema.fields, T.StructField(_RAW, T.StringType())])
    reader = spark.read.schema(wide).option("header", header).option("columnNameOfCorruptRecord", _RAW)
    raw = reader.option("escape", QUOTE).csv(path)
    bare = F.regexp_replace(_RAW, '"([^"]|"")*"', "")
    surplus = F.coalesce(F.length(bare) - F.length(F.replace(bare, F.lit(","))) >= len(schema.fields), F.lit(False))
    # Fields are only counted where all are read, so the test reads them; hashes are never less than this.
    surplus = surplus & (F.hash(*[quoted(f.name) for f in schema.fields]) >= F.lit(-(1 << 31)))
    marked = raw.withColumn("_rejected", surplus).withColumn("_file", F.input_file_name())
    if counted is not None:
        marked = marked.observe(counted, F.count_if(~F.col("_rejected")).alias("kept"), F.count_if("_rejected").alias("rejected"))
    rejected = marked.where("_rejected").select(F.col("_file").alias("file"), F.col(_RAW).alias("line"))
    return marked.where(~F.col("_rejected")).select(*[quoted(f.name) for f in schema.fields]), rejected


def sample_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, rows: int = PROFILE_ROWS, header: bool = True
) -> DataFrame:
    """The first rows of a file, for a quick look at its shape."""
    return read_csv_robust(spark, path, schema, header=header).limit(rows)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = False) -> DataFrame:
    """JSON records: an array per file, or one object per line.

    Only the line form can be split, so prefer it for large files.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("multiLine", not lines).json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and white space kept; nulls as empty fields, empty strings quoted."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", QUOTE)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, null fields included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_table_file(spark: SparkSession, path: str) -> DataFrame:
    """Read a CSV, JSON or Parquet source by its ending."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_csv_robust(spark, path)
    if kind == "json":
        return read_json_records(spark, path)
    if kind in ("jsonl", "ndjson"):
        return read_json_records(spark, path, lines=True)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file format: {path}")


def union_tagged(parts: dict[str, DataFrame], tag: str = "_source_sheet") -> DataFrame:
    """All parts under one another, missing columns null, with the part's name as a column."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def project_available(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """The wanted columns that exist (all when none do), and the names of the others."""
    available = [c for c in columns if c in df.columns]
    missing = [c for c in columns if c not in df.columns]
    return (df.select(*[quoted(c) for c in available]) if available else df), missing
