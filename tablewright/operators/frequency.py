"""Value frequencies of many columns in one shuffle.

Exact distinct counts, modes and sample values all come from the table
(column_name, value, n). Counting is combined on the map side, so a value that
fills a third of the rows reaches the shuffle once per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Longer values are shuffled as (length, SHA-256) instead of in full.
LONG_VALUE = 128


def without_nan(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere, as null does."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(quoted(c)), quoted(c)) for c in floats})


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which none of the columns is missing; one predicate per column, so that scans can use them."""
    for c in columns:
        df = df.where(quoted(c).isNotNull())
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            df = df.where(~F.isnan(quoted(c)))
    return df


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _as_text(field: T.StructField, digest_long: bool) -> Column:
    c = quoted(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        c = F.when(c == 0, F.lit(0.0)).otherwise(c)  # -0.0 equals 0.0
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        c = F.to_json(c)
    text = c.cast("string")
    if digest_long and isinstance(field.dataType, T.StringType):
        digest = F.concat_ws(":", F.lit("sha256"), F.length(text), F.sha2(text, 256))
        text = F.when(F.length(text) > LONG_VALUE, digest).otherwise(text)
    return text.alias(field.name)


def value_frequencies(df: DataFrame, columns: list[str] | None = None, digest_long: bool = False) -> DataFrame:
    """(column_name, value, n), one row per distinct value; the null value has its own row."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    texts = df.select(*[_as_text(f, digest_long) for f in fields])
    long = texts.unpivot([], [quoted(f.name) for f in fields], "column_name", "value")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def modes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, value, n): the most frequent non-null value, smallest value on ties."""
    freq = value_frequencies(df, columns).where(F.col("value").isNotNull())
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value"))).alias("best")
    return freq.groupBy("column_name").agg(best).select(
        "column_name", F.col("best.value").alias("value"), (-F.col("best.neg")).alias("n")
    )
