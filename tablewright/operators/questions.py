"""Parameterised analytical queries.

Every function aggregates on the map side before its one shuffle. Sorted
results put nulls last and break ties by the remaining columns, so that a top-k
is the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.operators.frequency import quoted

# The pattern of each trend grain.
GRAINS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def aggregate(value: str | None, how: str) -> Column:
    """SUM, AVG, COUNT, MIN, MAX or DISTINCT of a column; COUNT without a column counts rows."""
    how = how.lower()
    if value is None:
        if how != "count":
            raise ValueError(f"{how} needs a numeric column")
        return F.count(F.lit(1))
    functions = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max, "distinct": F.count_distinct}
    return functions[how](quoted(value))


def ranked(df: DataFrame, by: str, ascending: bool = False, n: int | None = None) -> DataFrame:
    """Sort by one column, nulls last, ties by the other columns; keep the first ``n``."""
    first = quoted(by).asc_nulls_last() if ascending else quoted(by).desc_nulls_last()
    ordered = df.orderBy(first, *[quoted(c).asc_nulls_last() for c in df.columns if c != by])
    return ordered if n is None else ordered.limit(n)


def period(date: str, grain: str = "year") -> Column:
    return F.date_format(quoted(date), GRAINS[grain])


# ---------------------------------------------------------------- groups


def agg_by_group(
    df: DataFrame, group: str | list[str], value: str | None = None, how: str = "sum",
    name: str = "total", n: int | None = None, ascending: bool = False,
) -> DataFrame:
    """An aggregate per group, largest first."""
    keys = [group] if isinstance(group, str) else group
    grouped = df.groupBy(*[quoted(k) for k in keys]).agg(aggregate(value, how).alias(name))
    return ranked(grouped, name, ascending, n)


def top_n_by_group(
    df: DataFrame, group: str, value: str, how: str = "sum", n: int = 10, ascending: bool = False
) -> DataFrame:
    """The n groups with the largest (or smallest) aggregate."""
    return agg_by_group(df, group, value, how, f"total_{value}", n, ascending)


def top_values(df: DataFrame, value: str, how: str = "sum", n: int = 10, ascending: bool = False) -> DataFrame:
    """The n values of a column ranked by its own aggregate."""
    return agg_by_group(df, value, value, how, "total", n, ascending)


def count_by_group(df: DataFrame, group: str, n: int | None = None, name: str = "count") -> DataFrame:
    return agg_by_group(df, group, None, "count", name, n)


def sum_and_count_by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    grouped = df.groupBy(quoted(group)).agg(F.sum(quoted(value)).alias("total"), F.count(F.lit(1)).alias("count"))
    return ranked(grouped, "total")


def frequent_groups(df: DataFrame, groups: list[str], metrics: dict[str, Column], at_least: int, by: str) -> DataFrame:
    """Groups of at least so many rows (HAVING COUNT(*) >= n)."""
    size = F.count(F.lit(1)).alias("_size")
    grouped = df.groupBy(*[quoted(g) for g in groups]).agg(size, *[m.alias(k) for k, m in metrics.items()])
    return ranked(grouped.where(F.col("_size") >= at_least).drop("_size"), by)


def distribution(df: DataFrame, group: str) -> DataFrame:
    """Count and percentage of all rows per group."""
    counts = df.groupBy(quoted(group)).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()  # reads the same shuffle as the counts
    return ranked(counts.withColumn("percentage", F.round(F.col("count") * 100.0 / total, 2)), "count")


def compare(df: DataFrame, group: str, value: str, how: str = "sum") -> DataFrame:
    return agg_by_group(df, group, value, how, "total")


def summary(df: DataFrame, group: str | None = None, value: str | None = None, how: str = "sum") -> DataFrame:
    """The default answer: groups by aggregate (20), groups by count (20), or one total."""
    if group and value:
        return agg_by_group(df, group, value, how, "total", 20)
    if group:
        return count_by_group(df, group, 20)
    if value:
        return df.agg(aggregate(value, how).alias("result"), F.count(F.lit(1)).alias("count"))
    raise ValueError("summary needs a group or a value column")


# ---------------------------------------------------------------- time


def trend(df: DataFrame, date: str, value: str, grain: str = "year", how: str = "sum") -> DataFrame:
    grouped = df.groupBy(period(date, grain).alias("period")).agg(aggregate(value, how).alias("value"))
    return grouped.orderBy(F.col("period").asc_nulls_last())


def monthly_count(df: DataFrame, date: str) -> DataFrame:
    grouped = df.groupBy(period(date, "month").alias("period")).agg(F.count(F.lit(1)).alias("count"))
    return grouped.orderBy(F.col("period").asc_nulls_last())


def monthly_sum(df: DataFrame, date: str, value: str) -> DataFrame:
    return trend(df, date, value, "month").withColumnRenamed("value", "total")


def latest(df: DataFrame, date: str, n: int = 10, columns: list[str] | None = None) -> DataFrame:
    """The n most recent rows."""
    kept = df.select(*[quoted(c) for c in columns]) if columns else df
    return ranked(kept, date, n=n)


def value_series(df: DataFrame, date: str, value: str, n: int = 10) -> DataFrame:
    """The latest n (date, value) pairs."""
    return latest(df, date, n, [date, value])


# ---------------------------------------------------------------- whole table


def totals(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.sum(quoted(value)).alias(f"total_{value}"), F.count(F.lit(1)).alias("record_count"))


def average(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(quoted(value)).alias(f"avg_{value}"))


def distinct_count(df: DataFrame, column: str, name: str = "unique_count") -> DataFrame:
    return df.agg(F.count_distinct(quoted(column)).alias(name))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_count"))


def entity_count(df: DataFrame, entity: str, group: str | None = None, name: str = "entity_count") -> DataFrame:
    """How many entities there are, or how many rows each group has."""
    if group is None:
        return distinct_count(df, entity, name)
    return count_by_group(df, group, name=name)


def revenue(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    if group is None:
        return df.agg(F.sum(quoted(value)).alias("total_revenue"))
    return agg_by_group(df, group, value)


# ---------------------------------------------------------------- rows


def top_rows(df: DataFrame, by: str, n: int = 10, ascending: bool = False) -> DataFrame:
    return ranked(df, by, ascending, n)


def distinct_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The first n distinct values in order."""
    values = df.select(quoted(column)).distinct()
    return values.orderBy(quoted(column).asc_nulls_last()).limit(n)


def first_rows(df: DataFrame, order_by: list[str], n: int = 10) -> DataFrame:
    return df.orderBy(*[quoted(c).asc_nulls_last() for c in order_by]).limit(n)
