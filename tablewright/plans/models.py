"""Staged models (staging, intermediate, mart), casts by schema, and data tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions import text
from tablewright.operators.frequency import complete, quoted
from tablewright.operators.ordering import number_rows
from tablewright.operators.questions import ranked
from tablewright.plans.spec import repeated, typed


def staging(df: DataFrame, roles: dict[str, list[str]], loaded_at: Column | None = None) -> DataFrame:
    """Ids, trimmed categories, rounded numbers, dates and load time; the first id is required.

    Every column that has one of these roles is kept.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    ids, categories, numbers, dates = (roles.get(role, []) for role in ("id", "categorical", "numeric", "date"))
    columns = [quoted(c) for c in ids]
    columns += [text.strip(quoted(c)).alias(c) for c in categories]
    columns += [F.round(quoted(c).cast("double"), 2).alias(c) for c in numbers]
    columns += [typed(quoted(c), kinds[c], "date").alias(c) for c in dates]
    kept = df.where(quoted(ids[0]).isNotNull()) if ids else df
    return kept.select(*columns, (loaded_at if loaded_at is not None else F.current_timestamp()).alias("_loaded_at"))


def intermediate(staged: DataFrame, group: str, metric: str) -> DataFrame:
    """Count, sum, average, minimum and maximum of the metric per group, largest sum first."""
    m = quoted(metric)
    grouped = staged.groupBy(quoted(group)).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.sum(m).alias(f"total_{metric}"),
        F.avg(m).alias(f"avg_{metric}"),
        F.min(m).alias(f"min_{metric}"),
        F.max(m).alias(f"max_{metric}"),
    )
    return ranked(grouped, f"total_{metric}")


def mart(staged: DataFrame, aggregated: DataFrame, group: str, metric: str) -> DataFrame:
    """Every staged row with the count, sum and average of its group.

    Spark broadcasts the aggregates when they turn out small; otherwise the join
    shuffles and AQE splits a group that holds a large share of the rows.
    """
    added = aggregated.select(quoted(group), "record_count", quoted(f"total_{metric}"), quoted(f"avg_{metric}"))
    return staged.join(added, group, "left")


def order_totals(sales: DataFrame, order: str = "order_id", keep: tuple[str, ...] = ("city",)) -> DataFrame:
    """total_sale = price * quantity per order."""
    total = F.sum(quoted("price") * quoted("quantity")).alias("total_sale")
    return sales.groupBy(quoted(order), *[quoted(c) for c in keep]).agg(total)


def sales_by_city(totals: DataFrame, order: str = "order_id", city: str = "city") -> DataFrame:
    """Distinct orders, revenue and revenue per order of each city."""
    grouped = totals.groupBy(quoted(city)).agg(
        F.count_distinct(quoted(order)).alias("total_orders"), F.sum("total_sale").alias("total_revenue")
    )
    average = F.try_divide(F.col("total_revenue"), F.col("total_orders"))
    return ranked(grouped.withColumn("average_order_value", average), "total_revenue")


def cast_by_schema(
    df: DataFrame, columns: list[dict], stamped: bool = False, loaded_at: Column | None = None
) -> DataFrame:
    """Cast by profile: integers and counts, measures, dates; ids and names must not be null.

    ``stamped`` is the model form: it adds ``transformed_at`` and requires only
    the key columns that have no nulls.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out, required = [], []
    for col in columns:
        name, kind, meaning = col["column_name"], col["type"].lower(), col["semantic"]
        c = quoted(name)
        if "int" in kind or meaning == "count":
            c = typed(c, kinds[name], "integer")
        elif "double" in kind or "float" in kind or meaning in ("money", "percentage", "score"):
            c = typed(c, kinds[name], "float")
        elif meaning == "datetime" or "date" in kind:
            c = typed(c, kinds[name], "date")
        out.append(c.alias(name))
        if meaning in ("id", "name") and not (stamped and col.get("nullable", True)):
            required.append(name)
    kept = complete(df, required)
    if stamped:
        out.append((loaded_at if loaded_at is not None else F.current_timestamp()).alias("transformed_at"))
    return kept.select(*out)


def with_processing_columns(df: DataFrame, order_by: list[str], processed_at: Column | None = None) -> DataFrame:
    """Add ``_processed_at`` and consecutive ``_record_id``."""
    stamp = processed_at if processed_at is not None else F.current_timestamp()
    return number_rows(df, order_by).withColumn("_processed_at", stamp)


def data_tests(models: dict[str, DataFrame], tests: list[tuple[str, str, str]]) -> DataFrame:
    """(model, column_name, test, failures, passed) for (model, column, 'unique' | 'not_null') tests."""
    parts = []
    nulls: dict[str, list[str]] = {}
    for model, column, test in tests:
        if test == "unique":
            parts.append(
                repeated(models[model], column).select(
                    F.lit(model).alias("model"), F.lit(column).alias("column_name"), F.lit(test).alias("test"),
                    F.col("violations").alias("failures"),
                )
            )
        elif test == "not_null":
            nulls.setdefault(model, []).append(column)
        else:
            raise ValueError(f"unknown test: {test}")
    for model, columns in nulls.items():
        entries = [
            F.struct(
                F.lit(model).alias("model"), F.lit(c).alias("column_name"), F.lit("not_null").alias("test"),
                F.count_if(quoted(c).isNull()).alias("failures"),
            )
            for c in columns
        ]
        parts.append(models[model].agg(F.array(*entries).alias("e")).select(F.inline("e")))
    found = reduce(DataFrame.unionByName, parts)
    return found.withColumn("passed", F.col("failures") == 0)


def model_tests(roles: dict[str, list[str]]) -> list[tuple[str, str, str]]:
    """The tests of a standard model set: a unique key and a complete group column."""
    key, group = roles["id"][0], roles["categorical"][0]
    return [
        ("staging", key, "unique"),
        ("staging", key, "not_null"),
        ("staging", group, "not_null"),
        ("intermediate", group, "unique"),
        ("intermediate", group, "not_null"),
    ]
