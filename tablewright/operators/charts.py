"""Grouped reports and the tables behind charts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions import parse
from tablewright.functions.measures import varies
from tablewright.operators.frequency import quoted, without_nan
from tablewright.operators.profile import correlations, is_numeric, type_label, typed_view
from tablewright.operators.questions import ranked

BAR_GROUPS = 12
PIE_GROUPS = 8
VIEW_PIE_GROUPS = 6
BINS = 12
PERIODS = 12
DASHBOARD_GROUPS = 10
COUNT = "__count__"

# Fixed value: edges are widened by this share of the range, as histogram bins are right-closed.
EDGE_SHARE = 0.001


# ---------------------------------------------------------------- reports


def report_columns(df: DataFrame, roles: dict[str, list[str]], exclude_ids: bool = True) -> tuple[str | None, str | None]:
    """(group column, value column) of a report, from the real types first and the roles second."""
    ids = set(roles.get("id", [])) if exclude_ids else set()
    numbers = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    numbers = [c for c in numbers if c not in ids] or [c for c in roles.get("numeric", []) if c in df.columns]
    groups = [c for c in roles.get("categorical", []) if c in df.columns and c not in numbers]
    if not groups:
        groups = [
            f.name
            for f in df.schema.fields
            if type_label(f.dataType) not in ("int64", "float64", "datetime64") and f.name not in ids
        ]
    return (groups or [None])[0], (numbers or [None])[0]


def group_report(df: DataFrame, group: str | None = None, value: str | None = None) -> DataFrame:
    """Count, sum, rounded average, minimum and maximum, per group or for the whole table."""
    metrics = [F.count(F.lit(1)).alias("record_count")]
    if value is not None:
        v = quoted(value)
        metrics += [
            F.sum(v).alias(f"total_{value}"),
            F.round(F.avg(v), 2).alias(f"avg_{value}"),
            F.min(v).alias(f"min_{value}"),
            F.max(v).alias(f"max_{value}"),
        ]
    if group is None:
        return df.agg(*metrics)
    grouped = df.groupBy(quoted(group)).agg(*metrics)
    return ranked(grouped, f"total_{value}" if value else "record_count")


def short_report(df: DataFrame, group: str | None = None, value: str | None = None) -> DataFrame:
    """Count, sum and rounded average per group."""
    if group is None:
        return df.agg(F.count(F.lit(1)).alias("total_records"))
    full = group_report(df, group, value)
    return full.drop(f"min_{value}", f"max_{value}") if value else full


# ---------------------------------------------------------------- chart tables


def bar(df: DataFrame, category: str, metric: str = COUNT, n: int = BAR_GROUPS) -> DataFrame:
    """The n largest categories; rows without a category form a group, and a sum of nulls is 0."""
    value = F.count(F.lit(1)) if metric == COUNT else F.coalesce(F.sum(quoted(metric)), F.lit(0))
    grouped = df.groupBy(quoted(category).cast("string").alias("category")).agg(value.cast("double").alias("value"))
    return ranked(grouped, "value", n=n)


def pie(df: DataFrame, category: str, metric: str = COUNT, n: int = PIE_GROUPS) -> DataFrame:
    return bar(df, category, metric, n).withColumnRenamed("category", "name")


def bin_number(c: Column, low: Column, high: Column, bins: int) -> Column:
    """Right-closed bin, 1..bins, of a value between ``low`` and ``high``."""
    width = (high - low) / bins
    place = F.least(F.greatest(F.ceil(F.try_divide(c - low, width)), F.lit(1)), F.lit(bins))
    # The division may round across an edge; the edges themselves decide.
    moved = F.when(c > low + width * place, place + 1).when(c <= low + width * (place - 1), place - 1).otherwise(place)
    return F.least(F.greatest(moved, F.lit(1)), F.lit(bins)).cast("int")


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Equal-width bins with their edges and counts; empty bins are kept.

    A constant column gets a range of 0.1 % of its value on either side.
    """
    values = df.select(quoted(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    lo, hi = F.min("v"), F.max("v")
    half = F.when(lo == 0, F.lit(EDGE_SHARE)).otherwise(F.abs(lo) * EDGE_SHARE)
    span = values.agg(
        F.struct(
            F.when(lo == hi, lo - half).otherwise(lo).alias("low"),
            F.when(lo == hi, hi + half).otherwise(hi).alias("high"),
            F.when(lo == hi, F.lit(0.0)).otherwise((hi - lo) * EDGE_SHARE).alias("widened"),
        )
    ).scalar()
    low, high = span["low"], span["high"]
    counts = values.groupBy(bin_number(F.col("v"), low, high, bins).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    numbers = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    edge = low + (high - low) / bins * (F.col("bin") - 1)
    next_edge = low + (high - low) / bins * F.col("bin")
    return (
        numbers.join(counts, "bin", "left")
        .select(
            "bin",
            F.when(F.col("bin") == 1, low - span["widened"]).otherwise(edge).alias("lower_edge"),
            F.when(F.col("bin") == bins, high).otherwise(next_edge).alias("upper_edge"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
        .where(F.col("upper_edge").isNotNull())
        .orderBy("bin")
    )


def heatmap(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, value) for every ordered pair; undefined correlations are 0."""
    pairs = correlations(without_nan(df.select(*[quoted(c) for c in columns])), columns)
    mirrored = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), "value"))
    self_pairs = [
        F.struct(
            F.lit(c).alias("x"),
            F.lit(c).alias("y"),
            F.when(varies(quoted(c)), 1.0).otherwise(0.0).alias("value"),
        )
        for c in columns
    ]
    diagonal = df.agg(F.array(*self_pairs).alias("d")).select(F.inline("d"))
    return mirrored.unionByName(diagonal).withColumn("value", F.round("value", 4) + F.lit(0.0))


def monthly_trend(df: DataFrame, date: str, value: str, keep: str = "last", n: int = PERIODS) -> DataFrame:
    """Monthly sums in ascending order, the last (or first) n months.

    Text is parsed: rows whose date is none are left out, and values that are no numbers add nothing.
    """
    text_date = isinstance(df.schema[date].dataType, T.StringType)
    day = parse.parse_timestamp(quoted(date)) if text_date else quoted(date)
    amount = as_number(df.schema[value]) if isinstance(df.schema[value].dataType, T.StringType) else quoted(value)
    months = (
        df.select(day.alias("day"), amount.alias("amount"))
        .where(F.col("day").isNotNull())
        .groupBy(F.date_format("day", "yyyy-MM").alias("period"))
        .agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("value"))
    )
    edge = F.col("period").desc() if keep == "last" else F.col("period").asc()
    return months.orderBy(edge).limit(n).orderBy("period")


# ---------------------------------------------------------------- dashboard


def dashboard_primary(df: DataFrame, category: str, value: str) -> DataFrame:
    grouped = df.groupBy(quoted(category).alias("category")).agg(F.sum(quoted(value)).alias("value"))
    return ranked(grouped, "value", n=DASHBOARD_GROUPS)


def dashboard_secondary(df: DataFrame, category: str) -> DataFrame:
    grouped = df.groupBy(quoted(category).alias("category")).agg(F.count(F.lit(1)).alias("value"))
    return ranked(grouped, "value", n=DASHBOARD_GROUPS)


def dashboard_trend(df: DataFrame, date: str, value: str) -> DataFrame:
    return monthly_trend(df, date, value, keep="first")


def run_rollup(runs: DataFrame, timestamp: str, success: Column) -> DataFrame:
    """Per month: runs, successes and the success rate in percent."""
    grouped = runs.groupBy(F.coalesce(F.date_format(quoted(timestamp), "yyyy-MM"), F.lit("unknown")).alias("date")).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(success).alias("success")
    )
    rate = F.round(F.col("success") * 100.0 / F.col("runs"), 1)
    return grouped.withColumn("success_rate", rate).orderBy("date")


# ---------------------------------------------------------------- report view

# Fixed value: a comparison with a number.
_COMPARISON = re.compile(r"\s*(>=|<=|>|<|=)?\s*(-?\d+(?:\.\d+)?)\s*")
NUMERIC_VIEW_SHARE = 0.8


def as_number(f: T.StructField) -> Column:
    c = quoted(f.name)
    return c.cast("double") if is_numeric(f.dataType) else parse.parse_number(c.cast("string"))


def view_filter(df: DataFrame, column: str, wanted: str) -> DataFrame:
    """A comparison such as '>= 10' on a numeric column, else a case-insensitive substring.

    A column of a numeric type is always compared; text is if most of its values
    that are not null are numbers. The substring is matched literally.
    """
    field = df.schema[column]
    found = _COMPARISON.fullmatch(wanted)
    if found:
        number = as_number(field)
        share = 1.0
        if not is_numeric(field.dataType):
            share = df.agg(F.avg(F.when(quoted(column).isNotNull(), number.isNotNull().cast("double")))).first()[0] or 0.0
        if share > NUMERIC_VIEW_SHARE:
            op, limit = found.group(1) or "=", F.lit(float(found.group(2)))
            # Numeric columns are compared as they are, so the filter reaches the scan.
            left = quoted(column) if is_numeric(field.dataType) else number
            tests = {">": left > limit, "<": left < limit, ">=": left >= limit, "<=": left <= limit, "=": left == limit}
            return df.where(tests[op])
    return df.where(F.lower(quoted(column).cast("string")).contains(wanted.strip().lower()))


def report_view(
    df: DataFrame,
    filter_column: str | None = None,
    filter_value: str | None = None,
    sort_by: str | None = None,
    descending: bool = False,
    category: str | None = None,
    metric: str | None = None,
    date: str | None = None,
    limit: int = 200,
) -> dict[str, DataFrame]:
    """Rows, total and chart tables of the filtered table, each a query of its own.

    Each chart reads only its columns, with the filter pushed into the scan. Text columns of dates and numbers are
    charted as such (``typed_view``); the rows keep what they are.
    """
    if filter_column and filter_value and filter_column in df.columns:
        df = view_filter(df, filter_column, filter_value)
    raw, df = df, typed_view(df)
    numbers = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    others = [c for c in df.columns if c not in numbers]
    if category not in df.columns:
        category = (others or df.columns)[0]
    if metric not in [*numbers, COUNT]:
        metric = (numbers or [COUNT])[0]
    if date is None:
        dated = [f.name for f in df.schema.fields if type_label(f.dataType) == "datetime64"]
        date = (dated or [None])[0]
    rows = ranked(raw, sort_by, not descending) if sort_by in df.columns else raw
    out = {
        "rows": rows.limit(limit),
        "total": df.agg(F.count(F.lit(1)).alias("total_rows")),
        "bar": bar(df, category, metric),
        "pie": pie(df, category, metric, VIEW_PIE_GROUPS),
    }
    if numbers:
        out["histogram"] = histogram(df, numbers[0])
        out["heatmap"] = heatmap(df, numbers)
        if date:
            out["line"] = monthly_trend(df, date, numbers[0])
    return out


def chart_rows(view: dict[str, DataFrame]) -> DataFrame:
    """The chart tables of a view under one another: (chart, label, value)."""
    labels = {
        "total": (F.lit("rows"), F.col("total_rows")),
        "bar": (F.col("category"), F.col("value")),
        "pie": (F.col("name"), F.col("value")),
        "histogram": (F.col("bin").cast("string"), F.col("count")),
        "heatmap": (F.concat_ws("|", "x", "y"), F.col("value")),
        "line": (F.col("period"), F.col("value")),
    }
    parts = [
        view[chart].select(F.lit(chart).alias("chart"), label.alias("label"), value.cast("double").alias("value"))
        for chart, (label, value) in labels.items()
        if chart in view
    ]
    return reduce(DataFrame.unionByName, parts)


def drilldown(df: DataFrame, group: str, value: str, limit: int = 100) -> DataFrame:
    """Rows of one group, compared as text."""
    field = df.schema[group]
    same = quoted(group) == value if isinstance(field.dataType, T.StringType) else quoted(group).cast("string") == value
    return ranked(df.where(same), df.columns[0], ascending=True, n=limit)
