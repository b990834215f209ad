"""Declared datasets: column types, cleaning rules, calculated columns, metrics."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablewright.functions import parse, text
from tablewright.operators.frequency import complete, quoted

# Spark type of each declared type; anything else is text.
DECLARED_TYPES = {
    "string": T.StringType(),
    "text": T.StringType(),
    "integer": T.IntegerType(),
    "float": T.DoubleType(),
    "date": T.DateType(),
    "boolean": T.BooleanType(),
    "datetime": T.TimestampNTZType(),
}


@dataclass
class ColumnSpec:
    name: str
    data_type: str
    description: str = ""
    is_required: bool = True
    is_unique: bool = False
    default_value: object = None
    validation_rules: list[str] = field(default_factory=list)

    @property
    def spark_type(self) -> T.DataType:
        return DECLARED_TYPES.get(self.data_type.lower(), T.StringType())


@dataclass
class DatasetSpec:
    """A declared dataset; saved and loaded as JSON."""

    name: str
    data_type: str = "custom"
    description: str = ""
    source_file: str = ""
    columns: list[ColumnSpec] = field(default_factory=list)
    cleaning_rules: dict = field(default_factory=dict)
    transformation_rules: dict = field(default_factory=dict)
    aggregation_rules: dict = field(default_factory=dict)
    query_patterns: dict = field(default_factory=dict)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(dataclasses.asdict(self), f, indent=2)

    @classmethod
    def load(cls, path: str) -> DatasetSpec:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        data["columns"] = [ColumnSpec(**c) for c in data.get("columns", [])]
        known = {f.name for f in dataclasses.fields(cls)}
        return cls(**{k: v for k, v in data.items() if k in known})

    def schema(self) -> T.StructType:
        """The declared table; required columns are not nullable."""
        return T.StructType([T.StructField(c.name, c.spark_type, not c.is_required) for c in self.columns])

    def unique_columns(self) -> list[str]:
        return [c.name for c in self.columns if c.is_unique]


def empty_table(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    return spark.createDataFrame([], spec.schema())


def spec_from_types(name: str, types: list[dict]) -> DatasetSpec:
    """A spec for an undeclared table, from the rows of ``profile.auto_types``."""
    columns = [
        ColumnSpec(t["column_name"], t["data_type"], f"Auto-detected {t['data_type']} column", t["is_required"])
        for t in types
    ]
    return DatasetSpec(name=name, columns=columns)


# ---------------------------------------------------------------- types and rows


def typed(c: Column, source: T.DataType, declared: str) -> Column:
    """Cast to a declared type; what does not fit becomes null."""
    if declared == "integer":
        if isinstance(source, T.StringType):
            return parse.half_even_integer(parse.parse_number(c))
        if isinstance(source, (T.FloatType, T.DoubleType, T.DecimalType)):
            return parse.half_even_integer(c.cast("double"))
        return c.try_cast("int")
    if declared == "float":
        return parse.parse_number(c) if isinstance(source, T.StringType) else c.try_cast("double")
    if declared == "date":
        return parse.parse_timestamp(c).cast("date") if isinstance(source, T.StringType) else c.try_cast("date")
    if declared in DECLARED_TYPES:
        return c.try_cast(DECLARED_TYPES[declared])
    return c


def cast_by_spec(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """The declared columns present in ``df``, in their declared types."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    present = [c for c in spec.columns if c.name in kinds]
    return df.select(*[typed(quoted(c.name), kinds[c.name], c.data_type.lower()).alias(c.name) for c in present])


def required_columns(spec: DatasetSpec, declared_only: bool = False) -> list[str]:
    """Required columns; ``declared_only`` keeps those also listed under remove_nulls."""
    required = [c.name for c in spec.columns if c.is_required]
    return [c for c in required if c in spec.cleaning_rules.get("remove_nulls", [])] if declared_only else required


def drop_missing_required(df: DataFrame, spec: DatasetSpec, declared_only: bool = False) -> DataFrame:
    return complete(df, [c for c in required_columns(spec, declared_only) if c in df.columns])


def keep_positive(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Rows whose declared positive columns are above zero; null fails."""
    names = [c for c in spec.cleaning_rules.get("positive_values", []) if c in df.columns]
    return reduce(lambda d, c: d.where(quoted(c) > 0), names, df)


def with_calculated(df: DataFrame, spec: DatasetSpec, today: str | None = None) -> DataFrame:
    """Add the calculated columns; ``today`` replaces the current date for repeatable results."""
    rules = spec.transformation_rules.get("calculated_columns", {})
    date = f"DATE '{today}'" if today else "CURRENT_DATE"
    return df.withColumns({name: F.expr(rule.replace("CURRENT_DATE", date)) for name, rule in rules.items()})


def standardise(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Declared lower-casing, trimming and value maps."""
    steps = spec.transformation_rules.get("text_processing", {})
    changes = {c: text.strip(quoted(c)) for c in steps.get("trim", []) if c in df.columns}
    for c in steps.get("lowercase", []):
        if c in df.columns:
            changes[c] = F.lower(changes.get(c, quoted(c)))
    for c, mapping in spec.transformation_rules.get("standardize", {}).items():
        if c in df.columns:
            changes[c] = text.replace_values(changes.get(c, quoted(c)), mapping)
    return df.withColumns(changes) if changes else df


def transform(df: DataFrame, spec: DatasetSpec, today: str | None = None) -> DataFrame:
    """Types, required columns, positive columns, calculated columns."""
    kept = keep_positive(drop_missing_required(cast_by_spec(df, spec), spec), spec)
    return with_calculated(kept, spec, today)


# ---------------------------------------------------------------- rules


def violations(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """(column_name, rule, violations): rows that break each declared rule.

    All row rules are counted in one scan; uniqueness takes one shuffle per column.
    """
    checks: list[tuple[str, str, Column]] = []
    for c in spec.columns:
        if c.name not in df.columns:
            continue
        value = quoted(c.name)
        if c.is_required:
            checks.append((c.name, "required", value.isNull()))
        for rule in c.validation_rules:
            checks.append((c.name, rule, _breaks(value, rule)))
    cleaning = spec.cleaning_rules
    domain = {"valid_genders": "gender", "valid_types": "type"}
    for rule, name in domain.items():
        if rule in cleaning and name in df.columns:
            checks.append((name, rule, ~quoted(name).isin(cleaning[rule])))
    if "valid_age" in cleaning and "age" in df.columns:
        bounds = cleaning["valid_age"]
        checks.append(("age", "valid_age", ~quoted("age").between(bounds["min"], bounds["max"])))
    if "sentiment_range" in cleaning and "sentiment" in df.columns:
        checks.append(("sentiment", "sentiment_range", ~quoted("sentiment").between(*cleaning["sentiment_range"])))
    entries = [
        F.struct(F.lit(n).alias("column_name"), F.lit(r).alias("rule"), F.count_if(broken).alias("violations"))
        for n, r, broken in checks
    ]
    found = df.agg(F.array(*entries).alias("e")).select(F.inline("e"))
    for name in spec.unique_columns():
        if name in df.columns:
            found = found.unionByName(
                repeated(df, name).select(F.lit(name).alias("column_name"), F.lit("unique").alias("rule"), "violations")
            )
    return found


def repeated(df: DataFrame, column: str) -> DataFrame:
    """One row: how many rows carry a non-null value that occurs more than once."""
    counts = df.where(quoted(column).isNotNull()).groupBy(quoted(column)).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("violations"))


def _breaks(value: Column, rule: str) -> Column:
    if rule == "positive":
        return value <= 0
    if rule.startswith("range_"):
        low, high = rule.removeprefix("range_").split("_")
        return ~value.between(float(low), float(high))
    raise ValueError(f"unknown validation rule: {rule}")


def declared_metrics(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """The declared metrics per combination of the declared group columns."""
    rules = spec.aggregation_rules
    metrics = [F.expr(m).alias(metric_name(m)) for m in rules["metrics"]]
    return df.groupBy(*[quoted(c) for c in rules["group_by"]]).agg(*metrics)


def metric_name(expression: str) -> str:
    """'SUM(total_revenue)' -> 'sum_total_revenue', 'COUNT(*)' -> 'count_all'."""
    function, argument = expression.rstrip(")").split("(")
    return f"{function.lower()}_{'all' if argument == '*' else argument}"
