"""Column profiles: types, nulls, distinct counts, samples, roles and meaning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablewright.functions import lexicon, parse
from tablewright.functions.measures import percent, variance, varies
from tablewright.functions.text import contains_any
from tablewright.operators.frequency import quoted, value_frequencies, without_nan

SAMPLES = 3
TOP_FEATURES = 25


def type_label(data_type: T.DataType) -> str:
    """The storage type as a short label: int64, float64, bool, datetime64 or object."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int64"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float64"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime64"
    return "object"


def is_numeric(data_type: T.DataType) -> bool:
    return type_label(data_type) in ("int64", "float64")


def column_list(df: DataFrame) -> DataFrame:
    """(position, column_name, dtype): the schema as rows."""
    rows = [(i, f.name, type_label(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, dtype string")


def column_profile(df: DataFrame, samples: int = SAMPLES, dates: bool = True) -> DataFrame:
    """One row per column, with counts exact over the whole table.

    ``sample_values`` are the smallest distinct values, which unlike the first
    ones do not depend on the physical row order. ``samples=0`` leaves them
    out, ``dates=False`` the test whether a column named like a date parses as one.
    """
    freq = value_frequencies(without_nan(df), digest_long=True)
    present = F.col("value").isNotNull()
    parses = F.when(present, parse.parse_timestamp(F.col("value")).isNotNull())
    facts = freq.groupBy("column_name").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("total_count"),
        F.count("value").alias("unique_count"),
        (F.coalesce(F.bool_and(parses), F.lit(False)) if dates else F.lit(False)).alias("all_dates"),
    )
    joined = column_list(df).join(facts, "column_name", "left")
    if samples:
        numbers = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
        joined = joined.join(_smallest_values(freq.where(present), numbers, samples), "column_name", "left")
    else:
        joined = joined.withColumn("sample_values", F.lit(None).cast("array<string>"))
    rows, total = F.coalesce("row_count", F.lit(0)), F.coalesce("total_count", F.lit(0))
    empty = total == 0
    return joined.select(
        "position",
        "column_name",
        "dtype",
        F.when(empty, F.lit("unknown"))
        .when(F.col("all_dates") & (name_semantic(F.col("column_name")) == "datetime"), F.lit("datetime"))
        .otherwise(F.col("dtype"))
        .alias("type"),
        (empty | (total < rows)).alias("nullable"),
        rows.alias("row_count"),
        total.alias("total_count"),
        (rows - total).alias("null_count"),
        percent(rows - total, rows, 1).alias("null_pct"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
    )


def _smallest_values(freq: DataFrame, numbers: list[str], n: int) -> DataFrame:
    as_number = F.when(F.col("column_name").isin(numbers), F.col("value").try_cast("double"))
    # Filtered on its rank, this window keeps only the first rows of each task before the shuffle.
    order = Window.partitionBy("column_name").orderBy(as_number, "value")
    first = freq.select("column_name", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= n)
    ranked = first.groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("ranked"))
    return ranked.select("column_name", F.col("ranked.value").alias("sample_values"))


def approximate_profile(df: DataFrame, rsd: float = 0.02) -> DataFrame:
    """The profile without exact distinct counts and samples: one scan, no wide shuffle."""
    df = without_nan(df)
    per_column = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(type_label(f.dataType)).alias("dtype"),
            F.count(F.lit(1)).alias("row_count"),
            F.count(quoted(f.name)).alias("total_count"),
            F.approx_count_distinct(quoted(f.name), rsd).alias("unique_count"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    rows = df.agg(F.array(*per_column).alias("c")).select(F.inline("c"))
    missing = F.col("row_count") - F.col("total_count")
    return rows.select("*", missing.alias("null_count"), percent(missing, F.col("row_count"), 1).alias("null_pct"))


# ---------------------------------------------------------------- meaning of columns


def name_semantic(name: Column, rules: list[tuple[str, list[str]]] = lexicon.SEMANTIC_WORDS, tokens: bool = False) -> Column:
    """Meaning by name. ``tokens`` matches whole words, so that 'country' is not a 'count'."""
    text = F.lower(name)
    meaning = None
    for label, words in rules:
        listed = "|".join(words)
        hit = text.rlike(f"(^|[^a-z0-9])({listed})([^a-z0-9]|$)" if tokens else listed)
        meaning = F.when(hit, F.lit(label)) if meaning is None else meaning.when(hit, F.lit(label))
    return meaning.otherwise(F.lit("generic"))


def with_semantic(profile: DataFrame, tokens: bool = False) -> DataFrame:
    """Add ``semantic``: by name first, then by cardinality, then by type."""
    named = name_semantic(F.col("column_name"), tokens=tokens)
    ratio = F.try_divide(F.col("unique_count"), F.col("total_count"))
    text = (F.col("named") == "generic") & (F.col("dtype") == "object")
    meaning = (
        F.when(F.col("total_count") == 0, "unknown")
        .when(text & (ratio < 0.15), "category")
        .when(text & (ratio > 0.9) & (F.col("total_count") > 50), "id")
        .when((F.col("named") == "generic") & F.col("dtype").isin("int64", "float64"), "count")
        .otherwise(F.col("named"))
    )
    return profile.withColumn("named", named).withColumn("semantic", meaning).drop("named")


def with_role(profile: DataFrame) -> DataFrame:
    """Add ``role``: id, date, numeric, categorical or text."""
    name, kind, meaning = F.lower("column_name"), F.upper("type"), F.lower("semantic")
    role = (
        F.when(contains_any(name, lexicon.ID_NAME_WORDS), "id")
        .when(contains_any(kind, lexicon.DATE_TYPE_WORDS), "date")
        .when(
            contains_any(kind, lexicon.NUMERIC_TYPE_WORDS),
            F.when(contains_any(meaning, lexicon.CODED_CATEGORY_WORDS), "categorical").otherwise("numeric"),
        )
        .when(contains_any(meaning, lexicon.CATEGORY_WORDS), "categorical")
        .otherwise("text")
    )
    return profile.withColumn("role", role)


def with_chart_role(profile: DataFrame) -> DataFrame:
    """Add ``chart_role``, the looser grouping by meaning used for dashboards and model casts."""
    kind, meaning = F.lower("type"), F.col("semantic")
    role = (
        F.when(meaning.isin("money", "count", "score", "percentage"), "numeric")
        .when(contains_any(kind, ["int", "float", "double"]), "numeric")
        .when(meaning.isin("category", "location", "name"), "category")
        .when((meaning == "datetime") | kind.contains("date"), "date")
    )
    return profile.withColumn("chart_role", role)


def dataset_type_scores(profile: DataFrame) -> DataFrame:
    """(dataset_type, score, position) for every type that has at least one hit."""
    words = [
        (i, kind, weight, word)
        for i, (kind, weights) in enumerate(lexicon.DATASET_TYPE_WORDS.items())
        for weight, group in weights.items()
        for word in group
    ]
    table = profile.sparkSession.createDataFrame(words, "position int, dataset_type string, weight int, word string")
    names = profile.select(F.lower("column_name").alias("word")).distinct()
    return (
        names.join(F.broadcast(table), "word")
        .groupBy("dataset_type")
        .agg(F.sum("weight").alias("score"), F.min("position").alias("position"))
    )


def dataset_type(profile: DataFrame) -> DataFrame:
    """One row (dataset_type, score); 'generic' with score 0 when no word matches."""
    best = dataset_type_scores(profile).agg(
        F.min_by("dataset_type", F.struct(-F.col("score"), F.col("position"))).alias("dataset_type"),
        F.max("score").alias("score"),
    )
    return best.select(
        F.coalesce("dataset_type", F.lit("generic")).alias("dataset_type"),
        F.coalesce("score", F.lit(0)).alias("score"),
    )


def roles(profile: DataFrame) -> dict[str, list[str]]:
    """Column names per role in table order; ``profile`` must carry ``role``."""
    found = {r: [] for r in ("numeric", "categorical", "date", "text", "id")}
    for row in profile.select("position", "column_name", "role").orderBy("position").collect():
        found[row["role"]].append(row["column_name"])
    return found


def suggested_queries(columns: dict[str, list[str]], kind: str = "generic") -> list[str]:
    """Up to six questions the data can answer."""
    num, cat, date = (columns.get(r, []) for r in ("numeric", "categorical", "date"))
    if not (num or cat or date):
        return ["Show all records", "Count total records"]
    n, c = (num or [None])[0], (cat or [None])[0]
    special = {
        "sales": (cat and num, f"Bottom 5 {c} by {n}"),
        "medical": (cat, f"Patient count by {c}"),
        "finance": (date and num, f"{n} trend analysis"),
        "news": (date, "Articles by publish date"),
        "education": (num, f"Top 10 students by {n}"),
    }
    offers = [
        (num, f"Show top 10 by {n}"),
        (cat and num, f"Total {n} by {c}"),
        (num, f"Average {n}"),
        (cat, f"Distribution of {c}"),
        (date and num, f"{n} trend over time"),
        special.get(kind, (False, "")),
        (cat, f"How many records per {c}"),
    ]
    return [text for possible, text in offers if possible][:6]


def describe_dataset(columns: dict[str, list[str]], names: list[str], kind: str, rows: int) -> str:
    """One sentence about the table."""
    labels = {"numeric": "numeric", "categorical": "categorical", "date": "date/time", "text": "text"}
    parts = [f"{len(columns[r])} {label}" for r, label in labels.items() if columns.get(r)]
    shown = names[:5] + ([f"and {len(names) - 5} more"] if len(names) > 5 else [])
    keys = ", ".join(f"‘{n}’" for n in shown)
    return (
        f"{kind.capitalize()} dataset with {rows:,} rows and {len(names)} columns "
        f"({', '.join(parts) or 'mixed'}). Key columns: {keys}."
    )


# ---------------------------------------------------------------- other profiles


def numeric_profile(df: DataFrame, samples: int = 5) -> DataFrame:
    """Per column: null percentage, distinct count, simple meaning, and min/max/mean of numbers."""
    df = without_nan(df)
    facts = column_profile(df, samples=samples, dates=False)
    numbers = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    stats = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.min(quoted(c)).cast("double").alias("min"),
            F.max(quoted(c)).cast("double").alias("max"),
            F.avg(quoted(c)).alias("mean"),
        )
        for c in numbers
    ]
    name = F.lower("column_name")
    unique_ratio = F.try_divide(F.col("unique_count"), F.col("row_count"))
    meaning = (
        F.when(contains_any(name, ["date", "time"]), "datetime")
        .when(F.col("dtype").isin("int64", "float64"), "numeric")
        .when(unique_ratio < 0.05, "category")
        .otherwise("text")
    )
    out = facts.select(
        "position", "column_name", "dtype", "row_count", "null_count",
        percent(F.col("null_count"), F.col("row_count"), 2).alias("null_percentage"),
        "unique_count", "sample_values", meaning.alias("semantic_type"),
    )
    if not stats:
        none = F.lit(None).cast("double")
        return out.select("*", none.alias("min"), none.alias("max"), none.alias("mean"))
    measured = df.agg(F.array(*stats).alias("s")).select(F.inline("s"))  # one row per column
    joined = out.join(F.broadcast(measured), "column_name", "left")
    only_numeric = F.col("semantic_type") == "numeric"
    return joined.select(
        *out.columns, *[F.when(only_numeric, F.col(m)).alias(m) for m in ("min", "max", "mean")]
    )


def auto_types(profile: DataFrame) -> DataFrame:
    """Declared type of each column: date, integer, float, string (category) or text."""
    name = F.lower("column_name")
    ratio = F.try_divide(F.col("unique_count"), F.col("row_count"))
    declared = (
        F.when(contains_any(name, ["date", "time"]), "date")
        .when(F.col("dtype") == "int64", "integer")
        .when(F.col("dtype") == "float64", "float")
        .when((F.col("dtype") == "object") & (ratio < 0.1), "string")
        .when(F.col("dtype") == "object", "text")
        .otherwise("string")
    )
    return profile.select(
        "position", "column_name", declared.alias("data_type"), (F.col("total_count") > 0).alias("is_required")
    )


def workbook_semantics(profile: DataFrame) -> DataFrame:
    """The shorter rule set for workbook columns; low-cardinality text is a category."""
    named = name_semantic(F.col("column_name"), lexicon.WORKBOOK_SEMANTIC_WORDS)
    ratio = F.try_divide(F.col("unique_count"), F.col("total_count"))
    low = (named == "generic") & (F.col("dtype") == "object") & (ratio < 0.1)
    return profile.select("position", "column_name", F.when(low, "category").otherwise(named).alias("semantic"))


# ---------------------------------------------------------------- importance


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, value) for every unordered pair of distinct columns, pairwise complete.

    Two scans: centre and spread of each column, then sums of products. Values are
    centred first, so a large offset costs no digits, and any number of columns
    takes the same way. Each task adds up k x k matrices over its batches and emits
    one row per pair, so the shuffle does not grow with the rows.
    """
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "x string, y string, value double")
    numbers = df.select(*[quoted(c).cast("double").alias(c) for c in columns])
    stats = [
        F.struct(
            F.min(quoted(c)).alias("low"),
            F.avg(quoted(c)).alias("mean"),
            F.when(varies(quoted(c)), F.stddev_samp(quoted(c))).alias("spread"),
        )
        for c in columns
    ]
    found = numbers.agg(F.array(*stats).alias("f")).first()["f"]  # one row
    # A constant is centred on its value, which gives products of exactly 0.
    centre = np.array([(f["mean"] if f["spread"] else f["low"]) or 0.0 for f in found])
    scale = np.array([f["spread"] or 1.0 for f in found])
    first, second = np.triu_indices(len(columns), 1)
    names = np.array(columns, dtype=object)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(columns)
        n, sx, sxx, sxy = (np.zeros((size, size)) for _ in range(4))
        for batch in batches:
            raw = batch.to_numpy(dtype=float, na_value=np.nan)
            there = ~np.isnan(raw)
            mask, z = there.astype(float), np.where(there, (raw - centre) / scale, 0.0)
            n += mask.T @ mask
            sx += z.T @ mask  # [i, j]: sum of column i where column j is present
            sxx += (z * z).T @ mask
            sxy += z.T @ z
        yield pd.DataFrame({
            "x": names[first], "y": names[second], "n": n[first, second],
            "sx": sx[first, second], "sy": sx[second, first],
            "sxx": sxx[first, second], "syy": sxx[second, first], "sxy": sxy[first, second],
        })

    sums = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    schema = "x string, y string, " + ", ".join(f"{c} double" for c in sums)
    total = numbers.mapInPandas(products, schema).groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in sums])
    covariance = F.expr("sxy - sx * sy / n")
    spread = F.sqrt(F.greatest(F.expr("sxx - sx * sx / n"), F.lit(0.0)) * F.greatest(F.expr("syy - sy * sy / n"), F.lit(0.0)))
    # Below the rounding error of the sums a column counts as constant.
    usable = (F.col("n") > 1) & (spread > F.col("n") * 1e-14)
    value = F.when(usable, F.try_divide(covariance, spread)).otherwise(0.0)
    return total.select("x", "y", F.when(F.col("n") > 0, value).otherwise(0.0).alias("value"))


def feature_importance(
    df: DataFrame, top: int | None = TOP_FEATURES, ratios: dict[str, float] | None = None
) -> DataFrame:
    """Columns by importance: spread and correlation of numbers, cardinality of the rest.

    Dates are left out. Ties keep numbers first, then table order. ``ratios``
    (distinct values per row) saves counting them when a profile has done so.
    ``top`` bounds the listing; None gives every column.
    """
    df = without_nan(df)
    kinds = {f.name: type_label(f.dataType) for f in df.schema.fields}
    numbers = [c for c, k in kinds.items() if k in ("int64", "float64")]
    others = [c for c, k in kinds.items() if k in ("object", "bool")]
    spark = df.sparkSession
    schema = "rank_group int, position int, feature string, type string"
    order = spark.createDataFrame(
        [(0, i, c, "numeric") for i, c in enumerate(numbers)] + [(1, i, c, "categorical") for i, c in enumerate(others)],
        schema,
    )
    parts = []
    if numbers:
        entries = [F.struct(F.lit(c).alias("feature"), variance(quoted(c).cast("double")).alias("variance")) for c in numbers]
        spread = df.agg(F.array(*entries).alias("e")).select(F.inline("e"))
        pairs = correlations(df, numbers)
        both = pairs.select(F.col("x").alias("feature"), F.abs("value").alias("r")).unionByName(
            pairs.select(F.col("y").alias("feature"), F.abs("value").alias("r"))
        )
        mean_r = both.groupBy("feature").agg(F.avg("r").alias("mean_r"))
        score = 0.7 * F.col("variance") + 0.3 * F.coalesce("mean_r", F.lit(0.0))
        parts.append(
            spread.join(mean_r, "feature", "left").select(
                "feature",
                F.round("variance", 6).alias("variance"),
                F.round(F.coalesce("mean_r", F.lit(0.0)), 6).alias("mean_abs_correlation"),
                F.lit(None).cast("double").alias("cardinality_ratio"),
                F.round(score, 6).alias("importance_score"),
            )
        )
    if others:
        if ratios is None:
            freq = value_frequencies(df, others, digest_long=True)
            ratio = F.count("value") / F.greatest(F.sum("n"), F.lit(1))
            counted = freq.groupBy(F.col("column_name").alias("feature")).agg(ratio.alias("u"))
        else:
            counted = spark.createDataFrame([(c, ratios[c]) for c in others], "feature string, u double")
        score = 0.4 * F.col("u") + 0.2 * (1 - F.abs(0.5 - F.col("u")))
        parts.append(
            counted.select(
                "feature",
                F.lit(None).cast("double").alias("variance"),
                F.lit(None).cast("double").alias("mean_abs_correlation"),
                F.round("u", 6).alias("cardinality_ratio"),
                F.round(score, 6).alias("importance_score"),
            )
        )
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    ranked = scored.join(F.broadcast(order), "feature")
    ordered = ranked.orderBy(F.desc("importance_score"), "rank_group", "position")
    listed = ordered if top is None else ordered.limit(top)
    return listed.select("feature", "type", "variance", "mean_abs_correlation", "cardinality_ratio", "importance_score")


# ---------------------------------------------------------------- quality


def quality_report(profile: DataFrame) -> DataFrame:
    """Per column: good, moderate or poor, and the number of issues found."""
    return profile.select(
        "position",
        "column_name",
        "semantic",
        "null_count",
        "null_pct",
        "unique_count",
        F.when(F.col("null_pct") > 20, "poor").when(F.col("null_pct") > 5, "moderate").otherwise("good").alias("quality"),
        (F.col("nullable") & (F.col("null_pct") > 5)).alias("null_issue"),
        F.col("nullable").alias("has_nulls"),
        ((F.col("unique_count") == F.col("total_count")) & (F.col("total_count") > 10)).alias("all_unique"),
    )


def quality_score(profile: DataFrame) -> DataFrame:
    """One row: the overall score between 0 and 1, from a profile or ``null_counts``."""
    issues = F.count_if(F.col("nullable") & (F.col("null_pct") > 5))
    cells = F.max("row_count") * F.greatest(F.count(F.lit(1)), F.lit(1))
    nulls = F.coalesce(F.try_divide(F.sum("null_count"), cells), F.lit(0.0))
    return profile.agg(
        F.round(F.greatest(F.lit(0.0), 1.0 - nulls - issues * 0.05), 2).alias("overall_score"),
        issues.alias("total_issues"),
    )


def null_summary(profile: DataFrame) -> DataFrame:
    """One row: total nulls, columns with nulls, share of null cells, from a profile or ``null_counts``."""
    cells = F.greatest(F.max("row_count") * F.count(F.lit(1)), F.lit(1))
    return profile.agg(
        F.sum("null_count").alias("total_nulls"),
        F.count_if("nullable").alias("columns_with_nulls"),
        percent(F.sum("null_count"), cells, 1).alias("overall_null_percentage"),
    )


def likeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, values, those shaped like dates and like numbers, and those that parse; one scan, no value is shuffled."""
    entries = []
    for c in columns:
        value = quoted(c).cast("string")
        counts = {
            "row_count": F.count(F.lit(1)), "present": F.count(value), "shaped": F.count_if(parse.looks_like_date(value)),
            "parsed": F.count(parse.parse_timestamp(value)), "plain": F.count(parse.parse_number(value)), "messy": F.count(parse.parse_messy_number(value)),
        }
        entries.append(F.struct(F.lit(c).alias("column_name"), *[v.alias(k) for k, v in counts.items()]))
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


# What makes text a date column or, in reports, a number column.
DATE_SHAPED, DATE_PARSED, REPORT_NUMBERS = 0.6, 0.7, 0.7


def date_likeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: share of values shaped like a date, share of rows that parse, and the verdict."""
    like, share = _share("shaped", "present"), _share("parsed", "row_count")
    return likeness(df, columns).select(
        "column_name",
        F.round(like, 6).alias("date_like_share"),
        F.round(share, 6).alias("parsed_share"),
        ((like >= DATE_SHAPED) & (share >= DATE_PARSED)).alias("is_datetime"),
    )


def numeric_likeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: share of non-null values that are numbers, and that become numbers when cleaned."""
    intent = contains_any(F.lower("column_name"), lexicon.NUMERIC_INTENT_WORDS)
    plain, messy = _share("plain", "present"), _share("messy", "present")
    return likeness(df, columns).select(
        "column_name",
        F.round(plain, 6).alias("numeric_share"),
        F.round(messy, 6).alias("cleaned_share"),
        intent.alias("numeric_intent"),
        F.when(intent, messy >= 0.2).otherwise(plain >= 0.85).alias("coerced_when_cleaning"),
        (plain >= REPORT_NUMBERS).alias("numeric_in_reports"),
    )


def typed_view(df: DataFrame) -> DataFrame:
    """``df`` for charts: text columns of dates as timestamps and, where no column is numeric by type, those of numbers as doubles.

    Shares are taken in one scan of the text columns; a table with numbers and dates by type is taken as it is. Values
    that do not parse become null.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    kinds = {type_label(f.dataType) for f in df.schema.fields}
    has_numbers = bool(kinds & {"int64", "float64"})
    if has_numbers and "datetime64" in kinds:
        return df
    dated = (_share("shaped", "present") >= DATE_SHAPED) & (_share("parsed", "row_count") > DATE_PARSED)
    numbered = ~dated & (_share("plain", "present") >= REPORT_NUMBERS)
    found = likeness(df, texts).select("column_name", dated.alias("dated"), numbered.alias("numbered")).collect()  # one row per column
    typed = {}
    for row in found:
        if row["dated"]:
            typed[row["column_name"]] = parse.parse_timestamp(quoted(row["column_name"]))
        elif row["numbered"] and not has_numbers:
            typed[row["column_name"]] = parse.parse_number(quoted(row["column_name"]))
    return df.select(*[typed.get(c, quoted(c)).alias(c) for c in df.columns])


def null_counts(df: DataFrame) -> DataFrame:
    """Per column: rows, nulls (NaN counts) and whether there are any; one scan, no value is shuffled."""
    clean = without_nan(df)
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("row_count"), F.count(quoted(c)).alias("total_count"))
        for i, c in enumerate(df.columns)
    ]
    found = clean.agg(F.array(*entries).alias("e")).select(F.inline("e"))
    nulls = F.col("row_count") - F.col("total_count")
    return found.withColumns({"null_count": nulls, "nullable": (nulls > 0) | (F.col("total_count") == 0), "null_pct": percent(nulls, F.col("row_count"), 1)})


# ---------------------------------------------------------------- suggested measures


def suggested_metrics(df: DataFrame, columns: dict[str, list[str]], n: int = 6) -> DataFrame:
    """(name, formula, value): row count, sums and averages, and a distinct count, in one scan."""
    offers = [("Total Records", "COUNT(*)", F.count(F.lit(1)))]
    for c in columns.get("numeric", [])[:3]:
        offers.append((f"Total {c}", f"SUM({c})", F.sum(quoted(c))))
        offers.append((f"Average {c}", f"AVG({c})", F.avg(quoted(c))))
    for c in columns.get("categorical", [])[:1]:
        offers.append((f"Distinct {c}", f"COUNT(DISTINCT {c})", F.count_distinct(quoted(c))))
    entries = [
        F.struct(F.lit(name).alias("name"), F.lit(formula).alias("formula"), value.cast("double").alias("value"))
        for name, formula, value in offers[:n]
    ]
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def recommended_aggregates(df: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """(category, label, measure, total): two measures summed over two categories and over months."""
    measures, categories = columns.get("numeric", [])[:2], columns.get("categorical", [])[:2]
    dates = columns.get("date", [])[:1]
    sums = [F.sum(quoted(m)).cast("double").alias(m) for m in measures]
    parts = []
    if measures and categories:
        # One scan and one shuffle for all categories.
        labels = [
            F.struct(F.lit(c).alias("category"), quoted(c).cast("string").alias("label")) for c in categories
        ]
        long = df.select(F.explode(F.array(*labels)).alias("g"), *[quoted(m) for m in measures])
        parts.append(long.groupBy("g.category", "g.label").agg(*sums))
    if measures and dates:
        month = F.date_format(quoted(dates[0]), "yyyy-MM").alias("label")
        monthly = df.groupBy(month).agg(sums[0]).withColumn("category", F.lit("month"))
        parts.append(monthly)
    if not parts:
        return df.sparkSession.createDataFrame([], "category string, label string, measure string, total double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    long = out.unpivot(["category", "label"], [quoted(m) for m in measures], "measure", "total")
    return long.where((F.col("category") != "month") | (F.col("measure") == measures[0]))


def rows_with_nulls(df: DataFrame) -> DataFrame:
    """How many rows have at least one null."""
    any_null = F.lit(False)
    for c in df.columns:
        any_null = any_null | quoted(c).isNull()
    return df.agg(F.count_if(any_null).alias("rows_with_nulls"), F.count(F.lit(1)).alias("row_count"))
