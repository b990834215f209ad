"""Cleaning: a plan from the profile, statistics in few passes, then one projection."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.durable import scratch_path
from tablewright.functions import lexicon, parse, text
from tablewright.functions.measures import corrected_skew
from tablewright.operators import profile as profiles
from tablewright.operators.frequency import complete, quoted, value_frequencies, without_nan
from tablewright.operators.ordering import forward_backward_fill
from tablewright.operators.quantiles import medians
from tablewright.sources.tables import replace_files

# The operations a plan may name.
OPERATIONS = [
    "trim", "lowercase", "normalize_empty_to_null", "parse_numeric", "parse_date", "drop_row_if_null",
]

# Decision thresholds.
SKEWED = 1.0
MOSTLY_MISSING = 0.75
NUMERIC_SHARE = 0.85
INTENT_SHARE = 0.2
DATE_LIKE_SHARE = 0.6
DATE_PARSED_SHARE = 0.7

# Columns measured by one aggregation.
COLUMNS_PER_SCAN = 40

LOG_SCHEMA = (
    "step int, column_name string, operation string, strategy string, "
    "missing_before long, missing_after long, fill_preview string, rows_removed long"
)

Plan = dict[str, list[str]]


# ---------------------------------------------------------------- plan


def heuristic_plan(columns: list[dict], drop_for: tuple[str, ...] = ("id", "name")) -> Plan:
    """Operations per column from its ``type`` and ``semantic``."""
    plan: Plan = {}
    for col in columns:
        kind, meaning = col["type"].lower(), col["semantic"]
        numeric = any(w in kind for w in ("int", "double", "float", "decimal", "numeric"))
        if numeric or meaning in ("money", "count", "score", "percentage"):
            ops = ["normalize_empty_to_null", "parse_numeric"]
        elif meaning == "datetime" or "date" in kind or "time" in kind:
            ops = ["trim", "normalize_empty_to_null", "parse_date"]
        else:
            ops = ["trim", "normalize_empty_to_null"] + (["lowercase"] if meaning == "email" else [])
        if meaning in drop_for:
            ops.append("drop_row_if_null")
        plan[col["column_name"]] = ops
    return plan


def validated_plan(plan: Plan, columns: list[str]) -> Plan:
    """The plan without unknown columns, unknown operations and repeats."""
    kept = {c: list(dict.fromkeys(op for op in ops if op in OPERATIONS)) for c, ops in plan.items() if c in columns}
    return {c: ops for c, ops in kept.items() if ops}


def _planned(c: Column, ops: list[str], kind: str | None) -> Column:
    """A text column after its operations; white space is stripped at most once. ``kind`` is the type of its numbers."""
    stripped = False
    for op in ops:
        if op in ("trim", "normalize_empty_to_null") and not stripped:
            c, stripped = text.strip(c), True
        if op == "normalize_empty_to_null":
            c = F.nullif(c, F.lit(""))
        elif op == "lowercase":
            c = text.lowercase(c)
        elif op == "parse_numeric" and kind is not None:
            return parse.number_text(c, messy=True, stripped=stripped).try_cast(kind)
        elif op == "parse_date":
            return parse.parse_timestamp(c, stripped)
    return c


def number_types(df: DataFrame, plan: Plan) -> dict[str, str | None]:
    """For each text column that the plan parses, the type that tells its numbers apart; one scan of these columns."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and "parse_numeric" in plan.get(f.name, [])]
    found: dict[str, str | None] = {}
    for start in range(0, len(texts), COLUMNS_PER_SCAN):
        chunk = texts[start:start + COLUMNS_PER_SCAN]
        digits = df.select(*[parse.number_text(quoted(c), messy=True).alias(f"d{i}") for i, c in enumerate(chunk)])
        row = digits.agg(*[_as_struct(parse.digit_facts(F.col(f"d{i}")), f"c{i}") for i in range(len(chunk))]).first()
        found |= {c: parse.exact_type(row[f"c{i}"].asDict()) for i, c in enumerate(chunk)}
    return found


def _as_struct(entries: dict[str, Column], name: str) -> Column:
    return F.struct(*[e.alias(k) for k, e in entries.items()]).alias(name)


def apply_plan(df: DataFrame, plan: Plan, types: dict[str, str | None] | None = None) -> DataFrame:
    """Run the value operations of the plan as one projection; no rows are dropped here.

    Only text is touched: numbers and dates are parsed already. ``types`` (from ``number_types``) gives the types
    of parsed numbers, double where it names none; a column for which it gives None stays text.
    """
    kinds = types or {}
    planned = {
        f.name: _planned(quoted(f.name), plan[f.name], kinds.get(f.name, "double"))
        for f in df.schema.fields
        if f.name in plan and isinstance(f.dataType, T.StringType)
    }
    return df.withColumns(planned) if planned else df


def canonicalise(df: DataFrame, semantics: dict[str, str]) -> DataFrame:
    """Canonical gender labels in the category or person columns named after them."""
    hit = {
        f.name: text.canonical(quoted(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType)
        and semantics.get(f.name) in ("category", "person")
        and any(w in f.name.lower() for w in ("gender", "sex"))
    }
    return df.withColumns(hit) if hit else df


# ---------------------------------------------------------------- imputation


def numeric_intent(name: str, semantic: str) -> bool:
    return semantic in lexicon.NUMERIC_INTENT_SEMANTICS or any(
        w in name.lower() for w in lexicon.NUMERIC_INTENT_WORDS
    )


@dataclass
class Choice:
    """How the nulls of one column are filled."""

    column: str
    missing: int
    strategy: str
    value: object = None
    numeric: Column | None = None  # the column as doubles, which statistics are taken from
    digits: Column | None = None  # the text that the coerced form of a text column is read from
    ordered: Column | None = None  # set when the fill follows the row order
    kind: str = "double"  # type of the coerced form
    needs: str = ""  # "median" or "mode" while the value is still open
    count: int = 0  # numbers the median is taken from
    present: int = 0
    text: bool = False  # a text column that may still turn out to hold dates

    @property
    def preview(self) -> str | None:
        if self.value is None:
            return None
        return repr(round(self.value, 6)) if isinstance(self.value, float) else str(self.value)


def measure(df: DataFrame, semantics: dict[str, str]) -> tuple[int, dict[str, dict]]:
    """Row count and, per column, its values, and the count, mean and skew of its numbers."""
    fields = df.schema.fields
    facts: dict[str, dict] = {}
    rows = 0
    for start in range(0, len(fields), COLUMNS_PER_SCAN):
        chunk = fields[start:start + COLUMNS_PER_SCAN]
        # Each value is parsed once per row, in a projection below the aggregates.
        parsed, entries = [], [F.count(F.lit(1)).alias("rows")]
        for i, f in enumerate(chunk):
            parsed.append(quoted(f.name).isNotNull().alias(f"present_{i}"))
            wanted = {"present": F.count_if(f"present_{i}")}
            number = _number_form(f, semantics.get(f.name, ""))
            if number is not None:
                parsed.append(number.alias(f"number_{i}"))
                v = F.col(f"number_{i}")
                wanted |= {"numbers": F.count(v), "mean": F.avg(v), "skew": corrected_skew(v)}
            if isinstance(f.dataType, T.StringType):
                parsed.append(_digits(f, semantics.get(f.name, "")).alias(f"digits_{i}"))
                wanted |= parse.digit_facts(F.col(f"digits_{i}"))
            entries.append(_as_struct(wanted, f"c{i}"))
        row = df.select(*parsed).agg(*entries).first()
        rows = row["rows"]
        facts |= {f.name: row[f"c{i}"].asDict() for i, f in enumerate(chunk)}
    return rows, facts


def text_facts(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Mode and date shares of text columns, each distinct value tested once."""
    freq = value_frequencies(df, columns).where(F.col("value").isNotNull())
    value, n = F.col("value"), F.col("n")
    like = parse.looks_like_date(value)
    found = freq.groupBy("column_name").agg(
        F.min(F.struct((-n).alias("neg"), value)).getField("value").alias("mode"),
        F.sum(F.when(like, n).otherwise(0)).alias("date_like"),
        F.sum(F.when(like & parse.parse_timestamp(value).isNotNull(), n).otherwise(0)).alias("dates"),
    )
    return {r["column_name"]: r.asDict() for r in found.collect()}  # one row per column


def _number_form(f: T.StructField, semantic: str) -> Column | None:
    """The column as a number: itself, or text coerced as its intent allows."""
    c = quoted(f.name)
    if profiles.is_numeric(f.dataType):
        return c.cast("double")
    if isinstance(f.dataType, T.StringType):
        return _digits(f, semantic).try_cast("double")
    return None


def _digits(f: T.StructField, semantic: str) -> Column:
    """What a text column's numbers are read from, as its intent allows."""
    return parse.number_text(quoted(f.name), messy=numeric_intent(f.name, semantic))


def choose(
    f: T.StructField, rows: int, fact: dict, semantic: str, importance: float, typical: float
) -> Choice | None:
    """Pick the fill for one column; None when nothing is missing.

    ``needs`` of the result tells what is still to be found out: the median, or
    whether the text is a date and which value is its mode.
    """
    present, missing = fact["present"], rows - fact["present"]
    if missing == 0:
        return None
    if missing / rows > MOSTLY_MISSING and importance < typical:
        return Choice(f.name, missing, "skipped_low_priority_high_missing")
    kind = profiles.type_label(f.dataType)
    number, numbers = _number_form(f, semantic), fact.get("numbers", 0)
    if kind in ("int64", "float64"):
        if present == 0:
            return Choice(f.name, missing, "mean")
        return _central(f.name, missing, "", number, fact)
    if kind == "datetime64":
        return Choice(f.name, missing, "forward_backward_fill", ordered=quoted(f.name))
    exact = parse.exact_type(fact) if number is not None else None
    if exact is None:
        # Numbers that no type keeps apart are worth more as the text they are.
        number, numbers = None, 0
    intent = number is not None and numeric_intent(f.name, semantic)
    if numbers and numbers / present >= (INTENT_SHARE if intent else NUMERIC_SHARE):
        return replace(_central(f.name, missing, "numeric_coerce_", number, fact), kind=exact, digits=_digits(f, semantic))
    if intent:
        fallback = Choice(f.name, missing, "numeric_intent_skip_no_valid_values", numeric=number)
        if numbers:
            fallback = Choice(
                f.name, missing, "numeric_intent_median_fallback", numeric=number, needs="median", count=numbers
            )
        fallback = replace(fallback, kind=exact, digits=_digits(f, semantic))
        return replace(fallback, present=present, text=True) if present else fallback
    if present == 0:
        return Choice(f.name, missing, "unknown", "Unknown") if kind == "object" else Choice(f.name, missing, "mode")
    return Choice(f.name, missing, "mode", needs="mode", present=present, text=True)


def _central(name: str, missing: int, prefix: str, number: Column, fact: dict) -> Choice:
    if abs(fact["skew"]) > SKEWED:
        return Choice(name, missing, f"{prefix}median", numeric=number, needs="median", count=fact["numbers"])
    return Choice(name, missing, f"{prefix}mean", fact["mean"], numeric=number)


def _as_text_choice(choice: Choice, rows: int, fact: dict) -> Choice:
    """Turn an open choice for a text column into a date fill or a mode, if that is what it is."""
    date_like = fact["date_like"] / choice.present >= DATE_LIKE_SHARE
    if date_like and fact["dates"] / rows >= DATE_PARSED_SHARE:
        parsed = parse.parse_timestamp(quoted(choice.column))
        return Choice(choice.column, choice.missing, "forward_backward_fill_datetime", ordered=parsed)
    if choice.needs == "mode":
        if fact["mode"].strip():
            return replace(choice, needs="", value=fact["mode"])
        return replace(choice, needs="", strategy="unknown", value="Unknown")
    return choice


def fill_choices(
    df: DataFrame, semantics: dict[str, str], importance: dict[str, float] | None = None
) -> tuple[int, list[Choice]]:
    """Row count and the resolved fill of every column that has nulls."""
    rows, facts = measure(df, semantics)
    scores = importance or {}
    ranked = sorted(scores.values())
    typical = ranked[len(ranked) // 2] if ranked else 0.0
    found = [
        choose(f, rows, facts[f.name], semantics.get(f.name, ""), scores.get(f.name, 0.0), typical)
        for f in df.schema.fields
    ]
    choices = [c for c in found if c is not None]
    texts = text_facts(df, names) if (names := [c.column for c in choices if c.text]) else {}
    choices = [_as_text_choice(c, rows, texts[c.column]) if c.text else c for c in choices]
    waiting = [c for c in choices if c.needs == "median"]
    values = medians(df, {c.column: c.numeric for c in waiting}, {c.column: c.count for c in waiting})
    return rows, [replace(c, value=values[c.column]) if c.needs == "median" else c for c in choices]


def apply_choices(
    df: DataFrame, choices: list[Choice], order_by: list[str] | None = None, partition_by: list[str] | None = None
) -> DataFrame:
    """Fill the nulls: one projection, plus an ordered fill when a date column needs it."""
    by_name = {c.column: c for c in choices}
    out = []
    for f in df.schema.fields:
        c, choice = quoted(f.name), by_name.get(f.name)
        if choice is not None:
            if choice.ordered is not None:
                c = choice.ordered
            elif choice.digits is not None and choice.strategy.startswith("numeric_"):
                c = choice.digits.try_cast(choice.kind)
            if choice.value is not None and choice.ordered is None:
                fill = F.lit(choice.value)
                if choice.digits is not None and choice.strategy.startswith("numeric_") and choice.kind != "double":
                    # A fill between the numbers is rounded to their type.
                    whole = choice.kind == "bigint" or choice.kind.endswith(",0)")
                    fill = (F.rint(fill) if whole else fill).cast(choice.kind)
                if isinstance(f.dataType, T.BooleanType):
                    fill = fill.cast("boolean")
                elif profiles.is_numeric(f.dataType):
                    # The column keeps its type, and so every digit of an id or an amount; the fill is rounded to it.
                    whole = profiles.type_label(f.dataType) == "int64"
                    c, fill = quoted(f.name), (F.rint(fill) if whole else fill).cast(f.dataType)
                c = F.coalesce(c, fill)
        out.append(c.alias(f.name))
    filled = df.select(*out)
    ordered = [c.column for c in choices if c.ordered is not None]
    if not ordered:
        return filled
    if not order_by:
        raise ValueError(f"filling {ordered} needs order_by: rows have no order of their own")
    return forward_backward_fill(filled, ordered, order_by, partition_by)


def impute(
    df: DataFrame,
    semantics: dict[str, str] | None = None,
    order_by: list[str] | None = None,
    partition_by: list[str] | None = None,
    importance: dict[str, float] | None = None,
) -> DataFrame:
    """Fill every column by the strategy its own statistics select."""
    _, choices = fill_choices(df, semantics or {}, importance)
    return apply_choices(df, choices, order_by, partition_by)


# ---------------------------------------------------------------- rows


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna("all")


def drop_incomplete_rows(df: DataFrame, required: list[str]) -> DataFrame:
    return complete(df, required)


def drop_repeated_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates, null equal to null. Copies are merged before the shuffle."""
    return df.dropDuplicates()


def basic_clean(df: DataFrame) -> DataFrame:
    """Drop duplicates and empty rows, strip text, and turn the text 'nan' into null."""
    kept = drop_empty_rows(drop_repeated_rows(df))
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return kept
    return kept.withColumns({c: F.nullif(text.strip(quoted(c)), F.lit("nan")) for c in texts})


# ---------------------------------------------------------------- the whole run


@dataclass
class Cleaned:
    data: DataFrame
    log: DataFrame
    plan: Plan
    choices: list[Choice] = field(default_factory=list)


def _removal(step: int, reason: str, counted: DataFrame) -> DataFrame:
    """A log row whose count is computed when the log is read."""
    return counted.select(
        F.lit(step).cast("int").alias("step"),
        F.lit(None).cast("string").alias("column_name"),
        F.lit("deduplicate" if reason == "deduplicate" else "row_removal").alias("operation"),
        F.lit(reason).alias("strategy"),
        F.lit(None).cast("long").alias("missing_before"),
        F.lit(None).cast("long").alias("missing_after"),
        F.lit(None).cast("string").alias("fill_preview"),
        F.col("removed").cast("long").alias("rows_removed"),
    )


def clean(
    df: DataFrame,
    plan: Plan | None = None,
    order_by: list[str] | None = None,
    partition_by: list[str] | None = None,
    drop_duplicates: bool = True,
    materialise: bool = True,
) -> Cleaned:
    """Profile, parse, canonicalise, drop empty and incomplete rows, impute, and drop repeated rows.

    Empty rows and rows without a required value are dropped before anything is
    filled, so that no fill turns them into records. Types are coerced only where
    nulls remain after that. ``order_by`` is needed when dates are filled.
    ``materialise`` writes the parsed table to the shared folder, so that the
    later passes read the columns they need instead of parsing everything again.
    """
    df = without_nan(df)
    spark = df.sparkSession
    prof = profiles.with_semantic(profiles.column_profile(df, samples=0)).orderBy("position").collect()  # one row per column
    columns = [row.asDict() for row in prof]
    semantics = {c["column_name"]: c["semantic"] for c in columns}
    gaps = [c["column_name"] for c in columns if c["dtype"] == "datetime64" and 0 < c["null_count"] < c["row_count"]]
    if gaps and not order_by:
        raise ValueError(f"filling {gaps} needs order_by: rows have no order of their own")
    plan = validated_plan(heuristic_plan(columns) if plan is None else plan, df.columns)
    ratios = {c["column_name"]: c["unique_count"] / max(c["row_count"], 1) for c in columns}
    scored = profiles.feature_importance(df, top=None, ratios=ratios).collect()  # one row per column
    importance = {r["feature"]: r["importance_score"] for r in scored}
    staged = canonicalise(apply_plan(df, plan, number_types(df, plan)), semantics)
    if materialise:
        staged = replace_files(staged, scratch_path(spark, "staged"))
    required = [c for c, ops in plan.items() if "drop_row_if_null" in ops]
    usable = drop_incomplete_rows(drop_empty_rows(staged), required)
    rows, choices = fill_choices(usable, semantics, importance)
    data = apply_choices(usable, choices, order_by, partition_by)
    distinct = drop_repeated_rows(data) if drop_duplicates else data
    log = _log(spark, rows, staged, data, plan, columns, choices, required, drop_duplicates)
    return Cleaned(distinct, log, plan, choices)


def _log(spark, rows, staged, data, plan, columns, choices, required, dedup) -> DataFrame:
    """The steps by column, then the rows removed; their counts stay lazy.

    What a step leaves missing is counted over the rows that are kept.
    """
    before = {c["column_name"]: c["null_count"] for c in columns}
    by_name = {c.column: c for c in choices}
    steps = []
    for name in staged.columns:
        choice = by_name.get(name)
        left = choice.missing if choice else 0
        if name in plan:
            steps.append((len(steps), name, "preclean", ",".join(plan[name]), before[name], left, None, None))
        if choice:
            # An ordered fill reaches every row unless the whole column is null.
            filled_up = choice.value is not None or (choice.ordered is not None and left < rows)
            after = 0 if filled_up else left
            steps.append(
                (len(steps), name, "missing_value_imputation", choice.strategy, left, after, choice.preview, None)
            )
    empty = reduce(Column.__and__, [quoted(c).isNull() for c in staged.columns])
    incomplete = reduce(Column.__or__, [quoted(c).isNull() for c in required], F.lit(False))
    removed = staged.agg(
        F.count_if(empty).alias("all_columns_null"), F.count_if(~empty & incomplete).alias("required_columns_null")
    )
    removals = [
        _removal(len(steps) + i, reason, removed.select(F.col(reason).alias("removed")))
        for i, reason in enumerate(removed.columns)
    ]
    if dedup:
        copies = data.groupBy(*[quoted(c) for c in data.columns]).agg((F.count(F.lit(1)) - 1).alias("extra"))
        repeats = copies.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("removed"))
        removals.append(_removal(len(steps) + 2, "deduplicate", repeats))
    log = spark.createDataFrame(steps, LOG_SCHEMA)
    for part in removals:
        log = log.unionByName(part.where(F.col("rows_removed") > 0))
    return log.orderBy("step")


def row_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows in, rows out, rows removed."""
    counts = before.agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("m")).unionAll(
        after.agg(F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("m"))
    )
    total = counts.agg(F.sum("n").alias("original_count"), F.sum("m").alias("row_count"))
    return total.withColumn("rows_removed", F.col("original_count") - F.col("row_count"))
