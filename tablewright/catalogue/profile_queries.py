"""Profiling of the dirty orders view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalogue import views
from tablewright.catalogue.registry import query, rounded, table
from tablewright.catalogue.text_queries import case_of, quote
from tablewright.functions import lexicon
from tablewright.operators import profile as p

TYPES = {
    c: {"order_id": "int64", "quantity": "float64", "skewed_value": "float64"}.get(c, "object")
    for c in views.DIRTY_COLUMNS
}


def profile_sql(view: str, types: dict[str, str]) -> str:
    """One row per column, counted column by column."""
    return " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS column_name, '{t}' AS dtype, '{t}' AS type, COUNT(*) > COUNT({c}) AS nullable,
        COUNT(*) AS row_count, COUNT({c}) AS total_count, COUNT(*) - COUNT({c}) AS null_count,
        ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 1) AS null_pct, COUNT(DISTINCT {c}) AS unique_count FROM {view}"""
        for i, (c, t) in enumerate(types.items())
    )


def semantic_arms(rules: list[tuple[str, list[str]]], name: str = "lower(column_name)") -> str:
    arms = " ".join(
        f"WHEN {' OR '.join(f'contains({name}, {quote(w)})' for w in words)} THEN {quote(label)}" for label, words in rules
    )
    return f"CASE {arms} ELSE 'generic' END"


NAMED = semantic_arms(lexicon.SEMANTIC_WORDS)
SEMANTIC = """CASE WHEN total_count = 0 THEN 'unknown'
  WHEN named = 'generic' AND dtype = 'object' AND unique_count / total_count < 0.15 THEN 'category'
  WHEN named = 'generic' AND dtype = 'object' AND unique_count / total_count > 0.9 AND total_count > 50 THEN 'id'
  WHEN named = 'generic' AND dtype IN ('int64', 'float64') THEN 'count' ELSE named END"""


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


ROLE = f"""CASE WHEN {_any('lower(column_name)', lexicon.ID_NAME_WORDS)} THEN 'id'
  WHEN {_any('upper(type)', lexicon.DATE_TYPE_WORDS)} THEN 'date'
  WHEN {_any('upper(type)', lexicon.NUMERIC_TYPE_WORDS)} THEN CASE WHEN {_any('semantic', lexicon.CODED_CATEGORY_WORDS)} THEN 'categorical' ELSE 'numeric' END
  WHEN {_any('semantic', lexicon.CATEGORY_WORDS)} THEN 'categorical' ELSE 'text' END"""
CHART_ROLE = """CASE WHEN semantic IN ('money', 'count', 'score', 'percentage') OR contains(type, 'int') OR contains(type, 'float') OR contains(type, 'double') THEN 'numeric'
  WHEN semantic IN ('category', 'location', 'name') THEN 'category'
  WHEN semantic = 'datetime' OR contains(type, 'date') THEN 'date' END"""

PROFILE_CTES = f"""{views.DIRTY_SQL}, counted AS ({profile_sql('dirty', TYPES)}),
named AS (SELECT *, {NAMED} AS named FROM counted),
meant AS (SELECT *, {SEMANTIC} AS semantic FROM named),
profile AS (SELECT *, {ROLE} AS role, {CHART_ROLE} AS chart_role FROM meant)"""


def profile_of(then: str) -> str:
    return f"WITH {PROFILE_CTES} {then}"


def dirty_profile(spark, sf_dir):
    return p.with_role(p.with_semantic(p.column_profile(views.dirty(spark, sf_dir), samples=0)))


def _sample_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS column_name, string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) AS samples FROM "
        f"(SELECT DISTINCT {c} AS v FROM dirty WHERE {c} IS NOT NULL ORDER BY v LIMIT 3) t"
    )


@query(
    "p01_column_profile",
    profile_of(
        f"""SELECT position, c.column_name, dtype, type, nullable, row_count, total_count, null_count, null_pct, unique_count, samples
        FROM counted c JOIN ({' UNION ALL '.join(_sample_sql(c) for c in TYPES)}) s ON c.column_name = s.column_name"""
    ),
)
def column_profile(spark, sf_dir):
    found = p.column_profile(views.dirty(spark, sf_dir))
    return found.withColumn("samples", F.array_join("sample_values", "|")).drop("sample_values")


@query(
    "p01_approximate_profile",
    profile_of(
        """SELECT position, column_name, dtype, row_count, total_count, null_count, null_pct, TRUE AS close FROM counted"""
    ),
)
def approximate_profile(spark, sf_dir):
    """Distinct counts are checked to lie within 10 % of the exact ones."""
    df = views.dirty(spark, sf_dir)
    exact = p.column_profile(df, samples=0, dates=False).select("column_name", F.col("unique_count").alias("exact"))
    near = p.approximate_profile(df).join(exact, "column_name")
    close = F.abs(F.col("unique_count") - F.col("exact")) <= F.greatest(F.col("exact") * 0.1, F.lit(1))
    return near.withColumn("close", close).drop("unique_count", "exact")


_NUMBER_STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max, ROUND(AVG({c}), 4) AS mean FROM dirty"
    for c in ("order_id", "quantity", "skewed_value")
)


@query(
    "p02_numeric_profile",
    profile_of(
        f"""SELECT position, c.column_name, dtype, row_count, null_count, ROUND(null_count * 100.0 / row_count, 2) AS null_percentage, unique_count,
        CASE WHEN contains(c.column_name, 'date') OR contains(c.column_name, 'time') THEN 'datetime' WHEN dtype <> 'object' THEN 'numeric'
          WHEN unique_count / row_count < 0.05 THEN 'category' ELSE 'text' END AS semantic_type, min, max, mean
        FROM counted c LEFT JOIN ({_NUMBER_STATS}) n ON c.column_name = n.column_name"""
    ),
)
def numeric_profile(spark, sf_dir):
    return rounded(p.numeric_profile(views.dirty(spark, sf_dir)).drop("sample_values"))


@query(
    "p03_auto_types",
    profile_of(
        """SELECT position, column_name, CASE WHEN contains(column_name, 'date') OR contains(column_name, 'time') THEN 'date'
          WHEN dtype = 'int64' THEN 'integer' WHEN dtype = 'float64' THEN 'float'
          WHEN unique_count / row_count < 0.1 THEN 'string' ELSE 'text' END AS data_type, total_count > 0 AS is_required FROM counted"""
    ),
)
def auto_types(spark, sf_dir):
    return p.auto_types(p.column_profile(views.dirty(spark, sf_dir), samples=0, dates=False))


@query(
    "p04_workbook_semantics",
    profile_of(
        f"""SELECT position, column_name, CASE WHEN s = 'generic' AND dtype = 'object' AND unique_count / total_count < 0.1 THEN 'category' ELSE s END AS semantic
        FROM (SELECT *, {semantic_arms(lexicon.WORKBOOK_SEMANTIC_WORDS)} AS s FROM counted) t"""
    ),
)
def workbook_semantics(spark, sf_dir):
    return p.workbook_semantics(p.column_profile(views.dirty(spark, sf_dir), samples=0, dates=False))


@query("p05_semantic_by_name", profile_of("SELECT column_name, named AS semantic, total_count FROM named"))
def semantic_by_name(spark, sf_dir):
    found = p.null_counts(views.dirty(spark, sf_dir))
    return found.select("column_name", p.name_semantic(F.col("column_name")).alias("semantic"), "total_count")


@query("p06_semantic_by_cardinality", profile_of("SELECT column_name, semantic, unique_count FROM meant"))
def semantic_by_cardinality(spark, sf_dir):
    found = p.with_semantic(p.column_profile(views.dirty(spark, sf_dir), samples=0, dates=False))
    return found.select("column_name", "semantic", "unique_count")


_WORDS = ", ".join(
    f"({i}, {quote(kind)}, {weight}, {quote(w)})"
    for i, (kind, weights) in enumerate(lexicon.DATASET_TYPE_WORDS.items())
    for weight, words in weights.items()
    for w in words
)
_MEDICAL_NAMES = ", ".join(
    f"('{c}')"
    for c in ["patient_id", "age", "gender", "diagnosis", "department", "admission_date", "discharge_date", "treatment",
              "medication", "cost", "insurance", "outcome"]
)


@query(
    "p07_dataset_type",
    f"""SELECT kind AS dataset_type, CAST(SUM(weight) AS BIGINT) AS score, (SELECT COUNT(*) FROM events) AS row_count
    FROM (VALUES {_WORDS}) w(position, kind, weight, word) JOIN (VALUES {_MEDICAL_NAMES}) n(name) ON name = word
    GROUP BY kind ORDER BY score DESC, MIN(position) LIMIT 1""",
)
def dataset_type(spark, sf_dir):
    view = views.medical_view(spark, sf_dir)
    return p.dataset_type(p.column_list(view)).withColumn("row_count", view.agg(F.count(F.lit(1))).scalar())


@query("p08_roles", profile_of("SELECT position, column_name, semantic, role, chart_role FROM profile"))
def roles(spark, sf_dir):
    found = p.with_chart_role(dirty_profile(spark, sf_dir))
    return found.select("position", "column_name", "semantic", "role", "chart_role")


@query(
    "p09_suggested_queries",
    profile_of(
        """, first_of AS (SELECT role, MIN_BY(column_name, position) AS name FROM profile GROUP BY role),
        f AS (SELECT (SELECT name FROM first_of WHERE role = 'numeric') AS num, (SELECT name FROM first_of WHERE role = 'categorical') AS cat)
        SELECT place, suggestion FROM (SELECT 0 AS place, 'Show top 10 by ' || num AS suggestion FROM f
        UNION ALL SELECT 1, 'Total ' || num || ' by ' || cat FROM f UNION ALL SELECT 2, 'Average ' || num FROM f
        UNION ALL SELECT 3, 'Distribution of ' || cat FROM f UNION ALL SELECT 4, 'Bottom 5 ' || cat || ' by ' || num FROM f
        UNION ALL SELECT 5, 'How many records per ' || cat FROM f) t"""
    ),
)
def suggested_queries(spark, sf_dir):
    found = dirty_profile(spark, sf_dir)
    kind = p.dataset_type(found).first()["dataset_type"]
    offers = p.suggested_queries(p.roles(found), kind)
    return spark.createDataFrame(list(enumerate(offers)), "place int, suggestion string")


@query(
    "p10_dataset_description",
    profile_of(
        """SELECT 'Sales dataset with ' || format('{:,}', (SELECT COUNT(*) FROM dirty)) || ' rows and 10 columns ('
        || (SELECT COUNT(*) FROM profile WHERE role = 'numeric') || ' numeric, '
        || (SELECT COUNT(*) FROM profile WHERE role = 'categorical') || ' categorical, '
        || (SELECT COUNT(*) FROM profile WHERE role = 'text') || ' text). Key columns: '
        || '‘order_id’, ‘customer_name’, ‘gender’, ‘age’, ‘price’, ‘and 5 more’.' AS description"""
    ),
)
def dataset_description(spark, sf_dir):
    found = dirty_profile(spark, sf_dir)
    kind = p.dataset_type(found).first()["dataset_type"]
    rows = found.agg(F.max("row_count")).first()[0]
    text = p.describe_dataset(p.roles(found), views.DIRTY_COLUMNS, kind, rows)
    return spark.createDataFrame([(text,)], "description string")


# ---------------------------------------------------------------- likeness

DATE_SQL = "COALESCE(TRY_STRPTIME({c}, '%Y-%m-%d'), TRY_STRPTIME({c}, '%m/%d/%Y'))"
STRIPPED = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
NUMBER_RE = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
SPOKEN = "CASE lower({c}) WHEN 'twenty one' THEN '21' WHEN 'forty' THEN '40' WHEN 'thirty-five' THEN '35' ELSE {c} END"


def number_sql(c: str) -> str:
    """Text that is a number already."""
    text = STRIPPED.format(c=c)
    return f"CASE WHEN regexp_full_match({text}, '{NUMBER_RE}') THEN TRY_CAST({text} AS DOUBLE) END"


def messy_number_sql(c: str) -> str:
    kept = f"replace(regexp_replace({SPOKEN.format(c=STRIPPED.format(c=c))}, '[^0-9+.,-]', '', 'g'), ',', '')"
    return f"CASE WHEN regexp_full_match({kept}, '{NUMBER_RE}') THEN TRY_CAST({kept} AS DOUBLE) END"


def _date_share(c: str) -> str:
    shape = r"(\d{1,4}[-/]\d{1,2}[-/]\d{1,4}|\d{1,2}:\d{2}|[A-Za-z]{3,9}\s+\d{1,2})"
    return f"""SELECT '{c}' AS column_name, ROUND(a, 6) AS date_like_share, ROUND(b, 6) AS parsed_share, a >= 0.6 AND b >= 0.7 AS is_datetime FROM (
      SELECT COUNT(*) FILTER (WHERE regexp_matches({c}, '{shape}')) / COUNT({c}) AS a, COUNT({DATE_SQL.format(c=c)}) / COUNT(*) AS b FROM dirty) t"""


@query(
    "p11_date_likeness",
    views.with_views(views.DIRTY_SQL, then=" UNION ALL ".join(_date_share(c) for c in views.DIRTY_TEXT)),
)
def date_likeness(spark, sf_dir):
    return p.date_likeness(views.dirty(spark, sf_dir), views.DIRTY_TEXT)


def _number_share(c: str) -> str:
    intent = any(w in c for w in lexicon.NUMERIC_INTENT_WORDS)
    chosen = "b >= 0.2" if intent else "a >= 0.85"
    return f"""SELECT '{c}' AS column_name, ROUND(a, 6) AS numeric_share, ROUND(b, 6) AS cleaned_share, {intent} AS numeric_intent,
      {chosen} AS coerced_when_cleaning, a >= 0.7 AS numeric_in_reports FROM (
      SELECT COUNT({number_sql(c)}) / COUNT({c}) AS a, COUNT({messy_number_sql(c)}) / COUNT({c}) AS b FROM dirty) t"""


@query(
    "p12_numeric_likeness",
    views.with_views(views.DIRTY_SQL, then=" UNION ALL ".join(_number_share(c) for c in views.DIRTY_TEXT)),
)
def numeric_likeness(spark, sf_dir):
    return p.numeric_likeness(views.dirty(spark, sf_dir), views.DIRTY_TEXT)


# ---------------------------------------------------------------- importance and quality

_CORR = "abs(COALESCE(CORR({a}, {b}), 0))"


def _numeric_feature(c: str, others: list[str]) -> str:
    mean = "(" + " + ".join(_CORR.format(a=c, b=o) for o in others) + f") / {len(others)}"
    return f"""SELECT '{c}' AS feature, 'numeric' AS type, ROUND({mean}, 6) AS mean_abs_correlation, CAST(NULL AS DOUBLE) AS cardinality_ratio,
      ROUND(LN(0.7 * VAR_SAMP({c}) + 0.3 * {mean}), 6) AS log_score FROM dirty"""


def _text_feature(c: str) -> str:
    u = f"COUNT(DISTINCT {c}) / COUNT(*)"
    return f"""SELECT '{c}', 'categorical', NULL, ROUND({u}, 6), ROUND(LN(ROUND(0.4 * {u} + 0.2 * (1 - abs(0.5 - {u})), 6)), 6) FROM dirty"""


@query(
    "p13_feature_importance",
    views.with_views(
        views.DIRTY_SQL,
        then=" UNION ALL ".join(
            [_numeric_feature(c, [o for o in views.DIRTY_NUMBERS if o != c]) for c in views.DIRTY_NUMBERS]
            + [_text_feature(c) for c in views.DIRTY_TEXT]
        ),
    ),
)
def feature_importance(spark, sf_dir):
    """Scores span many magnitudes, so their logarithm is compared."""
    found = p.feature_importance(views.dirty(spark, sf_dir))
    return found.select(
        "feature", "type", "mean_abs_correlation", "cardinality_ratio", F.round(F.log("importance_score"), 6).alias("log_score")
    )


@query(
    "p14_quality_report",
    profile_of(
        """SELECT position, column_name, semantic, null_count, null_pct, unique_count,
        CASE WHEN null_pct > 20 THEN 'poor' WHEN null_pct > 5 THEN 'moderate' ELSE 'good' END AS quality,
        nullable AND null_pct > 5 AS null_issue, nullable AS has_nulls, unique_count = total_count AND total_count > 10 AS all_unique FROM profile"""
    ),
)
def quality_report(spark, sf_dir):
    return p.quality_report(dirty_profile(spark, sf_dir))


@query(
    "p14_quality_score",
    profile_of(
        """SELECT ROUND(GREATEST(0.0, 1.0 - SUM(null_count) / (MAX(row_count) * COUNT(*)) - 0.05 * COUNT(*) FILTER (WHERE null_pct > 5)), 2) AS overall_score,
        COUNT(*) FILTER (WHERE null_pct > 5) AS total_issues FROM profile"""
    ),
)
def quality_score(spark, sf_dir):
    return p.quality_score(p.null_counts(views.dirty(spark, sf_dir)))


@query(
    "p15_suggested_metrics",
    views.with_views(
        views.DIRTY_SQL,
        then="""SELECT 'Total Records' AS name, 'COUNT(*)' AS formula, CAST(COUNT(*) AS DOUBLE) AS value FROM dirty
        UNION ALL SELECT 'Total quantity', 'SUM(quantity)', SUM(quantity) FROM dirty
        UNION ALL SELECT 'Average quantity', 'AVG(quantity)', ROUND(AVG(quantity), 4) FROM dirty
        UNION ALL SELECT 'Total skewed_value', 'SUM(skewed_value)', ROUND(SUM(skewed_value), 4) FROM dirty
        UNION ALL SELECT 'Average skewed_value', 'AVG(skewed_value)', ROUND(AVG(skewed_value), 4) FROM dirty
        UNION ALL SELECT 'Distinct gender', 'COUNT(DISTINCT gender)', CAST(COUNT(DISTINCT gender) AS DOUBLE) FROM dirty""",
    ),
)
def suggested_metrics(spark, sf_dir):
    return rounded(p.suggested_metrics(views.dirty(spark, sf_dir), p.roles(dirty_profile(spark, sf_dir))))


@query(
    "p16_recommended_aggregates",
    views.with_views(
        views.SALES_SQL,
        then=" UNION ALL ".join(
            [
                f"SELECT '{c}' AS category, {c} AS label, '{m}' AS measure, ROUND(CAST(SUM({m}) AS DOUBLE), 4) AS total FROM sales GROUP BY {c}"
                for c in ("product", "region")
                for m in ("sales", "quantity")
            ]
            + ["SELECT 'month', strftime(date, '%Y-%m'), 'sales', ROUND(SUM(sales), 4) FROM sales GROUP BY 2"]
        ),
    ),
)
def recommended_aggregates(spark, sf_dir):
    columns = {"numeric": ["sales", "quantity", "total_revenue"], "categorical": ["product", "region"], "date": ["date"]}
    return rounded(p.recommended_aggregates(views.sales(spark, sf_dir), columns))


@query(
    "p16_rows_with_nulls",
    views.with_views(
        views.DIRTY_SQL,
        then=f"SELECT COUNT(*) FILTER (WHERE {' OR '.join(c + ' IS NULL' for c in TYPES)}) AS rows_with_nulls, COUNT(*) AS row_count FROM dirty",
    ),
)
def rows_with_nulls(spark, sf_dir):
    return p.rows_with_nulls(views.dirty(spark, sf_dir))


@query(
    "p17_null_summary",
    profile_of(
        """SELECT CAST(SUM(null_count) AS BIGINT) AS total_nulls, COUNT(*) FILTER (WHERE nullable) AS columns_with_nulls,
        ROUND(SUM(null_count) * 100.0 / (MAX(row_count) * COUNT(*)), 1) AS overall_null_percentage FROM profile"""
    ),
)
def null_summary(spark, sf_dir):
    return p.null_summary(p.null_counts(views.dirty(spark, sf_dir)))


@query(
    "p01_profile_of_documents",
    """SELECT 'text' AS column_name, COUNT(*) AS row_count, COUNT(DISTINCT text) AS unique_count FROM documents
    UNION ALL SELECT 'lang', COUNT(*), COUNT(DISTINCT lang) FROM documents
    UNION ALL SELECT 'n_chars', COUNT(*), COUNT(DISTINCT n_chars) FROM documents""",
)
def profile_of_documents(spark, sf_dir):
    """Whole texts, shuffled as digests."""
    docs = table(spark, sf_dir, "documents").select("text", "lang", "n_chars")
    return p.column_profile(docs, samples=0, dates=False).select("column_name", "row_count", "unique_count")
