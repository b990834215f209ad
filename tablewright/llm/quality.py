"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import GAPS

#: Frequent function words of the corpus's four languages.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as this by at are an from "
    "der die und den von das ist im mit des zu nicht ein eine dem als auch sich "
    "la de que el en y los las una por con para del se al no su es "
    "le et les est dans du au qui sur pour un pas ce une des"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= counted / per <= high``; names refer to the counts below."""

    name: str
    counted: str
    per: str
    low: float | None = None
    high: float | None = None


#: The thresholds. A ratio over nothing is 0.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.5, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("exclamations_per_word", "n_exclamations", "n_words", None, 0.5),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.06, None),
    Rule("repeated_line_share", "n_dup_lines", "n_lines", None, 0.6),
    Rule("bullet_line_share", "n_bullet_lines", "n_lines", None, 0.9),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


#: The counts that rules may refer to.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations", "n_stop_words", "n_bullet_lines")


def _apart(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with its columns renamed by place, which no scratch column or result is named like; the text's new name."""
    names = [f"_own_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index(text_col)]


def _back(found: DataFrame, docs: DataFrame, results: list[str]) -> DataFrame:
    """``found`` with the names of ``docs`` again, without those of its columns that are named like a result in any case."""
    taken = {r.lower() for r in results}
    return found.select(*[F.col(f"_own_{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in taken], *results)


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The counts that rules refer to, beside the columns of ``docs`` that are not named like them."""
    return _back(_counted(*_apart(docs, text_col)), docs, list(COUNTS))


def _counted(docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of ``docs`` and its counts.

    Words are runs without white space. ``n_repeat_words`` counts words lying in a window of three words that
    the text holds at least twice: windows are sorted with their places and compared with their neighbours, so
    a text costs n log n whatever it repeats. A null text has no words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, GAPS), "")
    base = docs.withColumn("_text", text).withColumn("_words", words)
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("_words")
    spots = F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    size = F.greatest(n - 2, F.lit(0))
    windows = F.arrays_zip(
        F.slice("_words", 1, size).alias("a"), F.slice("_words", 2, size).alias("b"), F.slice("_words", 3, size).alias("c"), spots.alias("i")
    )
    base = base.withColumn("_lines", lines).withColumn("_windows", F.sort_array(windows))
    # Equal windows are neighbours now.
    pairs = F.arrays_zip(F.col("_windows").alias("x"), F.slice("_windows", 2, F.greatest(F.size("_windows") - 1, F.lit(0))).alias("y"))
    twice = F.filter(pairs, lambda p: (p["x"]["a"] == p["y"]["a"]) & (p["x"]["b"] == p["y"]["b"]) & (p["x"]["c"] == p["y"]["c"]))
    base = base.withColumn("_twice", twice)
    starts = F.concat(F.transform("_twice", lambda p: p["x"]["i"]), F.transform("_twice", lambda p: p["y"]["i"]))
    base = base.withColumn("_starts", starts)
    covered = F.array_distinct(F.concat("_starts", F.transform("_starts", lambda i: i + 1), F.transform("_starts", lambda i: i + 2)))
    stop = [w for s in STOP_WORDS for w in (s, s.capitalize())]
    measures = (
        n,
        F.length(F.array_join("_words", "")),
        _without(F.col("_text"), r"[#*$%&|<>]+"),
        F.size("_lines") - F.size(F.array_distinct("_lines")),
        F.size(covered),
        F.size("_lines"),
        F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("!"), F.lit(""))),
        F.size(F.filter("_words", lambda w: w.isin(stop))),
        F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))),
    )
    return base.select(*docs.columns, *[m.cast("long").alias(k) for k, m in zip(COUNTS, measures)])


def verdicts(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """One boolean column for each rule, over the counts."""
    out = []
    for r in rules:
        ratio = F.when(F.col(r.per) > 0, F.col(r.counted) / F.col(r.per)).otherwise(F.lit(0.0))
        test = F.lit(True)
        if r.low is not None:
            test = test & (ratio >= r.low)
        if r.high is not None:
            test = test & (ratio <= r.high)
        out.append(test.alias(f"ok_{r.name}"))
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with its counts, one ``ok_`` column for each rule, ``base_failed`` and ``kept``.

    Built-in functions in one projection, without a shuffle. Null and empty texts fail the base, texts of any length
    are judged whole, repeated rows are judged alike and no rows give none. A column of ``docs`` named like a result,
    in any case, gives way to the result; other columns stay whatever their names.
    """
    results = [*COUNTS, *(f"ok_{r.name}" for r in rules), "base_failed", "kept"]
    return _back(_judged(*_apart(docs, text_col), rules), docs, results)


def _judged(docs: DataFrame, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    base = _counted(docs, text_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = base.select("*", *verdicts(rules), failed.alias("base_failed"))
    passed = ~F.col("base_failed")
    for r in rules:
        passed = passed & F.col(f"ok_{r.name}")
    return judged.withColumn("kept", passed)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that every rule keeps, with their own columns only."""
    packed, text = _apart(docs, text_col)
    # Needed by the filter, the row number keeps it above the counts; pushed below them it would repeat them for each rule.
    numbered = _judged(packed, text, rules).withColumn("_row", F.monotonically_increasing_id())
    return numbered.where("kept and _row >= 0").select(*packed.columns).toDF(*docs.columns)
