"""Rule-based tags for columns of commands, statements and questions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tablewright.functions import lexicon
from tablewright.functions.text import contains_any, first_match


def command_intent(c: Column) -> Column:
    """What a command asks for; 'help' when nothing matches."""
    return first_match(F.lower(c), lexicon.INTENT_WORDS, "help")


def statement_verdict(c: Column, strict: bool = False) -> Column:
    """Struct (is_safe, reason) for a SQL statement.

    The strict rules refuse any occurrence of a data-changing keyword.
    """
    text = F.upper(c)
    reason = None
    if strict:
        for word in lexicon.STRICT_WORDS:
            hit, why = text.contains(word), F.lit(f"{word} is not allowed")
            reason = F.when(hit, why) if reason is None else reason.when(hit, why)
    else:
        for pattern, why in lexicon.STATEMENT_RULES:
            hit = text.rlike(pattern)
            reason = F.when(hit, F.lit(why)) if reason is None else reason.when(hit, F.lit(why))
    return F.struct(reason.isNull().alias("is_safe"), F.coalesce(reason, F.lit("OK")).alias("reason"))


def requested_limit(c: Column, default: int | None = 10) -> Column:
    """The n of 'top n', 'first n' or 'limit n', else a spelled-out limit, else ``default``."""
    text = F.lower(c)
    digits = F.regexp_extract(text, r"(?:top|first|limit)\s+([0-9]+)", 1)
    spoken = None
    for n, words in lexicon.SPOKEN_LIMITS:
        hit = contains_any(text, words)
        spoken = F.when(hit, F.lit(n)) if spoken is None else spoken.when(hit, F.lit(n))
    return F.coalesce(digits.try_cast("int"), spoken, F.lit(default).cast("int"))


def question_pattern(c: Column, patterns: list[str] | None = None) -> Column:
    """The first named query whose words occur in the question; null when none does."""
    names = list(lexicon.PATTERN_WORDS) if patterns is None else patterns
    rules = {n: lexicon.PATTERN_WORDS[n] for n in names if n in lexicon.PATTERN_WORDS}
    return first_match(F.lower(c), rules, None)
