"""Guarded number and date parsing: bad input becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tablewright.functions.text import spoken_number, strip

# Plain decimal or scientific notation. Guards the cast, which would also take '1d'.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Text looks like a date when one of these shapes occurs in it.
DATE_SHAPE = r"(?:\d{1,4}[-/]\d{1,2}[-/]\d{1,4}|\d{1,2}:\d{2}|[A-Za-z]{3,9}\s+\d{1,2})"

ISO_TIMESTAMP = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2}(\.[0-9]{1,9})?)?)?"

# An ISO time with its zone; the result is the time in UTC.
ZONED_TIMESTAMP = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})"

# Accepted beside ISO: shape -> Spark patterns, in order of preference. The month comes before the day where both fit.
DATE_FORMATS = {
    r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}": ["M/d/yyyy H:mm", "d/M/yyyy H:mm"],
    r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}": ["M/d/yyyy H:mm:ss", "d/M/yyyy H:mm:ss"],
    r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2} [AP]M": ["M/d/yyyy h:mm a", "d/M/yyyy h:mm a"],
    r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{2} [AP]M": ["yyyy-M-d h:mm a"],
    r"[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}": ["M-d-yyyy", "d-M-yyyy"],
    r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}": ["M/d/yy", "d/M/yy"],
    r"[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}": ["d-MMM-yyyy"],
    r"(19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])": ["yyyyMMdd"],
    r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}": ["M/d/yyyy", "d/M/yyyy"],
    r"[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}": ["yyyy/M/d"],
    r"[A-Za-z]{3} [0-9]{1,2},? [0-9]{4}": ["MMM d[,] yyyy"],
    r"[A-Za-z]{4,9} [0-9]{1,2},? [0-9]{4}": ["MMMM d[,] yyyy"],
    r"[0-9]{1,2} [A-Za-z]{3} [0-9]{4}": ["d MMM yyyy"],
    r"[0-9]{1,2} [A-Za-z]{4,9} [0-9]{4}": ["d MMMM yyyy"],
}


def number_text(c: Column, messy: bool = False, stripped: bool = False) -> Column:
    """The digits that text stands for, ready for a cast; null where it is no number.

    ``messy`` takes text such as '$1,234.50 USD' or 'twenty one' too. ``stripped`` tells that white space is gone.
    """
    text = c if stripped else strip(c)
    found = F.when(text.rlike(NUMBER), text)
    if not messy:
        return found
    digits = F.replace(F.regexp_replace(text, r"[^0-9+.,-]", ""), F.lit(","), F.lit(""))
    return found.when(text.rlike("[0-9]"), digits).otherwise(spoken_number(text).cast("string"))


def parse_number(c: Column, stripped: bool = False) -> Column:
    """Coerce text that is already a number."""
    return number_text(c, stripped=stripped).try_cast("double")


def parse_messy_number(c: Column, stripped: bool = False) -> Column:
    """Coerce text such as '$1,234.50 USD' or 'twenty one'; plain numbers are taken as they are."""
    return number_text(c, messy=True, stripped=stripped).try_cast("double")


# Every decimal number of so many digits is told from all others as a double.
DOUBLE_DIGITS, LONG_DIGITS, DECIMAL_DIGITS = 15, 18, 38


def digit_facts(digits: Column) -> dict[str, Column]:
    """Aggregates over number texts: the most digits before and behind the point, the most of one number, exponents."""
    plain = F.regexp_replace(digits, "^[+-]|[eE].*$", "")
    whole = F.ltrim(F.substring_index(plain, ".", 1), F.lit("0"))
    part = F.rtrim(F.when(plain.contains("."), F.substring_index(plain, ".", -1)).otherwise(F.lit("")), F.lit("0"))
    own = F.length(F.ltrim(F.concat(whole, part), F.lit("0")))
    return {
        "whole": F.max(F.length(whole)), "scale": F.max(F.length(part)), "digits": F.max(own),
        "exponents": F.count_if(digits.rlike("[eE]")),
    }


def exact_type(facts: dict) -> str | None:
    """The type that tells all of a column's numbers apart, from its digit facts; None when only text does.

    Double while no number has more digits than a double keeps, else bigint for whole numbers that fit, else a
    decimal of the digits found.
    """
    if (facts["digits"] or 0) <= DOUBLE_DIGITS:
        return "double"
    if facts["exponents"] or facts["whole"] + facts["scale"] > DECIMAL_DIGITS:
        return None
    if not facts["scale"] and facts["whole"] <= LONG_DIGITS:
        return "bigint"
    return f"decimal({facts['whole'] + facts['scale']},{facts['scale']})"


def parse_timestamp(c: Column, stripped: bool = False) -> Column:
    """Coerce text in any accepted format to a zone-less timestamp."""
    text = c if stripped else strip(c)
    parsed = F.when(text.rlike(_whole(ISO_TIMESTAMP)), text.try_cast("timestamp_ntz"))
    parsed = parsed.when(text.rlike(_whole(ZONED_TIMESTAMP)), F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz"))
    for shape, patterns in DATE_FORMATS.items():
        tries = [F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz") for p in patterns]
        parsed = parsed.when(text.rlike(_whole(shape)), F.coalesce(*tries) if len(tries) > 1 else tries[0])
    # Most text has no accepted shape at all and is settled by one test.
    return F.when(text.rlike(_whole("|".join([ISO_TIMESTAMP, ZONED_TIMESTAMP, *DATE_FORMATS]))), parsed)


def _whole(shape: str) -> str:
    return f"^({shape})$"


def looks_like_date(c: Column) -> Column:
    return c.rlike(DATE_SHAPE)


def half_even_integer(c: Column) -> Column:
    """Cast a double to int with ties to even; values out of range become null."""
    return F.rint(c).try_cast("int")
