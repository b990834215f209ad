"""String cleaning as Column expressions."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, functions as F

# Every character Python treats as white space.
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())

# Only text made of letters, spaces and hyphens can be a number in words.
WORDS_ONLY = r"(?U)^[A-Za-z\s-]+$"

# English number words.
SMALL_NUMBERS = {
    "zero": 0,
    "one": 1,
    "two": 2,
    "three": 3,
    "four": 4,
    "five": 5,
    "six": 6,
    "seven": 7,
    "eight": 8,
    "nine": 9,
    "ten": 10,
    "eleven": 11,
    "twelve": 12,
    "thirteen": 13,
    "fourteen": 14,
    "fifteen": 15,
    "sixteen": 16,
    "seventeen": 17,
    "eighteen": 18,
    "nineteen": 19,
}
ROUND_TENS = {
    "twenty": 20,
    "thirty": 30,
    "forty": 40,
    "fifty": 50,
    "sixty": 60,
    "seventy": 70,
    "eighty": 80,
    "ninety": 90,
}

# The canonical gender label of each accepted spelling.
GENDER_LABELS = {
    "f": "Female",
    "female": "Female",
    "m": "Male",
    "male": "Male",
    "other": "Other",
    "non-binary": "Other",
    "nonbinary": "Other",
    "nb": "Other",
}


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def strip(c: Column) -> Column:
    """Remove all leading and trailing white space."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def lowercase(c: Column) -> Column:
    return F.lower(c)


def _spoken_numbers() -> dict[str, int]:
    """Every phrase understood: the words themselves, and tens followed by a small number."""
    pairs = {f"{ten} {word}": high + low for ten, high in ROUND_TENS.items() for word, low in SMALL_NUMBERS.items()}
    return SMALL_NUMBERS | ROUND_TENS | pairs


def spoken_number(c: Column) -> Column:
    """'forty' -> 40, 'Twenty-one' -> 21; null for anything else."""
    phrase = F.regexp_replace(strip(F.replace(F.lower(c), F.lit("-"), F.lit(" "))), r"(?U)\s+", " ")
    return F.when(c.rlike(WORDS_ONLY), F.try_element_at(literal_map(_spoken_numbers()), phrase))


def number_words(c: Column) -> Column:
    """Number words as digits; every other value is returned unchanged."""
    return F.coalesce(spoken_number(c).cast("string"), c)


def canonical(c: Column, labels: dict[str, str] = GENDER_LABELS) -> Column:
    """Replace known spellings by their label; unknown values stay as they are."""
    return F.coalesce(F.try_element_at(literal_map(labels), F.lower(strip(c))), c)


def replace_values(c: Column, mapping: dict[str, str]) -> Column:
    """Exact value replacement, other values unchanged."""
    return F.coalesce(F.try_element_at(literal_map(mapping), c), c)


def contains_any(c: Column, words: list[str]) -> Column:
    """True when the text contains at least one of the words.

    A word that contains another word of the list cannot add a hit and is not searched for.
    """
    needed = [w for w in dict.fromkeys(words) if not any(o != w and o in w for o in words)]
    return reduce(Column.__or__, [c.contains(w) for w in needed])


def first_match(c: Column, rules: dict[str, list[str]], default: str | None) -> Column:
    """The key of the first rule (in order) with a word contained in the text."""
    tag = None
    for label, words in rules.items():
        hit = contains_any(c, words)
        tag = F.when(hit, F.lit(label)) if tag is None else tag.when(hit, F.lit(label))
    return tag.otherwise(F.lit(default))
