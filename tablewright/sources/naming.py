"""Names of tables and columns."""

from __future__ import annotations

import itertools
import re
import string
from pathlib import PurePosixPath

from pyspark.sql import DataFrame

# Fixed value: what counts as a table or column identifier.
IDENTIFIER = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]{0,127}")


def is_identifier(name: object) -> bool:
    return isinstance(name, str) and IDENTIFIER.fullmatch(name) is not None


# Characters of a table name; any other becomes an underscore.
_TABLE_CHARACTERS = frozenset(string.ascii_letters + string.digits)


def table_name(file_name: str) -> str:
    """'2024 Sales-Q1.csv' -> '_sales_q1'; 'data_table' when nothing is left."""
    name = PurePosixPath(file_name.replace("/", "_"))
    marks = (c.lower() if c in _TABLE_CHARACTERS else "_" for c in name.stem)
    return "".join(itertools.dropwhile(str.isdigit, marks)) or "data_table"


def stage_names(file_name: str) -> tuple[str, str]:
    """(raw table, clean table) for a file; a '_clean' suffix of the file is not repeated."""
    stem = file_name.rsplit("/", 1)[-1]
    stem = stem.rsplit(".", 1)[0] if "." in stem.lstrip(".") else stem
    if stem.lower().endswith("_clean"):
        stem = stem[: -len("_clean")]
    return table_name(f"{stem}_raw"), table_name(f"{stem}_clean")


# A word of a column name: letters and digits; other symbols than these separators are passed over.
_SEPARATORS = re.compile(r"[ _-]+")


def column_name(name: object) -> str:
    """Lower case, words joined by single underscores, other symbols dropped."""
    pieces = _SEPARATORS.split(str(name or "").strip().lower()) if name is not None else []
    words = ["".join(filter(str.isalnum, piece)) for piece in pieces]
    return "_".join(filter(None, words)) or "unnamed_column"


def column_names(names: list) -> list[str]:
    """Normalised names, made unique by a numeric suffix."""
    seen: set[str] = set()
    out = []
    for raw in names:
        base = name = column_name(raw)
        n = 1
        while name in seen:
            n += 1
            name = f"{base}_{n}"
        seen.add(name)
        out.append(name)
    return out


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*column_names(df.columns))
