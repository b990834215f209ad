"""Run registered queries next to their SQL twins."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return datetime.datetime(value.year, value.month, value.day).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def sorted_rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def difference(df, con, sql: str) -> str | None:
    """What differs between a Spark result and its SQL twin; None when nothing does."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    expected = sorted_rows(names, cursor.fetchall())
    found = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(found) != len(expected):
        return f"{len(found)} rows != {len(expected)}"
    for a, b in zip(found, expected):
        if a != b:
            return f"{sorted(names)}: spark {a} != sql {b}"
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for n, t in types.items():
        if not same_type(kinds[n], t):
            return f"type of {n}: {kinds[n]} != {t}"
    return None


def same_type(spark: str, duck: str) -> bool:
    wanted = {
        "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
        "date": "DATE", "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]",
    }
    return wanted.get(spark, spark) == duck


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tablewright.session import local_session

    sf_dir = argv[0]
    wanted = argv[1:]
    spark = local_session(8)
    con = connect(sf_dir)
    oracles, bad, total = entry.oracle_sql(), 0, 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        total += 1
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            verdict = difference(df, con, oracles[name]) if name in oracles else f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            verdict = f"ERROR {type(e).__name__}: {str(e)[:300]}"
        failed = verdict is not None and not verdict.startswith("rows only")
        bad += failed
        print(f"{'FAIL' if failed else 'ok  '} {time.time() - start:6.2f}s {name} {(verdict or '')[:600]}", flush=True)
    print(f"{total - bad}/{total} match")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
