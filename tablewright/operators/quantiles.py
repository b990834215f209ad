"""Exact order statistics without gathering a column in one task.

Spark's exact percentile keeps every distinct value of a column in one buffer.
Here each pass narrows an open interval around the wanted rank with approximate
percentiles and counts what lies below it; only an interval proven small is
sorted by a single task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

# An interval with at most this many rows is sorted by one task.
SMALL_INTERVAL = 200_000
ACCURACY = 10_000


@dataclass
class _Search:
    """One wanted rank: ``rows`` values lie strictly between ``low`` and ``high``."""

    name: str
    rank: int  # zero-based within the interval
    rows: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def inside(self, c: Column) -> Column:
        keep = c.isNotNull()
        if self.low is not None:
            keep = keep & (c > F.lit(self.low))
        if self.high is not None:
            keep = keep & (c < F.lit(self.high))
        return keep

    def narrow(self, a: float, b: float, below: int, at_a: int, between: int, at_b: int) -> None:
        """Keep the part of the interval that holds the rank."""
        parts = [
            (below, (self.low, a), None),
            (at_a, None, a),
            (between, (a, b), None),
            (at_b, None, b),
            (self.rows - below - at_a - between - at_b, (b, self.high), None),
        ]
        for count, bounds, value in parts:
            if self.rank < count:
                if bounds is None:
                    self.value = value
                else:
                    self.low, self.high = bounds
                    self.rows = count
                return
            self.rank -= count


def _finish(df: DataFrame, columns: dict[str, Column], searches: list[_Search]) -> None:
    """Rank the values of the small intervals, all columns in one job."""
    intervals: dict[tuple, list[_Search]] = {}
    for s in searches:
        intervals.setdefault((s.name, s.low, s.high), []).append(s)
    groups = list(intervals.values())
    entries = [
        F.struct(F.lit(i).alias("i"), F.when(g[0].inside(columns[g[0].name]), columns[g[0].name]).alias("v"))
        for i, g in enumerate(groups)
    ]
    values = df.select(F.explode(F.array(*entries)).alias("e")).select("e.i", "e.v").where("v IS NOT NULL")
    counted = values.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    # Each window partition is one interval, at most ``small`` rows.
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("v"))
    ranked = counted.withColumn("upto", upto)
    wanted = [
        F.min(F.when((F.col("i") == i) & (F.col("upto") > s.rank), F.col("v"))).alias(f"r{i}_{j}")
        for i, g in enumerate(groups)
        for j, s in enumerate(g)
    ]
    row = ranked.agg(*wanted).first()
    for i, g in enumerate(groups):
        for j, s in enumerate(g):
            s.value = row[f"r{i}_{j}"]


def _shrink(df: DataFrame, columns: dict[str, Column], searches: list[_Search]) -> None:
    margin = 2.0 / ACCURACY
    brackets = []
    for i, s in enumerate(searches):
        c = columns[s.name]
        middle = (s.rank + 0.5) / s.rows
        shares = [max(0.0, middle - margin), min(1.0, middle + margin)]
        brackets.append(F.percentile_approx(F.when(s.inside(c), c), shares, ACCURACY).alias(f"b{i}"))
    found = df.agg(*brackets).first()
    counts = []
    for i, s in enumerate(searches):
        c, (a, b) = columns[s.name], found[f"b{i}"]
        inside = s.inside(c)
        counts += [
            F.count_if(inside & (c < F.lit(a))).alias(f"below{i}"),
            F.count_if(inside & (c == F.lit(a))).alias(f"ata{i}"),
            F.count_if(inside & (c > F.lit(a)) & (c < F.lit(b))).alias(f"mid{i}"),
            F.count_if(inside & (c == F.lit(b)) & (c != F.lit(a))).alias(f"atb{i}"),
        ]
    row = df.agg(*counts).first()
    for i, s in enumerate(searches):
        a, b = found[f"b{i}"]
        s.narrow(a, b, row[f"below{i}"], row[f"ata{i}"], row[f"mid{i}"], row[f"atb{i}"])


def medians(
    df: DataFrame,
    columns: dict[str, Column],
    counts: dict[str, int] | None = None,
    small: int = SMALL_INTERVAL,
) -> dict[str, float | None]:
    """Exact median of each numeric expression (mean of the middle two when even)."""
    columns = {name: c.cast("double") for name, c in columns.items()}
    if not columns:
        return {}
    if counts is None:
        counts = df.agg(*[F.count(c).alias(name) for name, c in columns.items()]).first().asDict()
    searches = {}
    for name in columns:
        n = counts[name]
        if n:
            searches[name] = [_Search(name, r, n) for r in sorted({(n - 1) // 2, n // 2})]
    while True:
        waiting = [s for group in searches.values() for s in group if s.value is None]
        large = [s for s in waiting if s.rows > small]
        if not large:
            break
        _shrink(df, columns, large)
    if waiting:
        _finish(df, columns, waiting)
    return {
        name: sum(s.value for s in searches[name]) / len(searches[name]) if name in searches else None
        for name in columns
    }
