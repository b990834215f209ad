"""Aggregate expressions whose edge cases differ from Spark's built-ins."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def varies(c: Column) -> Column:
    """True when a column has two different values.

    The spread of a constant is not exactly 0 once partial results are merged.
    """
    return F.min(c) < F.max(c)


def corrected_skew(c: Column) -> Column:
    """Bias-corrected skewness; 0 for constants and for fewer than three values."""
    n = F.count(c)
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when((n > 2) & varies(c), F.coalesce(F.skewness(c) * factor, F.lit(0.0))).otherwise(F.lit(0.0))


def pairwise_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are present; 0 where undefined."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a).cast("double"), F.when(both, b).cast("double")
    spread = F.stddev_samp(x) * F.stddev_samp(y)
    return F.when(varies(x) & varies(y), F.try_divide(F.covar_samp(x, y), spread)).otherwise(F.lit(0.0))


def variance(c: Column) -> Column:
    return F.when(varies(c), F.var_samp(c)).otherwise(F.lit(0.0))


def share(condition: Column, of: Column) -> Column:
    """Fraction of the rows satisfying ``of`` that also satisfy ``condition``; 0 when there are none."""
    return F.coalesce(F.try_divide(F.count_if(condition & of), F.count_if(of)), F.lit(0.0))


def percent(part: Column, whole: Column, digits: int) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits)
