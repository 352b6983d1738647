"""Statistical expressions that stay defined under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Doubles from different engines may differ in the last bits; reported
# statistics are rounded to this many places.
STAT_PLACES = 6


def safe_corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation, null (not an error) when either side is constant."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def rnd(c: Column | str, places: int = STAT_PLACES) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, places)


def pct(num: Column, den: Column) -> Column:
    """100 * num / den as a double; null when den is zero."""
    return F.try_divide(num.cast("double") * F.lit(100.0), den.cast("double"))
