"""Binning expressions.

The dashboard bins with right-closed intervals (a, b]; Spark's Bucketizer and
width_bucket are left-closed, so the bins are written as CASE WHEN chains.
A value outside every interval gets a null code rather than an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def right_closed_bin(col: Column | str, edges: list[float]) -> Column:
    """Code 1..len(edges)-1 for (e0,e1], (e1,e2], ...; null when out of range."""
    c = F.col(col) if isinstance(col, str) else col
    branches = [((c > lo) & (c <= hi), i + 1) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    first_cond, first_val = branches[0]
    expr = F.when(first_cond, F.lit(first_val))
    expr = reduce(lambda acc, b: acc.when(b[0], F.lit(b[1])), branches[1:], expr)
    return expr.cast("int")


def equal_width_bin(col: Column | str, lo: float, hi: float, n: int, right_closed: bool = True) -> Column:
    """Equal-width bin of ``col`` over [lo, hi] with ``n`` bins.

    right_closed=True: codes 1..n, (lo+(k-1)w, lo+kw], the minimum falls in 1
    (interval binning).  right_closed=False: codes 0..n-1, [lo+kw, lo+(k+1)w),
    the maximum falls in the last bin (histogram binning).  A zero-width range
    puts everything in the middle (interval) or first (histogram) bin.
    """
    c = F.col(col) if isinstance(col, str) else col
    if hi == lo:
        return F.lit((n + 1) // 2 if right_closed else 0).cast("int")
    w = (hi - lo) / n
    if right_closed:
        return F.least(F.lit(n), F.greatest(F.lit(1), F.ceil((c - F.lit(lo)) / F.lit(w)))).cast("int")
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((c - F.lit(lo)) / F.lit(w)))).cast("int")
