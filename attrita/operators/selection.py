"""Exact values at given ranks, without sorting the column.

A mergeable quantile sketch (``percentile_approx``, rank error at most
1 / accuracy of the rows) brackets each wanted rank.  One more pass then counts
the values outside the brackets in bulk and those inside by value, both
combined before the shuffle: of the column itself only the distinct values
inside the brackets, a share of about 8 / accuracy of the rows for each rank,
reach a reducer.  The ranks follow from running counts over those few rows.

Zones: with brackets [lo_i, hi_i] in rank order, a value's zone is the number
of lo_i it reaches plus the number of hi_i it passes.  Zones rise with the
value, and a value lies in some bracket where it has reached more lo_i than it
has passed hi_i.  Each value has one zone, so no row is copied for several
ranks.  A rank outside its bracket would be an error, never a wrong value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrita.operators.broadcast import bounded_local
from attrita.operators.prefix import null_safe_join

#: Accuracy of the sketch, and the share of the rows that a bracket leaves on each side of its rank.
ACCURACY = 10_000
MARGIN = 4 / ACCURACY
#: Groups up to this number go to the tasks as one local table; more are joined by a shuffle.
MAX_GROUPS = 10_000


def bracket_shares(shares: Sequence[float]) -> list[float]:
    """What the sketch is asked for: a lower and an upper share for each wanted one."""
    return [x for p in shares for x in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]


def sketch(value: Column, shares: Sequence[float]) -> Column:
    """Aggregate: the brackets of ``shares``, as an array (lo, hi, lo, hi, ...)."""
    return F.percentile_approx(value, bracket_shares(shares), ACCURACY)


def _zone(value: Column, n: Column, sketched: Column, shares: Sequence[float]) -> tuple[Column, Column]:
    """The zone of ``value`` and whether it lies in a bracket.  Of few rows the
    margin is no whole rank: then, and at either end, a bracket has no bound."""
    few = n * F.lit(MARGIN) < 2
    reached, passed = F.lit(0), F.lit(0)
    for i, p in enumerate(shares):
        reached = reached + F.when(few | F.lit(p <= MARGIN) | (value >= sketched[2 * i]), 1).otherwise(0)
        passed = passed + F.when(few | F.lit(p >= 1 - MARGIN) | (value <= sketched[2 * i + 1]), 0).otherwise(1)
    return reached + passed, reached > passed


def at_ranks(df: DataFrame, keys: list[str], value: str, brackets: DataFrame, shares: Sequence[float],
             wanted: Sequence[tuple[str, Callable[[Column], Column]]], ties: Sequence[str] = ()) -> DataFrame:
    """Rows (keys..., ``value``, ties..., n, target): for each group and each
    (target, rank of n) of ``wanted``, the row at that rank (from 0) in the order
    of ``value`` and ``ties``; ranks outside 0..n-1 give no row.

    ``df`` has no null in ``value`` or ``ties``.  ``brackets``: keys..., n and
    ``sketched``, the group's sketch of ``shares``; each wanted rank is near one
    of the shares."""
    small = bounded_local(brackets.select(*keys, "n", "sketched"), MAX_GROUPS)
    rows = null_safe_join(df.select(*keys, value, *ties), small, keys) if keys else df.select(value, *ties).crossJoin(F.broadcast(small))
    zone, inside = _zone(F.col(value), F.col("n"), F.col("sketched"), shares)
    kept = [F.when(F.col("_inside"), F.col(c)).alias(c) for c in (value, *ties)]
    counts = (rows.withColumn("_zone", zone).withColumn("_inside", inside)
              .select(*keys, "n", "_zone", "_inside", *kept)
              .groupBy(*keys, "n", "_zone", "_inside", value, *ties).agg(F.count(F.lit(1)).alias("_rows")))
    order = Window.partitionBy(*keys).orderBy("_zone", value, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = counts.withColumn("_end", F.sum("_rows").over(order)).withColumn("_start", F.col("_end") - F.col("_rows"))
    hits = F.array_compact(F.array(*[
        F.when((F.col("_start") <= rank(F.col("n"))) & (rank(F.col("n")) < F.col("_end")), F.lit(name)) for name, rank in wanted]))
    found = held.withColumn("_hits", hits).where(F.size("_hits") > 0)
    sure = F.when(F.col("_inside"), F.col("_hits")).otherwise(F.raise_error(F.lit("a rank outside its bracket")).cast("array<string>"))
    return found.select(*keys, value, *ties, "n", F.explode(sure).alias("target"))
