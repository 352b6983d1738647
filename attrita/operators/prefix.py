"""Running totals over a globally ordered key, without a single-task window.

A window ``ORDER BY key`` with no PARTITION BY sends every row to one task.
Here the rows are range-partitioned by (group, key): each partition, called a
bucket, holds one stretch of the global order, and a group with many rows
spreads over many buckets.  The rows are written with their bucket number, so
a recomputed task can't cut the ranges differently.  Each (group, bucket) pair
has one total, at most groups + buckets rows in all, from which the offset of
each bucket follows; the running sum itself runs inside ``PARTITION BY (group,
bucket)`` windows.  The result is exact; the ranges only shape the buckets.
A NULL group is a group like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrita.sources.sinks import materialize


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL meets NULL; plain equality on columns that can't be NULL."""
    own = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) if left.schema[k].nullable else F.col(k) == F.col(f"_r_{k}") for k in keys]
    return left.join(own, on, how).drop(*[f"_r_{k}" for k in keys])


def ordered_cumulative(df: DataFrame, group_cols: list[str], order_col: str,
                       weight_cols: list[str], tiebreak_cols: list[str] | None = None,
                       n_buckets: int | None = None) -> DataFrame:
    """Add ``cum_<w>`` (the sum of ``w`` over rows of the same group up to and
    including this row, ordered by ``order_col`` then ``tiebreak_cols``) and
    ``total_<w>`` (the group's total) to every row.

    ``n_buckets`` defaults to the session's shuffle partitions.  Rows that are
    equal in group, order and tiebreak columns share a bucket, in any order.
    """
    g = list(group_cols)
    order = [order_col, *(tiebreak_cols or [])]
    ranged = df.repartitionByRange(*([n_buckets] if n_buckets else []), *g, *order)
    bucketed = materialize(ranged.withColumn("_bucket", F.spark_partition_id()), "ordered")
    totals = bucketed.groupBy(*g, "_bucket").agg(*[F.sum(w).alias(f"_tot_{w}") for w in weight_cols])
    # A group has one row per bucket that it reaches, so these windows are small.
    whole = Window.partitionBy(*g)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *g, "_bucket",
        *[F.coalesce(F.sum(f"_tot_{w}").over(before), F.lit(0)).alias(f"_off_{w}") for w in weight_cols],
        *[F.sum(f"_tot_{w}").over(whole).alias(f"total_{w}") for w in weight_cols])
    run = (Window.partitionBy(*g, "_bucket").orderBy(*order)
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return null_safe_join(bucketed, offsets, g + ["_bucket"]).select(
        *df.columns, *[F.col(f"total_{w}") for w in weight_cols],
        *[(F.col(f"_off_{w}") + F.sum(w).over(run)).alias(f"cum_{w}") for w in weight_cols])
