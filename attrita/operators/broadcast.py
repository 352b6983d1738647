"""Broadcast only what is proven small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast if ``df`` has at most ``max_rows`` rows, else leave it.

    The check reads at most ``max_rows + 1`` rows, so it stays cheap; beyond
    the bound the join is left to a shuffle (and AQE may still switch it).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def bounded_local(df: DataFrame, max_rows: int) -> DataFrame:
    """A table of at most ``max_rows`` rows as a local, broadcast one, computed
    once; a larger one is returned as it is.  At most ``max_rows + 1`` rows
    reach the driver."""
    rows = df.limit(max_rows + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= max_rows else df
