"""M1: exact, reproducible stratified train/test split.

Each row gets a pseudo-random but deterministic position from its key (two
rounds of the Lehmer generator, arithmetic any SQL engine reproduces), and the
first ceil(test_fraction * class size) positions of a class form the test set.
Only the last of them is looked for, by bracketed selection: no class is sorted.
Re-running, or losing an executor mid-way, gives the same split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrita import config as C
from attrita.operators.broadcast import bounded_local
from attrita.operators.prefix import null_safe_join
from attrita.operators.selection import at_ranks, sketch

LEHMER_A = 48271
LEHMER_M = 2147483647
MAX_BROADCAST_CLASSES = 10_000      # cut rows, one a class; more are joined by a shuffle


def split_hash(key: str) -> Column:
    """Two Lehmer steps; the key is reduced mod M first, so no product can
    overflow a long (ANSI mode raises on overflow)."""
    h0 = F.pmod(F.col(key), F.lit(LEHMER_M))
    h1 = F.pmod(h0 * F.lit(LEHMER_A), F.lit(LEHMER_M))
    return F.pmod(h1 * F.lit(LEHMER_A), F.lit(LEHMER_M))


def stratified_split(df: DataFrame, key: str = "customer_id", label: str = "exited",
                     test_fraction: float = C.TEST_FRACTION) -> DataFrame:
    """``df`` plus ``split`` in {"train", "test"}, exactly stratified by ``label``.

    The last test position of each class decides for its rows, so the full rows
    are not shuffled.  Rows that repeat a key within a class fall on the same
    side.  A row without key has no position and trains."""
    narrow = df.where(F.col(key).isNotNull()).select(label, split_hash(key).alias("_h"), F.col(key).alias("_k"))
    pct = int(round(test_fraction * 100))      # ceil(n * pct / 100) in integers
    brackets = narrow.groupBy(label).agg(F.count(F.lit(1)).alias("n"), sketch(F.col("_h"), [pct / 100]).alias("sketched"))
    last = lambda n: F.floor((n * F.lit(pct) + F.lit(99)) / F.lit(100)) - 1
    cuts = at_ranks(narrow, [label], "_h", brackets, [pct / 100], [("cut", last)], ties=["_k"])
    cuts = bounded_local(cuts.select(label, F.struct("_h", "_k").alias("_cut")), MAX_BROADCAST_CLASSES)
    placed = null_safe_join(df, cuts, [label], "left")
    in_test = F.col(key).isNotNull() & (F.struct(split_hash(key).alias("_h"), F.col(key).alias("_k")) <= F.col("_cut"))
    return placed.select(*df.columns, F.when(in_test, F.lit("test")).otherwise(F.lit("train")).alias("split"))
