"""A17 for wide tables: Pearson correlations of any number of columns from blocked Gram sums.

Columns are cut into blocks of ``BLOCK``.  For each pair of blocks the tasks
read those columns only and add up outer products of their rows as matrix
products, one set of sums a task; sets are then added in a tree, ``FAN`` at a
time.  So a task's memory depends on the block size alone, and what is shuffled
on the number of tasks, not of rows.

Correlations are pairwise complete, as in the original's data frames: a row
counts for a pair if it has both values (NULL and NaN are missing).  Values are
centred on their columns' means first, which keeps the sums of squares exact
enough for any offset.  A pair without variation has no correlation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrita.functions.stats import rnd

BLOCK = 256
FAN = 32
SUMS = "i int, j int, branch long, sums array<double>"
#: A pair's sums: rows, a, b, a a, b b, a b.
_KINDS = 6


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])


def _row(i: int, j: int, sums: np.ndarray) -> pa.RecordBatch:
    branch = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([branch], pa.int64()),
                                       pa.array([sums.ravel()], pa.list_(pa.float64()))], names=["i", "j", "branch", "sums"])


def _added(partials: DataFrame) -> DataFrame:
    """One row for each (i, j): the sum of its partial sums, added in a tree."""
    def add(f: pd.DataFrame) -> pd.DataFrame:
        total = reduce(np.add, f["sums"])
        return pd.DataFrame({"i": f["i"].iloc[:1], "j": f["j"].iloc[:1], "branch": f["branch"].iloc[:1], "sums": [total]})

    for _ in range(2):
        partials = (partials.withColumn("branch", F.floor(F.col("branch") / FAN))
                    .groupBy("i", "j", "branch").applyInPandas(add, SUMS))
    return partials.groupBy("i", "j").applyInPandas(add, SUMS)


def _numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols])


def column_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Mean of each column's values, 0 where it has none; one small row a block on the driver."""
    blocks = [cols[k:k + BLOCK] for k in range(0, len(cols), BLOCK)]

    def partial(block: Sequence[str], k: int) -> DataFrame:
        def run(batches):
            total = np.zeros((2, len(block)))
            for batch in batches:
                x = _values(batch)
                total += np.stack([(~np.isnan(x)).sum(axis=0), np.nansum(x, axis=0)])
            yield _row(k, k, total)
        return _numeric(df, block).mapInArrow(run, SUMS)

    found = {r.i: np.array(r.sums).reshape(2, -1) for r in _added(
        reduce(DataFrame.unionByName, [partial(b, k) for k, b in enumerate(blocks)])).collect()}
    return {c: float(s / n) if n else 0.0 for k, b in enumerate(blocks) if k in found
            for c, n, s in zip(b, *found[k], strict=True)}


def pair_sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows (i, j, sums): for each pair of column blocks, the sums of all pairs of their centred columns."""
    centre = column_means(df, cols)
    blocks = [list(cols[k:k + BLOCK]) for k in range(0, len(cols), BLOCK)]

    def partial(i: int, j: int) -> DataFrame:
        names = blocks[i] if i == j else blocks[i] + blocks[j]
        shift = np.array([centre.get(c, 0.0) for c in names])
        a, b = slice(0, len(blocks[i])), slice(len(names) - len(blocks[j]), len(names))

        def run(batches):
            total = np.zeros((_KINDS, len(blocks[i]), len(blocks[j])))
            for batch in batches:
                x = _values(batch) - shift
                known = ~np.isnan(x)
                x, m = np.where(known, x, 0.0), known.astype(np.float64)
                for k, (p, q) in enumerate(((m, m), (x, m), (m, x), (x * x, m), (m, x * x), (x, x))):
                    total[k] += p[:, a].T @ q[:, b]
            yield _row(i, j, total)
        return _numeric(df, names).mapInArrow(run, SUMS)

    return _added(reduce(DataFrame.unionByName, [partial(i, j) for i in range(len(blocks)) for j in range(i, len(blocks))]))


def wide_correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, corr, rows) for all ordered pairs of ``cols``, the diagonal included."""
    cols = list(cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, corr double, rows long")

    def finish(f: pd.DataFrame) -> pd.DataFrame:
        i, j = int(f["i"].iloc[0]), int(f["j"].iloc[0])
        left, right = cols[i * BLOCK:(i + 1) * BLOCK], cols[j * BLOCK:(j + 1) * BLOCK]
        n, a, b, aa, bb, ab = np.array(f["sums"].iloc[0]).reshape(_KINDS, len(left), len(right))
        some = np.maximum(n, 1.0)
        spread = np.maximum(aa - a * a / some, 0.0) * np.maximum(bb - b * b / some, 0.0)
        # What rounding leaves of a constant column's squares is no variation.
        flat = (aa - a * a / some <= 1e-12 * aa) | (bb - b * b / some <= 1e-12 * bb) | (n == 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            corr = np.where(flat, np.nan, np.clip((ab - a * b / some) / np.sqrt(spread), -1.0, 1.0))
        one = pd.DataFrame({"feature_a": np.repeat(left, len(right)), "feature_b": np.tile(right, len(left)),
                            "corr": corr.ravel(), "rows": n.ravel().astype(np.int64)})
        if i != j:
            one = pd.concat([one, one.rename(columns={"feature_a": "feature_b", "feature_b": "feature_a"})[one.columns]])
        return one

    long = pair_sums(df, cols).groupBy("i", "j").applyInPandas(finish, "feature_a string, feature_b string, corr double, rows long")
    known = F.nanvl(F.col("corr"), F.lit(None).cast("double"))
    return long.select("feature_a", "feature_b", rnd(known).alias("corr"), "rows")
