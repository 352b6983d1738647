"""Scores and margins to probabilities (M4, M9): isotonic regression and Platt's sigmoid.

Isotonic regression pools adjacent violators: blocks of scores in ascending
order, neighbours joined while the lower block's rate of positives is not the
smaller one.  Pooling parts of the order first and their blocks afterwards gives
the same blocks, so it runs as a tree: scores are collapsed to (score, rows,
positives) by a partial aggregate and range-partitioned, each partition pools
its stretch in a stream, then neighbouring stretches pool their blocks, ``FAN``
at a time and at last all of them.  Only blocks travel after the first step;
their rates rise, so they are few however many rows there are.  Counts are
integers, so the blocks do not depend on the partitioning.

A margin model is calibrated on out-of-fold margins (``models.train_model``):
margins of its own training rows would be too good.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("isotonic", "platt")
#: Stretches whose blocks one task of the tree pools.
FAN = 32
BLOCKS = "stretch long, lo double, hi double, n long, pos long"


@dataclass
class Calibrator:
    """A fitted map from scores to probabilities.

    isotonic: ``knots`` (ascending scores) with their ``values``, interpolated
    in between and constant beyond the ends.  platt: 1 / (1 + exp(-(slope * score
    + offset))).  NULL and NaN scores have no probability."""
    method: str
    knots: list[float] = field(default_factory=list)
    values: list[float] = field(default_factory=list)
    slope: float = 0.0
    offset: float = 0.0

    def apply(self, df: DataFrame, score: str, out: str) -> DataFrame:
        """``df`` plus the column ``out``."""
        s = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
        if self.method == "platt":
            return df.withColumn(out, 1.0 / (1.0 + F.exp(-(F.lit(self.slope) * s + F.lit(self.offset)))))
        x, y = self.knots, self.values
        if not x:
            return df.withColumn(out, F.lit(None).cast("double"))
        # Interval b holds the scores from knot b - 1 up to knot b; before the first and after the last the value is constant.
        rise = [(q - p) / (b - a) for a, b, p, q in zip(x, x[1:], y, y[1:], strict=False)]
        starts, bases, rises = [x[0], *x], [y[0], *y], [0.0, *rise, 0.0]
        found = Bucketizer(splits=[-float("inf"), *x, float("inf")], inputCol="_score", outputCol="_interval",
                           handleInvalid="keep").transform(df.withColumn("_score", s))
        b = F.col("_interval").cast("int")
        at = lambda values: F.get(F.lit(values), b)  # noqa: E731  (no value beyond the array: invalid scores)
        return found.withColumn(out, F.when(F.col("_score").isNotNull(), at(bases) + at(rises) * (F.col("_score") - at(starts)))
                                ).drop("_score", "_interval")


def pool(blocks: Iterator[tuple]) -> list[list]:
    """Pool adjacent violators over (lo, hi, n, pos) blocks in ascending order."""
    held: list[list] = []
    for lo, hi, n, pos in blocks:
        held.append([lo, hi, n, pos])
        while len(held) > 1 and held[-2][3] * held[-1][2] >= held[-1][3] * held[-2][2]:
            _, hi, n, pos = held.pop()
            held[-1][1:] = hi, held[-1][2] + n, held[-1][3] + pos
    return held


def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """(s, n, pos): rows and positives of each distinct score; rows without score or label count for nothing."""
    s = F.col(score).cast("double")
    return (df.where(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull()).groupBy(s.alias("s"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(label) == 1).cast("long")).alias("pos")))


def isotonic_blocks(counts: DataFrame) -> DataFrame:
    """The blocks (lo, hi, n, pos) of the isotonic regression over ``score_counts``."""
    def stretch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, part = [], 0
        for f in frames:
            if len(f):
                part = int(f["stretch"].iloc[0])
                rows = zip(f["s"], f["s"], f["n"].tolist(), f["pos"].tolist(), strict=True)
                held = pool([*map(tuple, held), *rows])
        yield pd.DataFrame([(part, *b) for b in held], columns=["stretch", "lo", "hi", "n", "pos"])

    def join(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("lo")
        held = pool(zip(f["lo"], f["hi"], f["n"].tolist(), f["pos"].tolist(), strict=True))
        return pd.DataFrame([(int(f["stretch"].min()), *b) for b in held], columns=["stretch", "lo", "hi", "n", "pos"])

    first = (counts.repartitionByRange("s").sortWithinPartitions("s")
             .select(F.spark_partition_id().cast("long").alias("stretch"), "s", "n", "pos").mapInPandas(stretch, BLOCKS))
    joined = first.groupBy(F.floor(F.col("stretch") / FAN).alias("_some")).applyInPandas(join, BLOCKS)
    return joined.groupBy().applyInPandas(join, BLOCKS).select("lo", "hi", "n", "pos")


def fit_isotonic(df: DataFrame, score: str, label: str) -> Calibrator:
    knots, values = [], []
    for b in sorted(isotonic_blocks(score_counts(df, score, label)).collect()):     # blocks, not rows
        for x in dict.fromkeys((b.lo, b.hi)):
            knots.append(float(x))
            values.append(b.pos / b.n)
    return Calibrator("isotonic", knots, values)


def fit_platt(df: DataFrame, score: str, label: str) -> Calibrator:
    """Platt's sigmoid with his targets, (P + 1) / (P + 2) for positives and 1 / (N + 2) for negatives: each
    distinct score is a weighted row of either label."""
    counts = score_counts(df, score, label)
    total = counts.agg(F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q")).first()
    if not total.p and not total.q:
        return Calibrator("isotonic")
    high, low = (total.p + 1) / (total.p + 2), 1 / (total.q + 2)
    up = F.col("pos") * F.lit(high) + (F.col("n") - F.col("pos")) * F.lit(low)
    rows = counts.select("s", F.inline(F.array(F.struct(F.lit(1.0).alias("y"), up.alias("w")),
                                               F.struct(F.lit(0.0).alias("y"), (F.col("n") - up).alias("w")))))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=200, tol=1e-9).fit(
        VectorAssembler(inputCols=["s"], outputCol="x").transform(rows))
    return Calibrator("platt", slope=float(model.coefficients[0]), offset=float(model.intercept))


def fit_calibrator(df: DataFrame, score: str, label: str, method: str = "isotonic") -> Calibrator:
    if method not in METHODS:
        raise ValueError(f"unknown calibration {method}")
    return fit_isotonic(df, score, label) if method == "isotonic" else fit_platt(df, score, label)


def calibration_table(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, customers, churned, observed, calibrated): each distinct score with its own rate and the isotonic one."""
    counts = score_counts(df, score, label)
    fitted = fit_isotonic(df, score, label).apply(counts, "s", "calibrated")
    return fitted.select(F.col("s").alias("score"), F.col("n").alias("customers"), F.col("pos").alias("churned"),
                         F.round(F.col("pos") / F.col("n"), 6).alias("observed"), F.round("calibrated", 6).alias("calibrated"))
