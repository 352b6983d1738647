"""Classifier metrics as aggregates (M5, M6).

Confusion counts are one aggregate.  The ROC-AUC is exact (Mann-Whitney with
average ranks for tied scores): scores are collapsed to (score, positives,
negatives) by a partial aggregation, and the running count of negatives below
each score comes from ``ordered_cumulative`` - no single-task sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrita.functions.stats import rnd
from attrita.operators.prefix import ordered_cumulative


def confusion_metrics(df: DataFrame, label: str = "exited", prob: str = "churn_probability",
                      threshold: float = 0.5) -> DataFrame:
    """tp/fp/tn/fn, precision, recall, F1, accuracy and false-positive rate."""
    pred = F.col(prob) > F.lit(threshold)
    y = F.col(label) == 1
    c = df.agg(F.sum((pred & y).cast("long")).alias("tp"),
               F.sum((pred & ~y).cast("long")).alias("fp"),
               F.sum((~pred & ~y).cast("long")).alias("tn"),
               F.sum((~pred & y).cast("long")).alias("fn"))
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    precision = F.try_divide(tp, tp + fp)
    recall = F.try_divide(tp, tp + fn)
    return c.select("tp", "fp", "tn", "fn",
                    rnd(precision).alias("precision"), rnd(recall).alias("recall"),
                    rnd(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"),
                    rnd(F.try_divide(tp + tn, tp + tn + fp + fn)).alias("accuracy"),
                    rnd(F.try_divide(fp, fp + tn)).alias("false_positive_rate"))


def roc_auc(df: DataFrame, label: str = "exited", score: str = "churn_probability",
            by: list[str] | None = None) -> DataFrame:
    """Exact ROC-AUC, one row per group of ``by`` (null if a class is missing)."""
    by = by or []
    per_score = (df.where(F.col(score).isNotNull())
                 .groupBy(*by, F.col(score).cast("double").alias("s"))
                 .agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"),
                      F.sum((F.col(label) != 1).cast("long")).alias("neg")))
    ranked = ordered_cumulative(per_score, by, "s", ["neg", "pos"])
    neg_below = F.col("cum_neg") - F.col("neg")
    # sum over scores of pos * (negatives below + half the tied negatives)
    return ranked.groupBy(*by).agg(
        rnd(F.try_divide(F.sum(F.col("pos").cast("double") * (neg_below.cast("double") + F.col("neg") / 2.0)),
                         F.sum("pos").cast("double") * F.sum("neg").cast("double"))).alias("roc_auc"),
        F.sum("pos").cast("long").alias("positives"),
        F.sum("neg").cast("long").alias("negatives"))
