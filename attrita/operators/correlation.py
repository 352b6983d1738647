"""Pearson correlations in one aggregate pass.

All pairs are co-moment aggregates evaluated together, so the whole matrix is
one scan with partial aggregation; the 1-row result is unpivoted to long form
(feature_a, feature_b, corr), both orders of a pair at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrita.functions.stats import rnd, safe_corr


def correlation_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """All ordered pairs (a, b) with their correlation (diagonal included)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.agg(*[safe_corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    entries = F.array(*[F.struct(F.lit(x).alias("feature_a"), F.lit(y).alias("feature_b"), F.col(f"c{i}").alias("corr"))
                        for i, (a, b) in enumerate(pairs) for x, y in dict.fromkeys(((a, b), (b, a)))])
    return wide.select(F.inline(entries))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """The full matrix in long form, rounded."""
    return correlation_long(df, cols).select("feature_a", "feature_b", rnd("corr").alias("corr"))


def correlation_with(df: DataFrame, cols: list[str], target: str = "exited") -> DataFrame:
    """Correlation of each column with ``target`` (target itself dropped
    by name), ranked descending, with its sign."""
    feats = [c for c in cols if c != target]
    wide = df.agg(*[safe_corr(c, target).alias(f"c{i}") for i, c in enumerate(feats)])
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("corr"))
                        for i, c in enumerate(feats)])
    # The window runs over one row per feature.
    order = Window.orderBy(F.desc("corr"), F.asc("feature"))
    return (wide.select(F.inline(entries))
            .select("feature", rnd("corr").alias("corr"),
                    F.when(F.col("corr") > 0, F.lit("positive"))
                     .when(F.col("corr") < 0, F.lit("negative"))
                     .otherwise(F.lit("none")).alias("direction"),
                    F.row_number().over(order).alias("rank")))


def feature_power(df: DataFrame, original: list[str], engineered: list[str],
                  target: str = "exited") -> DataFrame:
    """|corr| with the target, original vs engineered features."""
    feats = [(c, "original") for c in original] + [(c, "engineered") for c in engineered]
    wide = df.agg(*[safe_corr(c, target).alias(f"c{i}") for i, (c, _) in enumerate(feats)])
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(g).alias("feature_group"),
                                 F.col(f"c{i}").alias("corr")) for i, (c, g) in enumerate(feats)])
    return wide.select(F.inline(entries)).select("feature", "feature_group",
                                                 rnd(F.abs("corr")).alias("abs_corr"))
