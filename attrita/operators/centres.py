"""G1, G2, G4 on given centres: standardise, assign, and judge clusters from their sums.

The squared-Euclidean silhouette of a point needs, for each cluster, only the
number of its points, the sum of their vectors and the sum of their squared
lengths: the mean squared distance of x to a cluster is
|x|^2 + Q / n - 2 x.S / n.  So one aggregate gives what all silhouettes need, a
row a cluster, and a second pass over the points averages them; the cost is
Q - |S|^2 / n for the clusters' own means, or the summed distances to the given
centres.  No pair of points is formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from attrita.functions.stats import rnd


def standardised(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """G1: ``df`` plus ``z``, the columns with their mean taken off, by their sample standard deviation; a constant
    column is 0, and a row that lacks a value has no ``z``."""
    stats = df.agg(*[F.struct(F.avg(F.col(c).cast("double")).alias("m"), F.stddev_samp(F.col(c).cast("double")).alias("s")).alias(f"c{i}")
                     for i, c in enumerate(cols)]).first()        # one row
    def z(i: int, c: str) -> Column:
        m, s = stats[f"c{i}"]
        value = (F.col(c).cast("double") - F.lit(m)) / F.lit(s) if s else F.lit(0.0)
        return F.when(F.col(c).isNotNull(), value)
    known = F.lit(True)
    for c in cols:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.withColumn("z", F.when(known, F.array(*[z(i, c) for i, c in enumerate(cols)])))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def assign_to_centres(df: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    """``df`` plus ``cluster`` (the nearest centre, the first of equals) and ``distance`` (squared); rows without ``z`` have neither."""
    apart = F.array(*[F.aggregate(F.zip_with("z", F.lit(list(map(float, c))), lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                                  lambda t, x: t + x) for c in centres])
    return (df.withColumn("_apart", F.when(F.col("z").isNotNull(), apart)).withColumn("distance", F.array_min("_apart"))
            .withColumn("cluster", (F.array_position("_apart", F.col("distance")) - 1).cast("int")).drop("_apart"))


def cluster_sums(assigned: DataFrame, dims: int) -> DataFrame:
    """cluster, n, squares, sums (array), cost: one row a cluster, from one aggregate."""
    return assigned.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum(_dot(F.col("z"), F.col("z"))).alias("squares"),
        F.array(*[F.sum(F.col("z")[i]) for i in range(dims)]).alias("sums"), F.sum("distance").alias("cost"))


def silhouettes(assigned: DataFrame, sums: Sequence[Row]) -> DataFrame:
    """``assigned`` rows that have a cluster, plus ``silhouette``: 0 in a cluster of one, null where there is one
    cluster only.  ``sums``: the rows of ``cluster_sums``."""
    rows = assigned.where(F.col("cluster").isNotNull())
    if not sums:
        return rows.withColumn("silhouette", F.lit(None).cast("double"))
    length = _dot(F.col("z"), F.col("z"))
    def total(r) -> Column:     # summed squared distances of the row to the cluster's points
        return F.lit(float(r.n)) * length + F.lit(float(r.squares)) - 2.0 * _dot(F.col("z"), F.lit([float(x) for x in r.sums]))
    own, other = F.lit(None).cast("double"), []
    for r in sums:
        here = F.col("cluster") == r.cluster
        own = F.when(here, F.greatest(total(r), F.lit(0.0)) / F.lit(float(r.n - 1)) if r.n > 1 else F.lit(None)).otherwise(own)
        other.append(F.when(~here, F.greatest(total(r), F.lit(0.0)) / F.lit(float(r.n))))
    alone = F.col("cluster").isin(*[r.cluster for r in sums if r.n == 1])
    rows = rows.withColumn("_a", own).withColumn("_b", F.array_min(F.array(*other)))
    value = F.when(F.col("_b").isNull(), F.lit(None)).when(alone, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0)))
    return rows.withColumn("silhouette", value).drop("_a", "_b")


def centre_quality(df: DataFrame, cols: Sequence[str], centres: Sequence[Sequence[float]]) -> DataFrame:
    """cluster, customers, cost, inertia (about the cluster's own mean), mean_silhouette; cluster -1 is all of them."""
    assigned = assign_to_centres(standardised(df, cols), centres)
    sums = cluster_sums(assigned, len(cols)).collect()      # a row a cluster
    judged = silhouettes(assigned, sums)
    parts = judged.withColumn("cluster", F.explode(F.array(F.col("cluster"), F.lit(-1)))).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("customers"), rnd(F.sum("distance")).alias("cost"), rnd(F.avg("silhouette")).alias("mean_silhouette"))
    own = {r.cluster: float(r.squares - sum(x * x for x in r.sums) / r.n) for r in sums}
    about = df.sparkSession.createDataFrame([*own.items(), (-1, sum(own.values()))], "cluster int, inertia double").select(
        "cluster", rnd("inertia").alias("inertia"))
    return parts.join(about, "cluster").select("cluster", "customers", "cost", "inertia", "mean_silhouette")
