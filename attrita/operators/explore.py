"""Profiling jobs (A1-A16, U1): KPIs, describe, churn rates, bins, histograms.

A customer without a label (NULL) is a customer, but neither churned nor
retained: counts of customers include it, rates, classes and shares of classes
are over the labelled ones.

Each job is one or two aggregate passes over the customer table; group keys
are low-cardinality attributes, and partial aggregation runs before every
shuffle, so a hot key (a third of all rows in one country, say) arrives at
its reducer as one partial row per map task.  Dimension rows (bin labels,
class labels, bin grids) are built from parameters, never from the data, and
the aggregates are left-joined *from* them so empty bins stay visible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrita import config as C
from attrita.operators.prefix import null_safe_join
from attrita.functions.bins import equal_width_bin
from attrita.functions.stats import pct, rnd
from attrita.operators.broadcast import bounded_local
from attrita.operators.quantile import exact_quantiles, long_values
from attrita.operators.selection import MAX_GROUPS, sketch

DESCRIBE_STATS = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession


def label_dimension(spark: SparkSession, key: str, labels: list[str], first_code: int = 1) -> DataFrame:
    """(key, label) rows for codes first_code.. in order (a parameter table)."""
    schema = T.StructType([T.StructField(key, T.IntegerType()), T.StructField("label", T.StringType())])
    return spark.createDataFrame([(first_code + i, lab) for i, lab in enumerate(labels)], schema)


def kpis(df: DataFrame) -> DataFrame:
    """A1/A2: rows, churn rate %, churned, retained, distinct countries, columns."""
    return df.agg(
        F.count(F.lit(1)).alias("total_customers"),
        rnd(pct(F.sum("exited"), F.count("exited"))).alias("churn_rate_pct"),
        F.sum("exited").cast("long").alias("churned"),
        (F.count("exited") - F.sum("exited")).cast("long").alias("retained"),
        F.countDistinct("geography").alias("countries"),
        F.lit(len(df.columns)).alias("n_columns"),
    )


def churn_rate_by(df: DataFrame, key: str) -> DataFrame:
    """Churn rate %, customers and churned per value of ``key``."""
    return (df.groupBy(key)
            .agg(rnd(pct(F.sum("exited"), F.count("exited"))).alias("churn_rate_pct"),
                 F.count(F.lit(1)).alias("customers"),
                 F.coalesce(F.sum("exited"), F.lit(0)).cast("long").alias("churned")))


def churn_rate_by_code(df: DataFrame, key: str, labels: list[str], first_code: int = 1) -> DataFrame:
    """A9-A12 + J2: rate per coded bin, labelled, empty bins kept (rate null, 0 customers)."""
    dim = label_dimension(_spark(df), key, labels, first_code)
    agg = churn_rate_by(df, key)
    return (dim.join(agg, key, "left")
            .select(key, "label", "churn_rate_pct",
                    F.coalesce("customers", F.lit(0)).cast("long").alias("customers"),
                    F.coalesce("churned", F.lit(0)).cast("long").alias("churned")))


#: Coded columns of the overview: their labels and first code.
OVERVIEW_CODES = {"is_active_member": (C.ACTIVITY_LABELS, 0), "age_group": (C.AGE_LABELS, 1),
                  "credit_score_category": (C.CREDIT_LABELS, 1), "tenure_category": (C.TENURE_LABELS, 1)}
OVERVIEW = ["geography", "gender", "num_products", *OVERVIEW_CODES]


def churn_overview(df: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """A6-A12 + J2 in one pass: (dimension, level, label, churn_rate_pct,
    customers, churned) by each of ``dims`` on its own.

    One aggregate over grouping sets: each row is combined under all dimensions
    before the shuffle, and ``grouping_id`` tells a set's own column from the
    others, so a NULL level stays a level.  Codes without customers are kept,
    with a null rate."""
    dims = dims or OVERVIEW
    of_set = {(1 << len(dims)) - 1 - (1 << len(dims) - 1 - i): c for i, c in enumerate(dims)}
    own = F.element_at(F.create_map(*[F.lit(x) for k, c in of_set.items() for x in (k, c)]), F.col("_set").cast("int"))
    level = F.coalesce(*[F.when(F.col("dimension") == c, F.col(c).cast("string")) for c in dims])
    rates = (df.select("exited", *dims).groupingSets([[c] for c in dims], *dims)
             .agg(F.grouping_id().alias("_set"), rnd(pct(F.sum("exited"), F.count("exited"))).alias("churn_rate_pct"),
                  F.count(F.lit(1)).alias("customers"), F.coalesce(F.sum("exited"), F.lit(0)).cast("long").alias("churned"))
             .withColumn("dimension", own).select("dimension", level.alias("level"), "churn_rate_pct", "customers", "churned"))
    codes = [(c, str(first + i), label) for c, (labels, first) in OVERVIEW_CODES.items() if c in dims for i, label in enumerate(labels)]
    known = _spark(df).createDataFrame(codes, "dimension string, level string, label string")
    none = F.lit(0).cast("long")
    return (rates.join(known, ["dimension", "level"], "full_outer")
            .select("dimension", "level", F.coalesce("label", "level").alias("label"), "churn_rate_pct",
                    F.coalesce("customers", none).alias("customers"), F.coalesce("churned", none).alias("churned")))


def min_max(df: DataFrame, cols: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """Min and max of several columns in one aggregate (one small row)."""
    row = df.agg(*[e for c in cols for e in (F.min(c).alias(f"mn_{c}"), F.max(c).alias(f"mx_{c}"))]).first()
    return {c: (row[f"mn_{c}"], row[f"mx_{c}"]) for c in cols}


def churn_rate_by_equal_width(df: DataFrame, col: str, n_bins: int = C.RISK_SCORE_LEVELS) -> DataFrame:
    """Churn rate over ``n_bins`` equal-width, right-closed bins of ``col``.

    Two passes: min/max, then one grouped aggregate; the bin grid is a
    parameter-sized dimension, so empty bins appear with a null rate.
    """
    lo, hi = min_max(df, [col])[col]
    spark = _spark(df)
    if lo is None:
        return spark.createDataFrame([], "level int, bin_lower double, bin_upper double, "
                                         "churn_rate_pct double, customers long, churned long")
    w = (hi - lo) / n_bins
    grid = spark.createDataFrame(
        [(k, float(lo + (k - 1) * w), float(lo + k * w)) for k in range(1, n_bins + 1)],
        "level int, bin_lower double, bin_upper double")
    agg = churn_rate_by(df.select(equal_width_bin(col, lo, hi, n_bins).alias("level"), "exited"), "level")
    return (grid.join(agg, "level", "left")
            .select("level", "bin_lower", "bin_upper", "churn_rate_pct",
                    F.coalesce("customers", F.lit(0)).cast("long").alias("customers"),
                    F.coalesce("churned", F.lit(0)).cast("long").alias("churned")))


def histogram(df: DataFrame, cols: list[str], n_bins: int = C.HISTOGRAM_BINS,
              by_class: bool = False) -> DataFrame:
    """Counts in ``n_bins`` equal-width bins per column, optionally per class.

    Bins are [lo + k w, lo + (k+1) w) with the maximum in the last bin; the
    edges are shared by both classes.  Output is long: one row per
    (column[, exited], bin), empty bins included with count 0.
    """
    spark = _spark(df)
    ranges = min_max(df, cols)
    classes = [0, 1] if by_class else [None]
    grid_rows = []
    for c in cols:
        lo, hi = ranges[c]
        if lo is None:
            continue
        w = (hi - lo) / n_bins
        for k in range(n_bins):
            for cls in classes:
                grid_rows.append((c, cls, k, float(lo + k * w), float(lo + (k + 1) * w)))
    grid = spark.createDataFrame(grid_rows, "column string, exited int, bin int, bin_lower double, bin_upper double")
    bin_expr = None
    for c in cols:
        lo, hi = ranges[c]
        if lo is None:
            continue
        e = equal_width_bin(F.col("v"), lo, hi, n_bins, right_closed=False)
        bin_expr = F.when(F.col("column") == c, e) if bin_expr is None else bin_expr.when(F.col("column") == c, e)
    by = ["exited"] if by_class else []
    keys = ["column", *by, "bin"]
    counts = (long_values(df, cols, by).select("column", *by, bin_expr.alias("bin"))
              .groupBy(*keys).agg(F.count(F.lit(1)).alias("count")))
    if not by_class:
        grid = grid.drop("exited")
    return grid.join(counts, keys, "left").select(
        *keys, "bin_lower", "bin_upper", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def describe(df: DataFrame, cols: list[str], by: list[str] | None = None,
             approx_accuracy: int | None = None) -> DataFrame:
    """A3/A4: count, mean, sample std, min, 25/50/75 %, max per column (per group).

    Long form (by..., column, stats...).  Quantiles are exact (linearly
    interpolated) by default: the aggregate of the moments holds the sketches
    that bracket their ranks as well, and a second pass picks the values.  With
    ``approx_accuracy`` they come
    from ``percentile_approx`` in the same single aggregate as the moments
    (bounded memory per group, rank error about 1/accuracy) - the option for
    many groups or when exact values are not needed.
    """
    by = by or []
    keys = by + ["column"]

    quartiles = {0.25: "p25", 0.5: "p50", 0.75: "p75"}

    def stats(c: str) -> F.Column:
        v = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        ranks = [sketch(v, list(quartiles)).alias("sketched")] if approx_accuracy is None else [
            rnd(F.percentile_approx(v, p, approx_accuracy).cast("double")).alias(name) for p, name in quartiles.items()]
        return F.struct(F.lit(c).alias("column"), F.count(v).alias("count"), rnd(F.avg(v)).alias("mean"),
                        rnd(F.stddev_samp(v)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), *ranks)

    # One wide row per group, turned into a row per column afterwards; a column without values has none.
    wide = df.groupBy(*by).agg(F.array(*[stats(c) for c in cols]).alias("_stats"))
    moments = wide.select(*by, F.inline("_stats")).where("count > 0")
    if approx_accuracy is not None:
        return moments.select(*keys, *DESCRIBE_STATS)
    moments = bounded_local(moments, MAX_GROUPS)
    q = (exact_quantiles(df, cols, list(quartiles), by, moments.withColumnRenamed("count", "n"))
         .groupBy(*keys).agg(*[rnd(F.max(F.when(F.col("prob") == p, F.col("value")))).alias(name) for p, name in quartiles.items()]))
    return null_safe_join(q, moments, keys).select(*keys, *DESCRIBE_STATS)


def describe_transposed(df: DataFrame, cols: list[str]) -> DataFrame:
    """A4 + U1: describe by class, transposed: one row per (column, statistic),
    one value column per class."""
    d = describe(df, cols, ["exited"])
    stats = F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("value"))
                      for s in DESCRIBE_STATS])
    longf = d.select("exited", "column", F.inline(stats))
    return (longf.groupBy("column", "statistic")
            .pivot("exited", [0, 1])
            .agg(F.first("value"))
            .withColumnRenamed("0", "not_churned")
            .withColumnRenamed("1", "churned"))


def class_counts(df: DataFrame) -> DataFrame:
    """A5: customers per class with labels and share %, both classes always present."""
    dim = label_dimension(_spark(df), "exited", C.CLASS_LABELS, first_code=0)
    counts = df.groupBy("exited").agg(F.count(F.lit(1)).alias("customers"))
    n = F.coalesce("customers", F.lit(0))
    everyone = Window.partitionBy()  # over the two class rows only
    return (dim.join(counts, "exited", "left")
            .select("exited", "label", n.cast("long").alias("customers"),
                    rnd(pct(n, F.sum(n).over(everyone))).alias("share_pct")))


def bin_coverage(df: DataFrame) -> DataFrame:
    """Rows whose value falls outside every bin of a binned feature (null code)
    and rows whose value is null, per binned feature; one aggregate pass."""
    from attrita.functions.bins import right_closed_bin
    specs = [("age_group", "age", C.AGE_EDGES), ("credit_score_category", "credit_score", C.CREDIT_EDGES),
             ("tenure_category", "tenure", C.TENURE_EDGES)]
    aggs = []
    for name, src, edges in specs:
        code = right_closed_bin(src, edges)
        aggs += [F.count(F.when(F.col(src).isNotNull() & code.isNull(), 1)).alias(f"{name}__out"),
                 F.count(F.when(F.col(src).isNull(), 1)).alias(f"{name}__null")]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    entries = F.array(*[F.struct(F.lit(name).alias("feature"), F.col(f"{name}__out").alias("out_of_range"),
                                 F.col(f"{name}__null").alias("null_values")) for name, _, _ in specs])
    return wide.select("rows", F.inline(entries)).select("feature", "rows", "out_of_range", "null_values")
