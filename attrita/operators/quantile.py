"""Exact quantiles (linear interpolation, like pandas and SQL quantile_cont).

Spark's exact ``percentile`` merges one value->count map per group in a single
task, which does not survive a continuous column at scale.  Here a sketch
brackets the wanted ranks and one pass over the values counts what lies below
and inside the brackets (``selection``); the column is neither sorted nor
shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrita.operators.selection import at_ranks, sketch


def long_values(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., column, v) for every non-null value of ``cols``."""
    by = by or []
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])
    return (df.select(*by, F.inline(pairs))
            .where(F.col("v").isNotNull() & ~F.isnan("v")))


def bracketed(df: DataFrame, cols: list[str], probs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., column, n, sketched): the sketches that ``exact_quantiles`` starts from, one wide aggregate."""
    def own(c):
        v = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        return F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), sketch(v, probs).alias("sketched"))

    return df.groupBy(*(by or [])).agg(F.array(*[own(c) for c in cols]).alias("_all")).select(
        *(by or []), F.inline("_all")).where("n > 0")


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], by: list[str] | None = None,
                    brackets: DataFrame | None = None) -> DataFrame:
    """Rows (by..., column, prob, value) for every column x prob (x group).
    ``brackets``: what ``bracketed`` gives for the same arguments, if it is known."""
    by = by or []
    keys = by + ["column"]
    # Same double arithmetic as pos = (N - 1) * p, lo = floor, hi = ceil.
    pos = lambda n, p: (n - 1).cast("double") * F.lit(float(p))
    wanted = [(f"{i}{end}", lambda n, p=p, cut=cut: cut(pos(n, p)))
              for i, p in enumerate(probs) for end, cut in (("lo", F.floor), ("hi", F.ceil))]
    found = at_ranks(long_values(df, cols, by), keys, "v", brackets if brackets is not None else bracketed(df, cols, probs, by),
                     sorted(probs), wanted)
    place = F.regexp_extract("target", r"^\d+", 0).cast("int")
    picked = found.select(*keys, "n", "v", "target", F.element_at(F.array(*[F.lit(float(p)) for p in probs]), place + 1).alias("prob")).groupBy(
        *keys, "prob", "n").agg(F.max(F.when(F.col("target").endswith("lo"), F.col("v"))).alias("v_lo"),
                                F.max(F.when(F.col("target").endswith("hi"), F.col("v"))).alias("v_hi"))
    at = (F.col("n") - 1).cast("double") * F.col("prob")
    return picked.select(*keys, "prob", (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * (at - F.floor(at))).alias("value"))


def exact_median(df: DataFrame, col: str) -> float | None:
    """The exact median of one column as a Python float (one small row)."""
    row = exact_quantiles(df, [col], [0.5]).select("value").first()
    return None if row is None or row["value"] is None else float(row["value"])


def approx_median(df: DataFrame, col: str, accuracy: int = 10_000) -> float | None:
    """A20, scale option: one aggregate with bounded memory; the result is a
    value of the column whose rank is within about n/accuracy of the middle."""
    row = df.agg(F.percentile_approx(F.col(col).cast("double"), 0.5, accuracy).alias("m")).first()
    return None if row is None or row["m"] is None else float(row["m"])
