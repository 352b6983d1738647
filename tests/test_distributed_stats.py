"""Exact distributed statistics checked against brute force on small fixtures."""

import numpy as np
import pytest
import pandas as pd
from pyspark.sql import functions as F

from attrita.operators.evaluation import confusion_metrics, roc_auc
from attrita.operators.prefix import ordered_cumulative
from attrita.operators.quantile import exact_median, exact_quantiles
from attrita.operators.split import stratified_split


def _data(spark, n=2000, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "customer_id": np.arange(n, dtype="int64"),
        "g": rng.integers(0, 3, n).astype("int32"),
        "x": np.round(rng.normal(0, 10, n), 1),            # many ties
        "y": rng.integers(0, 5, n).astype("float64"),      # heavy ties
        "exited": (rng.random(n) < 0.25).astype("int32"),
    })
    return pdf, spark.createDataFrame(pdf)


def test_quantiles_match_linear_interpolation(spark):
    pdf, df = _data(spark)
    got = exact_quantiles(df, ["x", "y"], [0.0, 0.25, 0.5, 0.75, 1.0], by=["g"]).toPandas()
    for (g, col, p), v in got.set_index(["g", "column", "prob"])["value"].items():
        expect = pdf.loc[pdf.g == g, col].quantile(p, interpolation="linear")
        assert abs(v - expect) < 1e-9, (g, col, p, v, expect)


def test_median_even_count_and_single_value(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,)], "b double")
    assert exact_median(df, "b") == 6.0
    assert exact_median(spark.createDataFrame([(5.0,)] * 7, "b double"), "b") == 5.0


@pytest.mark.parametrize("n_buckets", [2, 16, 1000])
def test_prefix_sums_equal_sorted_cumsum(spark, n_buckets):
    pdf, df = _data(spark)
    vc = df.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    out = ordered_cumulative(vc, ["g"], "x", ["n"], n_buckets=n_buckets)
    got = out.toPandas().sort_values(["g", "x"])
    ref = pdf.groupby(["g", "x"]).size().rename("n").reset_index().sort_values(["g", "x"])
    ref["cum"] = ref.groupby("g")["n"].cumsum()
    ref["total"] = ref.groupby("g")["n"].transform("sum")
    assert got["cum_n"].tolist() == ref["cum"].tolist()
    assert got["total_n"].tolist() == ref["total"].tolist()


def test_auc_equals_pairwise_count(spark):
    pdf, df = _data(spark, n=600)
    got = roc_auc(df, "exited", "y").first()["roc_auc"]
    pos = pdf.loc[pdf.exited == 1, "y"].to_numpy()
    neg = pdf.loc[pdf.exited == 0, "y"].to_numpy()
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert abs(got - round(wins / (len(pos) * len(neg)), 6)) < 1e-9


def test_confusion_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.2), (0, 0.7), (0, 0.1)], "exited int, p double")
    m = confusion_metrics(df, "exited", "p").first()
    assert (m.tp, m.fp, m.tn, m.fn) == (1, 1, 1, 1)
    assert m.precision == 0.5 and m.false_positive_rate == 0.5


def test_split_is_exact_stratified_and_deterministic(spark):
    pdf, df = _data(spark, n=1234)
    s1 = stratified_split(df).toPandas()
    s2 = stratified_split(df).toPandas()
    assert s1.sort_values("customer_id")["split"].tolist() == s2.sort_values("customer_id")["split"].tolist()
    for cls, grp in s1.groupby("exited"):
        n = len(grp)
        assert (grp.split == "test").sum() == -(-n * 20 // 100)


def test_approx_options_are_close(spark):
    from attrita.operators.explore import describe
    from attrita.operators.quantile import approx_median
    pdf, df = _data(spark, n=3000)
    m = approx_median(df, "x", 10_000)
    rank = (pdf["x"] < m).mean()
    assert abs(rank - 0.5) < 0.01
    exact = {r.column: r for r in describe(df, ["x", "y"]).collect()}
    approx = {r.column: r for r in describe(df, ["x", "y"], approx_accuracy=10_000).collect()}
    for c in ("x", "y"):
        assert exact[c]["count"] == approx[c]["count"] and exact[c].mean == approx[c].mean
        assert abs(exact[c].p50 - approx[c].p50) <= 0.2


def test_grouped_auc_equals_per_group(spark):
    pdf, df = _data(spark, n=900)
    grouped = {r.g: r.roc_auc for r in roc_auc(df, "exited", "x", by=["g"]).collect()}
    for g in range(3):
        single = roc_auc(df.where(F.col("g") == g), "exited", "x").first()["roc_auc"]
        assert grouped[g] == single
