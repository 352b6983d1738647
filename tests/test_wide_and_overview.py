"""Blocked Gram correlations against pandas, bracketed selection against sorting, the one-scan overview."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attrita.operators import explore as ex
from attrita.operators import gram
from attrita.operators import selection as sel
from attrita.operators.quantile import exact_quantiles
from attrita.operators.split import split_hash, stratified_split
from tests.conftest import CANON_SCHEMA, customer_row


def test_five_hundred_columns(spark, monkeypatch):
    """Planted: each column is a common factor with its own weight, plus noise; nulls, a far offset, a constant."""
    monkeypatch.setattr(gram, "BLOCK", 128)
    r = np.random.default_rng(3)
    n, d = 300, 500
    weight = r.uniform(-1, 1, d)
    x = r.normal(size=(n, 1)) * weight + r.normal(size=(n, d)) * 0.3
    x[:, 7] += 1e9
    x[:, 8] = 4.25
    x[r.random((n, d)) < 0.02] = np.nan
    x[:, 9] = np.nan
    names = [f"c{i}" for i in range(d)]
    pdf = pd.DataFrame(x, columns=names)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), ", ".join(f"{c} double" for c in names))
    got = gram.wide_correlation_matrix(df.repartition(5), names).toPandas()
    assert len(got) == d * d
    got = got.pivot(index="feature_a", columns="feature_b", values="corr").loc[names, names].to_numpy(dtype=float)
    want = pdf.corr().to_numpy()
    want[8, :] = want[:, 8] = np.nan
    assert np.array_equal(np.isnan(got), np.isnan(want))
    assert np.nanmax(np.abs(got - want)) < 2e-6
    rows = gram.wide_correlation_matrix(df, names[:3]).where("feature_a = 'c0' and feature_b = 'c1'").first()["rows"]
    assert rows == int((pdf.c0.notna() & pdf.c1.notna()).sum())


def test_wide_matrix_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a double, b int")
    got = gram.wide_correlation_matrix(df, ["a", "b"]).collect()
    assert all(x["corr"] is None and x["rows"] == 0 for x in got)
    assert gram.wide_correlation_matrix(df, []).count() == 0


def values_of(kind, r, n):
    if kind == "hot":
        return [0.0] * (n // 2) + [r.gauss(0, 1) for _ in range(n - n // 2)]
    if kind == "few":
        return [float(r.randrange(3)) for _ in range(n)]
    return [r.paretovariate(0.5) * r.choice([-1, 1]) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 40, 30_000])
@pytest.mark.parametrize("kind", ["hot", "few", "wide"])
def test_bracketed_quantiles_equal_numpy(spark, n, kind):
    r = random.Random(n)
    values = values_of(kind, r, n)
    probs = [0.0, 0.0003, 0.1, 0.25, 0.5, 0.9, 0.9999, 1.0]
    df = spark.createDataFrame([(v, None) for v in values] + [(None, None), (float("nan"), None)], "x double, y double").repartition(3)
    got = {(a.column, a.prob): a.value for a in exact_quantiles(df, ["x", "y"], probs).collect()}
    assert got == pytest.approx({("x", p): float(np.quantile(values, p)) for p in probs} if n else {}, rel=1e-12, abs=1e-12)


def test_selection_with_many_groups_and_a_null_one(spark, monkeypatch):
    monkeypatch.setattr(sel, "MAX_GROUPS", 3)       # the join by a shuffle
    r = random.Random(2)
    rows = [(r.choice([None, *"abcdefg"]), r.random()) for _ in range(4000)]
    got = {(a.g, a.prob): a.value for a in exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["x"], [0.2, 0.5], ["g"]).collect()}
    for g in {g for g, _ in rows}:
        for p in (0.2, 0.5):
            assert got[g, p] == pytest.approx(float(np.quantile([x for h, x in rows if h == g], p)))


def test_split_cuts_without_sorting(spark):
    """A third of the rows on one key, repeated keys, keys that collide in the hash, null keys and classes."""
    m = 2147483647
    rows = [(i, i % 3 - 1 if i % 3 else None) for i in range(9000)] + [(5, 1)] * 4000 + [(i + m, 1) for i in range(0, 600, 3)] + [(None, 1)] * 7
    df = spark.createDataFrame(rows, "customer_id long, exited int").repartition(4)
    got = stratified_split(df)
    placed = {(x.exited, x.customer_id): x.split for x in got.collect()}
    assert got.count() == len(rows) and placed[1, None] == "train"
    hashed = {x.customer_id: x.h for x in df.where("customer_id is not null").select("customer_id", split_hash("customer_id").alias("h")).distinct().collect()}
    for label in (None, 0, 1):
        own = sorted((hashed[k], k) for k, y in rows if y == label and k is not None)
        cut = own[(len(own) * 20 + 99) // 100 - 1]
        assert {k: placed[label, k] for _, k in own} == {k: "test" if (h, k) <= cut else "train" for h, k in own}


def test_no_range_shuffle_in_the_plans(spark):
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(100)], "customer_id long, exited int, x double")
    for out in (exact_quantiles(df, ["x"], [0.5], ["exited"]), stratified_split(df)):
        assert "rangepartitioning" not in out._jdf.queryExecution().toString().lower()


def test_overview_equals_the_single_queries(spark):
    rows = [customer_row(customer_id=i, geography=[None, "A", "B"][i % 3], gender="F" if i % 5 else None, num_products=1 + i % 4,
                         is_active_member=i % 2, age=18 + i % 90, exited=int(i % 7 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, CANON_SCHEMA).withColumn("age_group", F.when(F.col("age") < 60, 1)).withColumn(
        "credit_score_category", F.lit(2)).withColumn("tenure_category", F.lit(None).cast("int"))
    got = {(x.dimension, x.level): (x.label, x.churn_rate_pct, x.customers, x.churned) for x in ex.churn_overview(df).collect()}
    want = {}
    for c in ("geography", "gender", "num_products"):
        for x in ex.churn_rate_by(df, c).collect():
            level = None if x[c] is None else str(x[c])
            want[c, level] = (level, x.churn_rate_pct, x.customers, x.churned)
    for c, (labels, first) in ex.OVERVIEW_CODES.items():
        for x in ex.churn_rate_by_code(df, c, labels, first).collect():
            want[c, str(x[c])] = (x.label, x.churn_rate_pct, x.customers, x.churned)
        for x in ex.churn_rate_by(df.where(F.col(c).isNull()), c).collect():
            want[c, None] = (None, x.churn_rate_pct, x.customers, x.churned)
    assert got == want
    assert ex.churn_overview(df.where("false")).agg(F.sum("customers")).first()[0] == 0


def test_overview_reads_its_table_once(spark):
    df = spark.createDataFrame([customer_row()], CANON_SCHEMA).withColumn("age_group", F.lit(1)).withColumn(
        "credit_score_category", F.lit(2)).withColumn("tenure_category", F.lit(3))
    plan = ex.churn_overview(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Aggregate") == 1
