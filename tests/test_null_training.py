"""Rows that can't be fitted (NULL inputs or label) are counted and left out; bands give NULL no label."""

import pytest
from pyspark.sql import functions as F

from attrita.ml import models as md
from attrita.ml.explain import age_band, balance_band
from attrita.sources.profile import build_customer_profile

SMALL = {"lr": {"maxIter": 5}, "svm": {"maxIter": 5}, "rf": {"numTrees": 2}, "gbt": {"maxIter": 2}}


@pytest.fixture(scope="module")
def broken(spark):
    feats, median = md.split_features(build_customer_profile(spark, "/root/testdata/sf0.001"))
    train = feats.where("split = 'train'")
    a, b = (r[0] for r in train.select("customer_id").orderBy("customer_id").limit(2).collect())
    return feats.withColumn("credit_score", F.when(F.col("customer_id") != a, F.col("credit_score"))) \
        .withColumn("geography", F.when(F.col("customer_id") != b, F.col("geography"))).cache(), median


@pytest.mark.parametrize("kind", SMALL)
def test_rows_with_nulls_are_counted(broken, kind):
    feats, median = broken
    trained, _ = md.train_model(None, kind, feats=feats, median=median, **SMALL[kind])
    assert trained.skipped_rows == 2
    assert md.score(trained, feats.where("credit_score is not null and geography is not null")).where(
        "churn_probability is null or isnan(churn_probability)").isEmpty()


def test_band_edges(spark):
    rows = spark.createDataFrame([(29, 0.0), (30, 0.5), (45, 49999.0), (60, 50000.0), (61, 150000.0), (None, 200000.0),
                                  (80, 200000.5), (80, None)], "age int, balance double")
    got = [tuple(r) for r in rows.select(age_band().alias("a"), balance_band().alias("b")).collect()]
    assert got == [("<30", "0"), ("30-45", "1-50k"), ("45-60", "1-50k"), ("45-60", "50k-150k"), (">60", "150k-200k"),
                   (None, "150k-200k"), (">60", ">200k"), (">60", None)]
