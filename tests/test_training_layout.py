"""Iterative fits run over rows whose layout follows from their number, with their lineage cut."""

import threading

from attrita.ml import clustering as cl
from attrita.ml import explain as xp
from attrita.ml import models as md
from attrita.operators.features import engineer_features
from test_ml_stream import _planted


def test_kmeans_runs_over_partitions_that_follow_from_the_rows(spark, monkeypatch):
    feats = engineer_features(_planted(spark, n=400).repartition(40), 100000.0)
    seen, fit = [], cl.KMeans.fit
    monkeypatch.setattr(cl.KMeans, "fit", lambda self, df: seen.append((df.rdd.getNumPartitions(), df.count())) or fit(self, df))
    cl.segment_customers(feats, restarts=2)
    assert seen == [(1, 400)] * 2


def test_training_rows_have_no_lineage(spark):
    rows = _planted(spark, n=300).repartition(7)
    sized = md.sized_for_training(rows.join(rows.select("customer_id"), "customer_id"))
    try:
        plan = sized._jdf.queryExecution().analyzed().toString()
        assert "LogicalRDD" in plan and "Join" not in plan and "Repartition" not in plan
        assert sized.rdd.getNumPartitions() == 1 and sized.count() == 300
    finally:
        sized.unpersist()


def test_split_features_are_written_once(spark):
    feats, median = md.split_features(_planted(spark, n=300).repartition(7))
    plan = feats._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "Join" not in plan and "Repartition" not in plan
    assert feats.count() == 300 and median is not None


def test_contributions_read_the_written_features(spark):
    """The profile's joins, and what they broadcast, run once for the fit and the bands."""
    rows = _planted(spark, n=300)
    trained, feats = md.train_model(rows.join(rows.select("customer_id").distinct(), "customer_id"), "lr", maxIter=2)
    bands = xp.contributions_by_bands(xp.linear_contributions(trained, feats, list(xp.band_columns())))
    plan = bands._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "Join" not in plan
    assert bands.agg({"customers": "sum"}).first()[0] == 4 * 300


def test_independent_fits_overlap_and_keep_their_order():
    met = threading.Barrier(md.PARALLEL_FITS, timeout=30)      # broken unless all of them run at once
    assert md.fit_together([lambda i=i: (met.wait(), i)[1] for i in range(md.PARALLEL_FITS)]) == list(range(md.PARALLEL_FITS))
    assert md.fit_together([]) == []
