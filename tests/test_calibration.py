"""Isotonic and Platt calibration against plain versions; SVM probabilities."""

import math
import random

import pytest
from pyspark.sql import functions as F

from attrita.ml import calibration as cal
from attrita.ml import models as md
from attrita.sources.profile import build_customer_profile
from tests.conftest import CANON_SCHEMA, SF001, customer_row


def plain_isotonic(rows):
    """Max over starts of the min over ends of the mean, by distinct score."""
    by = {}
    for s, y in rows:
        n, p = by.get(s, (0, 0))
        by[s] = n + 1, p + y
    xs = sorted(by)
    mean = lambda a, b: sum(by[x][1] for x in xs[a:b + 1]) / sum(by[x][0] for x in xs[a:b + 1])
    return {x: max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


def rows_of(r, n, levels):
    return [(x := r.randrange(levels) / 7 - 2, int(r.random() < 1 / (1 + math.exp(-2 * x)))) for _ in range(n)]


@pytest.mark.parametrize("n, levels, fan", [(0, 5, 2), (1, 5, 2), (40, 3, 2), (600, 60, 2), (600, 60, 32)])
def test_isotonic_equals_max_min(spark, monkeypatch, n, levels, fan):
    monkeypatch.setattr(cal, "FAN", fan)
    rows = rows_of(random.Random(n + levels), n, levels)
    bad = [(None, 1), (0.5, None), (float("nan"), 0)]
    df = spark.createDataFrame([*rows, *bad], "s double, y int")
    got = {x.score: x.calibrated for x in cal.calibration_table(df, "s", "y").collect()}
    assert got == pytest.approx(plain_isotonic(rows), abs=1e-6)


def test_hot_score_and_constant_labels(spark):
    rows = [(0.0, 0)] * 400 + [(0.0, 1)] * 200 + [(1.0, 1)] * 3 + [(2.0, 1)]
    got = {x.score: x.calibrated for x in cal.calibration_table(spark.createDataFrame(rows, "s double, y int"), "s", "y").collect()}
    assert got == pytest.approx({0.0: 1 / 3, 1.0: 1.0, 2.0: 1.0}, abs=1e-6)


def test_isotonic_interpolates_and_is_constant_outside(spark):
    c = cal.Calibrator("isotonic", [0.0, 1.0, 3.0], [0.1, 0.1, 0.7])
    df = spark.createDataFrame([(-5.0,), (0.0,), (0.5,), (1.0,), (2.0,), (3.0,), (9.0,), (None,), (float("nan"),)], "m double")
    got = [x.p for x in c.apply(df, "m", "p").collect()]
    assert got[:7] == pytest.approx([0.1, 0.1, 0.1, 0.1, 0.4, 0.7, 0.7]) and got[7:] == [None, None]
    assert cal.Calibrator("isotonic").apply(df, "m", "p").where("p is not null").count() == 0
    one = cal.Calibrator("isotonic", [2.0], [0.3]).apply(df, "m", "p").where("p is not null")
    assert {x.p for x in one.collect()} == {0.3}


def test_platt_is_the_likelihood_maximum(spark):
    rows = rows_of(random.Random(1), 400, 30)
    c = cal.fit_calibrator(spark.createDataFrame(rows, "s double, y int"), "s", "y", "platt")
    p, n = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    goal = {1: (p + 1) / (p + 2), 0: 1 / (n + 2)}

    def slope_of_loss(weight):
        return sum((1 / (1 + math.exp(-(c.slope * s + c.offset))) - goal[y]) * weight(s) for s, y in rows) / len(rows)

    assert c.slope > 0 and abs(slope_of_loss(lambda s: 1.0)) < 1e-4 and abs(slope_of_loss(lambda s: s)) < 1e-4
    with pytest.raises(ValueError):
        cal.fit_calibrator(spark.createDataFrame(rows, "s double, y int"), "s", "y", "none")


def planted(spark, n=400):
    """Older and inactive customers leave more often."""
    r = random.Random(7)
    rows = []
    for i in range(n):
        age, active = r.randrange(20, 80), r.randrange(2)
        rows.append(customer_row(customer_id=i, age=age, is_active_member=active, geography=r.choice(["A", "B", "C"]),
                                 gender=r.choice(["Female", "Male"]), balance=r.random() * 1e5, credit_score=r.randrange(400, 850),
                                 num_products=r.randrange(1, 4), tenure=r.randrange(10), has_cr_card=r.randrange(2),
                                 estimated_salary=r.random() * 1e5,
                                 exited=int(r.random() < 1 / (1 + math.exp(-(age - 55) / 6 + 2 * active)))))
    return spark.createDataFrame(rows, CANON_SCHEMA)


@pytest.mark.parametrize("method", ["isotonic", "platt"])
def test_svm_scores_are_probabilities(spark, tmp_path, method):
    trained, feats = md.train_model(planted(spark), "svm", calibration=method, maxIter=20)
    scored = md.score(trained, feats).cache()
    low, high = scored.agg(F.min("churn_probability"), F.max("churn_probability")).first()
    assert 0 <= low < 0.2 and 0.8 < high <= 1
    # Calibrated: in each third of the scores the mean is near the rate of churn.
    third = scored.select("churn_probability", "exited").toPandas().sort_values("churn_probability")
    for k in range(3):
        part = third.iloc[k * len(third) // 3:(k + 1) * len(third) // 3]
        assert abs(part.churn_probability.mean() - part.exited.mean()) < 0.2
    again = md.TrainedModel.load(spark, _saved(trained, tmp_path))
    assert again.calibrator == trained.calibrator
    a, b = ({x.customer_id: x.churn_probability for x in md.score(t, feats).collect()} for t in (trained, again))
    assert a == b
    trained.calibrator = None
    with pytest.raises(ValueError):
        md.score(trained, feats)


def test_margins_without_signal_give_the_base_rate(spark):
    """The profile's small table: whatever the fit finds, scores stay probabilities near the rate of churn."""
    trained, feats = md.train_model(build_customer_profile(spark, SF001), "svm", maxIter=5)
    low, mean, high = md.score(trained, feats).agg(F.min("churn_probability"), F.avg("churn_probability"), F.max("churn_probability")).first()
    rate = feats.where("split = 'train'").agg(F.avg("exited")).first()[0]
    assert 0 <= low <= high <= 1 and abs(mean - rate) < 0.1


def _saved(trained, tmp_path):
    trained.save(str(tmp_path / "model"))
    return str(tmp_path / "model")
