"""Grid search: prefixes of an ensemble are models, folds are unseen, the result is the best point."""

import json

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from attrita import config as C
from attrita.ml import models as md
from attrita.ml import tuning
from attrita.plans import ml_catalog
from tests.test_calibration import planted


@pytest.fixture(scope="module")
def feats(spark):
    feats, _ = md.split_features(planted(spark, 300))
    return feats.cache()


@pytest.fixture(scope="module")
def vectors(feats):
    train = tuning.usable_rows(feats)
    out = Pipeline(stages=tuning.build_stages()).fit(train).transform(train)
    return md.with_fold(out, 3).select("customer_id", "fold", md.LABEL, "features").repartition(1).sortWithinPartitions("customer_id").cache()


def test_prefix_of_boosted_trees_is_the_smaller_fit(vectors):
    params = {"maxDepth": 3, "stepSize": 0.1}
    large = md.classifier("gbt", **params, maxIter=6).fit(vectors)
    staged = tuning.staged_scores(large, "gbt", vectors, [2, 4, 6], ["customer_id"])
    for size in (2, 4, 6):
        own = md.classifier("gbt", **params, maxIter=size).fit(vectors).transform(vectors)
        want = {r.customer_id: r.p for r in own.select("customer_id", vector_to_array("probability")[1].alias("p")).collect()}
        got = {r.customer_id: r.score for r in staged.where(F.col("size") == size).collect()}
        assert got == pytest.approx(want, abs=1e-12)


def test_all_trees_of_a_forest_are_the_forest(vectors):
    model = md.classifier("rf", maxDepth=4, numTrees=5).fit(vectors)
    want = {r.customer_id: r.p for r in model.transform(vectors).select("customer_id", vector_to_array("probability")[1].alias("p")).collect()}
    got = {r.customer_id: r.score for r in tuning.staged_scores(model, "rf", vectors, [5], ["customer_id"]).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    first = tuning.staged_scores(model, "rf", vectors, [1, 3], ["customer_id"])
    assert first.where("score < 0 or score > 1").count() == 0 and first.count() == 2 * len(got)


def test_sizes_are_sums_of_their_first_trees(vectors):
    """In any order, and beyond the trees there are."""
    model = md.classifier("rf", maxDepth=3, numTrees=4).fit(vectors)
    got = {(r.customer_id, r.size): r.score for r in tuning.staged_scores(model, "rf", vectors, [9, 1, 3], ["customer_id"]).collect()}
    each = [{r.customer_id: r.p for r in tree.transform(vectors).select("customer_id", vector_to_array("probability")[1].alias("p")).collect()}
            for tree in model.trees]
    want = {(c, size): sum(tree[c] for tree in each[:size]) / min(size, 4) for c in each[0] for size in (9, 1, 3)}
    assert got == pytest.approx(want, abs=1e-12)


def test_the_query_searches_the_whole_grids(spark, monkeypatch, tmp_path):
    """Every point of both grids is fitted at its largest size without each of the five folds (here stand-ins of two trees)."""
    asked, classifier = [], md.classifier

    def small(kind, **params):
        asked.append((kind, params))
        return classifier(kind, **{**params, "maxDepth": 1, tuning.SIZE[kind]: 2})

    monkeypatch.setattr(md, "classifier", small)
    monkeypatch.setattr(ml_catalog, "_MEMO", {})
    monkeypatch.setattr(ml_catalog, "input_version", lambda *_: 0)
    monkeypatch.setattr(ml_catalog, "_profile", lambda *_: planted(spark, 300))
    rows = ml_catalog.ML_QUERIES["grid_search"](spark, str(tmp_path)).collect()
    points = {"gbt": [{"maxDepth": d, "stepSize": s} for d in (3, 5) for s in (0.05, 0.1)],
              "rf": [{"maxDepth": d, "minInstancesPerNode": n} for d in (5, 8) for n in (1, 5)]}
    want = [(kind, {**point, tuning.SIZE[kind]: 100}) for kind in points for point in points[kind] for _ in range(5)]
    assert sorted(map(str, asked)) == sorted(map(str, want))
    assert {(r.model, r.params, r["size"]) for r in rows} == {
        (kind, json.dumps(point, sort_keys=True), size) for kind in points for point in points[kind] for size in (50, 100)}
    assert len(rows) == 16 and {r.folds for r in rows} == {C.GRID_FOLDS} == {5}


def test_grid_search_finds_the_best_point(spark, feats):
    grids = (tuning.Grid("gbt", {"maxDepth": (1, 3)}, (1, 4)), tuning.Grid("rf", {"maxDepth": (1, 4)}, (2, 6)))
    board = tuning.grid_search(feats, grids, folds=3)
    rows = board.collect()
    assert len(rows) == 8 and all(r.folds == 3 and r.least_auc <= r.mean_auc <= r.greatest_auc for r in rows)
    best = tuning.best_params(board)
    for kind in ("gbt", "rf"):
        own = [r for r in rows if r.model == kind]
        top = next(r for r in own if r["rank"] == 1)
        assert top.mean_auc == max(r.mean_auc for r in own) > 0.7
        assert best[kind] == {**json.loads(top.params), tuning.SIZE[kind]: top.size}


def test_mean_auc_is_the_mean_over_unseen_folds(spark, feats):
    """By hand: fit without each fold, score it, count the pairs."""
    grid = tuning.Grid("gbt", {"maxDepth": (2,), "stepSize": (0.1,)}, (3,))
    got = tuning.grid_search(feats, [grid], folds=3).first()
    train = md.sized_for_training(tuning.usable_rows(feats), md.ROWS_PER_TRAINING_PARTITION["gbt"])
    rows = md.with_fold(Pipeline(stages=tuning.build_stages()).fit(train).transform(train), 3).cache()
    aucs = []
    for f in range(3):
        model = md.classifier("gbt", maxDepth=2, stepSize=0.1, maxIter=3).fit(rows.where(F.col("fold") != f))
        own = model.transform(rows.where(F.col("fold") == f)).select(md.LABEL, vector_to_array("probability")[1].alias("p")).toPandas()
        pos, neg = own.p[own.exited == 1].to_numpy(), own.p[own.exited == 0].to_numpy()
        aucs.append(np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)))
    assert got.mean_auc == pytest.approx(np.mean(aucs), abs=2e-6)


def test_folds_without_rows_or_classes(spark, feats):
    grid = [tuning.Grid("rf", {"maxDepth": (2,)}, (2,))]
    one_class = feats.where("exited = 1")
    assert tuning.grid_search(one_class, grid, folds=2).count() == 0


def test_tuned_rows_on_the_leaderboard(spark):
    board = md.leaderboard(planted(spark, 300), ["lr"], {"lr": {"maxIter": 5}},
                           tune=lambda feats: {"rf": {"maxDepth": 3, "numTrees": 3}, "gbt": {"maxDepth": 2, "maxIter": 2}})
    assert {r.model for r in board.collect()} == {"lr", "rf_tuned", "gbt_tuned", "vote"}
