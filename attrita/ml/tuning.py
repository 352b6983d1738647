"""Grid search over tree ensembles, with one fit for all sizes of an ensemble.

Rows get a fold by a hash of their key and stay in one cached layout of encoded
vectors: no fold is copied or shuffled.  The first m trees of a fitted ensemble
are an ensemble of m trees, so each fold fits an ensemble once per other
parameters, at the largest size, and reads every smaller size off the same
trees: cut behind each size into blocks, whose sums are columns of one scoring
pass over the fold's own rows; a size is the sum of the first blocks.  For
boosted trees that is exactly the model a fit of that size gives (tree t depends
on the seed, t and the trees before it); for a random forest it is a forest of
that size whose rows were drawn as part of the larger one's.

The exact AUC of each (point, fold) comes from one grouped job over all scores.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrita import config as C
from attrita.functions.stats import rnd
from attrita.ml import models as md
from attrita.operators.evaluation import roc_auc
from attrita.sources.sinks import materialize

#: The parameter that an ensemble's prefixes give, by kind.
SIZE = {"gbt": "maxIter", "rf": "numTrees"}


@dataclass(frozen=True)
class Grid:
    """Parameters to try: ``params`` by name, each with its values, and the ensemble ``sizes``."""
    kind: str
    params: dict[str, Sequence]
    sizes: Sequence[int]

    def points(self) -> list[dict]:
        return [dict(zip(self.params, values, strict=True)) for values in product(*self.params.values())]


DEFAULT_GRIDS = (Grid("gbt", C.GBT_GRID, C.GBT_GRID_SIZES), Grid("rf", C.RF_GRID, C.RF_GRID_SIZES))


def tree_blocks(model, ends: Sequence[int]) -> list:
    """The ensemble cut behind its first ``ends[0]``, ``ends[1]``, ... trees: a model for the trees from each end to the next."""
    own, blocks = model._java_obj, []
    for start, end in zip([0, *ends], ends):
        weights = [own.treeWeights()[start:end]] if isinstance(model, GBTClassificationModel) else []      # a forest's are all 1
        blocks.append(type(model)(model._new_java_obj(own.getClass().getName(), f"{model.uid}_{start}_{end}", own.trees()[start:end], *weights,
                                                      model.numFeatures, model.numClasses)))
    return blocks


def staged_scores(model, kind: str, vectors: DataFrame, sizes: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns plus (size, score): the class-1 probability by the first ``size`` trees, a row for each size."""
    ends = sorted({min(size, model.getNumTrees) for size in sizes})
    out = vectors
    for i, block in enumerate(tree_blocks(model, ends)):        # one column a block, all in the same pass: each tree runs once
        out = block.setRawPredictionCol(f"_r{i}").setProbabilityCol("").setPredictionCol("").transform(out)
    # The raw class-1 output is the weighted sum of boosted trees, the sum of a forest's probabilities.
    sums = F.array(*[vector_to_array(f"_r{i}")[1] for i in range(len(ends))])

    def score(size: int):
        trees = min(size, model.getNumTrees)
        summed = F.aggregate(F.slice("_sums", 1, ends.index(trees) + 1), F.lit(0.0), lambda a, x: a + x)
        return 1.0 / (1.0 + F.exp(-2.0 * summed)) if kind == "gbt" else summed / F.lit(float(trees))

    return (out.select(*keep, sums.alias("_sums"))
            .select(*keep, F.inline(F.array(*[F.struct(F.lit(s).alias("size"), score(s).alias("score")) for s in sizes]))))


def fold_scores(vectors: DataFrame, grid: Grid, folds: int) -> DataFrame:
    """(point, size, fold, label, score) of every row under every point, by models that did not see its fold, as written
    tables.  A fold without rows, or whose other rows have one class only, gives none."""
    classes = {(r["fold"], r[md.LABEL]): r["count"] for r in vectors.groupBy("fold", md.LABEL).count().collect()}
    tried = []
    for f in range(folds):
        seen = {label for (g, label), n in classes.items() if g != f and n}
        if len(seen) >= 2 and any(g == f for g, _ in classes):
            tried += [(f, k, params) for k, params in enumerate(grid.points())]

    def tried_on(f: int, k: int, params: dict) -> DataFrame:
        model = md.classifier(grid.kind, **{**params, SIZE[grid.kind]: max(grid.sizes)}).fit(vectors.where(F.col("fold") != f))
        scores = staged_scores(model, grid.kind, vectors.where(F.col("fold") == f), grid.sizes, ["fold", md.LABEL])
        return materialize(scores.withColumn("point", F.lit(k)), "fold-scores")     # no task carries the other fits' trees

    parts = md.fit_together([lambda one=one: tried_on(*one) for one in tried])
    if not parts:
        return vectors.sparkSession.createDataFrame([], f"fold int, {md.LABEL} int, size int, score double, point int")
    return reduce(DataFrame.unionByName, parts)


def usable_rows(feats: DataFrame) -> DataFrame:
    """The training rows that a model can be fitted on."""
    return feats.where(F.col("split") == "train").dropna(
        subset=[md.LABEL, *md.NUMERIC_INPUTS, *md.ENGINEERED_COLUMNS, *md.CATEGORICAL_INPUTS])


def grid_search(feats: DataFrame, grids: Sequence[Grid] = DEFAULT_GRIDS, folds: int = C.GRID_FOLDS) -> DataFrame:
    """(model, params, size, folds, mean_auc, least_auc, greatest_auc, rank): every point of every grid with its AUC over
    the folds of the training rows; rank 1 is a kind's best (ties: the smaller ensemble, then the parameters' text)."""
    spark, boards = feats.sparkSession, []
    for grid in grids:
        train = md.sized_for_training(usable_rows(feats), md.ROWS_PER_TRAINING_PARTITION[grid.kind])
        prep = Pipeline(stages=build_stages()).fit(train)
        vectors = md.with_fold(prep.transform(train), folds).select("fold", md.LABEL, "features").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            scores = fold_scores(vectors, grid, folds)
        finally:
            vectors.unpersist()
            train.unpersist()
        names = spark.createDataFrame([(k, json.dumps(p, sort_keys=True)) for k, p in enumerate(grid.points())], "point int, params string")
        aucs = roc_auc(scores, md.LABEL, "score", by=["point", "size", "fold"]).where("roc_auc is not null")
        board = (aucs.groupBy("point", "size").agg(
            F.count(F.lit(1)).alias("folds"), rnd(F.avg("roc_auc")).alias("mean_auc"), F.min("roc_auc").alias("least_auc"),
            F.max("roc_auc").alias("greatest_auc")).join(F.broadcast(names), "point"))      # one row a point
        best = Window.partitionBy("model").orderBy(F.desc("mean_auc"), "size", "params")
        boards.append(board.withColumn("model", F.lit(grid.kind)).select(
            "model", "params", "size", "folds", "mean_auc", "least_auc", "greatest_auc", F.row_number().over(best).alias("rank")))
    return materialize(reduce(DataFrame.unionByName, boards), "grid-search")


def build_stages() -> list:
    """Encoding up to the vector that tree ensembles read."""
    return md.encoder_stages() + [md.assembler()]


def best_params(board: DataFrame) -> dict[str, dict]:
    """The best point of each kind as the arguments of ``train_model``."""
    return {r["model"]: {**json.loads(r["params"]), SIZE[r["model"]]: r["size"]} for r in board.where("rank = 1").collect()}
