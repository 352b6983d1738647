"""Churn classifiers with pyspark.ml.

Training is a job of its own: split (exact, stratified), median from the
training rows only, features, then ``Pipeline.fit``.  The fitted
``PipelineModel`` and the training median are saved together and reused by
batch and stream scoring, so nothing is re-fit while scoring.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrita import config as C
from attrita.functions.stats import rnd
from attrita.ml.calibration import Calibrator, fit_calibrator
from attrita.operators.evaluation import confusion_metrics, roc_auc
from attrita.operators.features import ENGINEERED_COLUMNS, engineer_features
from attrita.operators.quantile import exact_median
from attrita.operators.split import split_hash, stratified_split
from attrita.session import checkpoint_dir
from attrita.sources.sinks import materialize

NUMERIC_INPUTS = ["credit_score", "age", "tenure", "balance", "num_products", "has_cr_card",
                  "is_active_member", "estimated_salary"]
CATEGORICAL_INPUTS = ["gender", "geography"]
LABEL = "exited"
#: Kinds whose raw output is a margin: calibrated, they give probabilities.
MARGIN_KINDS = ("svm",)


def encoder_stages(categorical: list[str] = CATEGORICAL_INPUTS, handle_invalid: str = "error"):
    """One-hot with the first level (alphabetically) dropped, as get_dummies(drop_first=True).

    Indexing in descending alphabetical order puts the first level last, and
    ``dropLast`` removes it; with handleInvalid="keep" an extra bucket would be
    dropped instead, so unknown levels are an error (or skipped) here.
    """
    idx = StringIndexer(inputCols=categorical, outputCols=[f"{c}_idx" for c in categorical],
                        stringOrderType="alphabetDesc", handleInvalid=handle_invalid)
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in categorical],
                        outputCols=[f"{c}_vec" for c in categorical], dropLast=True)
    return [idx, ohe]


def feature_inputs(categorical: list[str] = CATEGORICAL_INPUTS) -> list[str]:
    """Every feature but the label, encoded categoricals last."""
    return NUMERIC_INPUTS + ENGINEERED_COLUMNS + [f"{c}_vec" for c in categorical]


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=feature_inputs(), outputCol="features", handleInvalid="keep")


def classifier(kind: str = "gbt", **params):
    if kind == "gbt":
        p = dict(C.GBT_PARAMS)
        p.update(params)
        return GBTClassifier(labelCol=LABEL, featuresCol="features", **p)
    if kind == "lr":
        # ``tol`` is a parameter; unset, Spark's default (1e-6) holds.
        p = dict(maxIter=100)
        p.update(params)
        return LogisticRegression(labelCol=LABEL, featuresCol="scaled", **p)
    if kind == "rf":
        p = dict(numTrees=100, maxDepth=8, seed=C.SEED)
        p.update(params)
        return RandomForestClassifier(labelCol=LABEL, featuresCol="features", **p)
    if kind == "svm":
        p = dict(maxIter=100, regParam=0.01)
        p.update(params)
        return LinearSVC(labelCol=LABEL, featuresCol="scaled", **p)
    raise ValueError(f"unknown model kind {kind}")


def build_pipeline(kind: str = "gbt", **params) -> Pipeline:
    stages = encoder_stages() + [assembler()]
    if kind in ("lr", "svm"):
        # Linear models see standardised features (population scale differs
        # from sample scale by a constant only).
        stages.append(StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True))
    stages.append(classifier(kind, **params))
    return Pipeline(stages=stages)


@dataclass
class TrainedModel:
    kind: str
    model: PipelineModel
    median_balance: float
    fit_seconds: float
    columns: list[str] = field(default_factory=feature_inputs)
    skipped_rows: int = 0
    calibrator: Calibrator | None = None

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path + "/model")
        spark = SparkSession.getActiveSession()
        meta = json.dumps({"kind": self.kind, "median_balance": self.median_balance,
                           "columns": self.columns, "fit_seconds": self.fit_seconds,
                           "calibrator": asdict(self.calibrator) if self.calibrator else None})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(path + "/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TrainedModel":
        meta = json.loads(spark.read.text(path + "/meta").first()[0])
        return TrainedModel(meta["kind"], PipelineModel.load(path + "/model"), meta["median_balance"],
                            meta["fit_seconds"], meta["columns"],
                            calibrator=Calibrator(**c) if (c := meta.get("calibrator")) else None)


def split_features(profile: DataFrame, test_fraction: float = C.TEST_FRACTION):
    """M1 + P20: split, training median, features for both parts, as a written table.

    The split, the median, every fit and every scoring pass read the rows: they
    are computed once, not from the profile's source tables each time."""
    split = materialize(stratified_split(materialize(profile, "profile"), test_fraction=test_fraction), "split")
    median = exact_median(split.where(F.col("split") == "train"), "balance")
    return materialize(engineer_features(split, median), "features"), median


# Least rows per training partition by model kind.  Tree histograms are
# CPU-heavy per row (features x bins x nodes); a linear model's per-row gradient
# is tiny and task count dominates.
ROWS_PER_TRAINING_PARTITION = {"gbt": 1_500, "rf": 1_500, "lr": 50_000, "svm": 50_000, "kmeans": 50_000}
# Most rows per training partition, so that a cached one fits a task's memory.
MAX_ROWS_PER_TRAINING_PARTITION = 250_000


def training_partitions(n: int, least: int) -> int:
    """Partitions for ``n`` training rows: their number and their size both
    grow with the square root of ``n``, within the two limits on the size."""
    rows = min(MAX_ROWS_PER_TRAINING_PARTITION, max(least, math.isqrt(n * least // 8)))
    return max(1, -(-n // rows))


def laid_out(df: DataFrame, rows_per_partition: int = 10_000, key: str = "customer_id") -> DataFrame:
    """The training rows, written in a layout that the rows alone decide.

    Iterative fits run one job per iteration (per tree level for trees) over
    these partitions, and trees sample rows by partition: rows are placed by a
    hash of ``key`` and sorted, in a number of partitions that follows from
    their count, so the model is the same on any cluster.  The checkpoint cuts
    the lineage behind them: each task of a fit returns the counters of all
    operators in its lineage to the driver, and there are many thousand tasks."""
    checkpoint_dir(df.sparkSession)
    return df.repartition(training_partitions(df.count(), rows_per_partition), key).sortWithinPartitions(key).checkpoint()


def sized_for_training(df: DataFrame, rows_per_partition: int = 10_000, key: str = "customer_id") -> DataFrame:
    """``laid_out`` rows, persisted; the count materialises the cache."""
    sized = laid_out(df, rows_per_partition, key).persist(StorageLevel.MEMORY_AND_DISK)
    sized.count()
    return sized


def with_fold(df: DataFrame, folds: int, key: str = "customer_id") -> DataFrame:
    """``df`` plus ``fold`` 0..folds-1, by a hash of the key (rows without key: fold 0)."""
    return df.withColumn("fold", F.coalesce(F.pmod(split_hash(key), F.lit(folds)), F.lit(0)).cast("int"))


#: Independent fits that run at once, as CrossValidator's ``parallelism``.
PARALLEL_FITS = 4


def fit_together(fits: Sequence[Callable]) -> list:
    """The results of independent fits, in order; several run as concurrent Spark jobs, so that the many short ones
    of one fit's iterations leave no executor waiting."""
    with ThreadPoolExecutor(max_workers=max(1, min(PARALLEL_FITS, len(fits)))) as pool:
        return list(pool.map(lambda fit: fit(), fits))


def fit_margin_model(train: DataFrame, kind: str, method: str, folds: int = C.CALIBRATION_FOLDS,
                     **params) -> tuple[PipelineModel, Calibrator]:
    """M9: a margin model and its calibrator.  Encoding and scaling are fitted once; the model is fitted on all rows
    and, for the calibrator, once without each fold, whose margins it then gives."""
    *stages, estimator = build_pipeline(kind, **params).getStages()
    prep = Pipeline(stages=stages).fit(train)
    vectors = with_fold(prep.transform(train), folds).select(LABEL, "fold", "scaled").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        classes = {(r["fold"], r[LABEL]) for r in vectors.select("fold", LABEL).distinct().collect()}
        kept = [f for f in range(folds) if len({label for g, label in classes if g != f}) == 2]
        model, *others = fit_together([lambda: estimator.fit(vectors), *[
            lambda f=f: estimator.fit(vectors.where(F.col("fold") != f)) for f in kept]])
        unseen = [own.transform(vectors.where(F.col("fold") == f)).select(
            LABEL, vector_to_array("rawPrediction")[1].alias("margin")) for f, own in zip(kept, others, strict=True)]
        if not unseen:      # too few rows to hold any out
            unseen = [model.transform(vectors).select(LABEL, vector_to_array("rawPrediction")[1].alias("margin"))]
        margins = materialize(reduce(DataFrame.unionByName, unseen), "margins")
    finally:
        vectors.unpersist()
    return PipelineModel(stages=[*prep.stages, model]), fit_calibrator(margins, "margin", LABEL, method)


def train_model(profile: DataFrame, kind: str = "gbt", test_fraction: float = C.TEST_FRACTION,
                feats: DataFrame | None = None, median: float | None = None, calibration: str = "isotonic",
                **params) -> tuple[TrainedModel, DataFrame]:
    """M3: fit on the training split; returns the model and the split feature table.

    A training row with a NULL or NaN label or input (a malformed field, an age
    outside every bin) can't be fitted and is left out of the fit;
    ``TrainedModel.skipped_rows`` has the count.  The feature table keeps it.
    ``calibration`` is the method that turns a margin model's margins into
    probabilities."""
    if feats is None:
        feats, median = split_features(profile, test_fraction)
    rows = feats.where(F.col("split") == "train")
    usable = rows.dropna(subset=[LABEL, *NUMERIC_INPUTS, *ENGINEERED_COLUMNS, *CATEGORICAL_INPUTS])
    train = sized_for_training(usable, ROWS_PER_TRAINING_PARTITION.get(kind, 10_000))
    try:
        t = time.time()
        if kind in MARGIN_KINDS:
            model, calibrator = fit_margin_model(train, kind, calibration, **params)
        else:
            model, calibrator = build_pipeline(kind, **params).fit(train), None
        secs = time.time() - t
        skipped = rows.count() - train.count()
    finally:
        train.unpersist()
    return TrainedModel(kind, model, median, secs, skipped_rows=skipped, calibrator=calibrator), feats


def score(trained: TrainedModel, feats: DataFrame) -> DataFrame:
    """M4: apply the fitted pipeline; adds ``churn_probability``, the class-1
    probability, for a margin model the calibrated one."""
    out = trained.model.transform(feats)
    if trained.kind not in MARGIN_KINDS:
        return out.withColumn("churn_probability", vector_to_array("probability")[1])
    if trained.calibrator is None:
        raise ValueError("a margin is no probability: this model was saved without a calibrator, train it again")
    return trained.calibrator.apply(out.withColumn("_margin", vector_to_array("rawPrediction")[1]), "_margin",
                                    "churn_probability").drop("_margin")


def score_profile(trained: TrainedModel, profile: DataFrame) -> DataFrame:
    """P20 + M4: features with the *training* median, then the model."""
    return score(trained, engineer_features(profile, trained.median_balance))


def evaluate(scored: DataFrame, kind: str | None = None, threshold: float = 0.5) -> dict:
    """M5/M6: exact AUC plus confusion metrics at ``threshold``; ``kind`` names the result."""
    scored = materialize(scored.select(LABEL, "churn_probability"), "scores")    # the model runs once
    out = roc_auc(scored, LABEL, "churn_probability").first().asDict()
    out.update(confusion_metrics(scored, LABEL, "churn_probability", threshold).first().asDict())
    return {"model": kind, **out}


def leaderboard(profile: DataFrame, kinds: list[str] = ("lr", "rf", "gbt", "svm"),
                params: dict[str, dict] | None = None, tune: Callable[[DataFrame], dict[str, dict]] | None = None) -> DataFrame:
    """M12 (+ M7-M9, M11): fit each model on the same split, score the test
    rows, rank by AUC; ``vote`` averages all models' probabilities.

    ``tune``: given the split's features, the best parameters of each kind that
    it has searched on the training rows; they add a row ``<kind>_tuned`` each."""
    params = params or {}
    feats, median = split_features(profile)
    feats = feats.persist(StorageLevel.MEMORY_AND_DISK)
    entries = [(kind, kind, params.get(kind, {})) for kind in kinds]
    entries += [(f"{kind}_tuned", kind, best) for kind, best in sorted((tune(feats) if tune else {}).items())]
    test = feats.where(F.col("split") == "test")
    rows, voters = [], []
    columns = test.columns
    for name, kind, given in entries:
        trained, _ = train_model(profile, kind, feats=feats, median=median, **given)
        # Each row carries the probabilities of all models so far: no join for the vote.
        scored = score(trained, test)
        m = evaluate(scored)
        rows.append((name, m["roc_auc"], m["f1"], m["accuracy"], m["precision"], m["recall"],
                     round(trained.fit_seconds, 3)))
        voters.append(f"_p{len(voters)}")
        columns = [*columns, voters[-1]]
        test = scored.withColumn(voters[-1], F.col("churn_probability")).select(*columns)
    if len(voters) > 1:
        # Soft vote - mean of the model probabilities.
        m = evaluate(test.withColumn("churn_probability", soft_vote(voters)))
        rows.append(("vote", m["roc_auc"], m["f1"], m["accuracy"], m["precision"], m["recall"], None))
    feats.unpersist()
    spark = profile.sparkSession
    board = spark.createDataFrame(rows, "model string, roc_auc double, f1 double, accuracy double, "
                                        "precision double, recall double, fit_seconds double")
    # relative AUC improvement over the first (baseline) model.
    base = rows[0][1] if rows and rows[0][1] else None
    return (board.withColumn("auc_lift_vs_baseline", relative_improvement(F.col("roc_auc"), F.lit(base).cast("double")))
            .orderBy(F.desc_nulls_last("roc_auc"), "model"))


def soft_vote(columns: list[str]) -> F.Column:
    """The mean of several probability columns of a row."""
    return sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / F.lit(float(len(columns)))


def relative_improvement(value: F.Column, base: F.Column) -> F.Column:
    """(value - base) / base; null without a base or for a base of 0."""
    return rnd(F.try_divide(value - base, base))


def score_leaderboard(df: DataFrame, scores: list[str], label: str = LABEL) -> DataFrame:
    """M11 + M12 + F9 for score columns that exist already: the exact AUC of
    each and of their soft vote, its rank, and its lift over the first."""
    named = [F.struct(F.lit(c).alias("model"), F.col(c).cast("double").alias("score")) for c in scores]
    # Sums of doubles differ in their last bits by engine: equal votes are equal to nine places.
    vote = F.struct(F.lit("vote").alias("model"), F.round(soft_vote(scores).cast("double"), 9).alias("score"))
    aucs = materialize(roc_auc(df.select(label, F.inline(F.array(*named, vote))), label, "score", by=["model"]), "aucs")
    base = aucs.where(F.col("model") == scores[0]).select(F.col("roc_auc").alias("base"))
    best = Window.orderBy(F.desc_nulls_last("roc_auc"), "model")         # one row a model
    return aucs.select("model", "roc_auc", "positives", "negatives", F.row_number().over(best).alias("rank"),
                       relative_improvement(F.col("roc_auc"), F.lit(_value(base)).cast("double"))
                       .alias("auc_lift_vs_baseline"))


def _value(one: DataFrame):
    row = one.first()
    return None if row is None else row[0]


def tune_gbt(profile: DataFrame, max_depth=(3, 5), step_size=(0.05, 0.1), max_iter=(50, 100),
             folds: int = 5, parallelism: int = 4) -> tuple[CrossValidator, DataFrame]:
    """K-fold grid search over the boosted trees, on the training split."""
    feats, _ = split_features(profile)
    train = feats.where(F.col("split") == "train").dropna(
        subset=[LABEL, *NUMERIC_INPUTS, *ENGINEERED_COLUMNS, *CATEGORICAL_INPUTS])
    train = sized_for_training(train, ROWS_PER_TRAINING_PARTITION["gbt"])
    pipe = build_pipeline("gbt")
    gbt = pipe.getStages()[-1]
    grid = (ParamGridBuilder().addGrid(gbt.maxDepth, list(max_depth))
            .addGrid(gbt.stepSize, list(step_size)).addGrid(gbt.maxIter, list(max_iter)).build())
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid,
                        evaluator=BinaryClassificationEvaluator(labelCol=LABEL),
                        numFolds=folds, parallelism=parallelism, seed=C.SEED)
    try:
        cv_model = cv.fit(train)
    finally:
        train.unpersist()
    spark = profile.sparkSession
    res = [({str(k.name): v for k, v in pm.items()}, float(m))
           for pm, m in zip(grid, cv_model.avgMetrics)]
    table = spark.createDataFrame([(json.dumps(p, sort_keys=True), m) for p, m in res],
                                  "params string, mean_auc double").orderBy(F.desc("mean_auc"))
    return cv_model, table
