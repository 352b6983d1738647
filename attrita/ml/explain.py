"""Model explanation.

E1: impurity importances of the tree model; permutation importance, where
each feature is replaced by its value on another row (a cyclic shift of a hash
order, done as a join on the shifted position) and the exact AUC drop is
measured.  E2: additive contributions of a linear model on
standardised features, coef_i * z_i, exact in log-odds; E3/E4 aggregate them.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrita import config as C
from attrita.functions.stats import rnd
from attrita.ml.models import CATEGORICAL_INPUTS, LABEL, MARGIN_KINDS, TrainedModel, feature_inputs
from attrita.operators.evaluation import roc_auc
from attrita.operators.prefix import ordered_cumulative
from attrita.operators.split import split_hash
from attrita.sources.sinks import materialize


def expanded_feature_names(trained: TrainedModel, feats: DataFrame) -> list[str]:
    """Names of the assembled vector's slots (one-hot slots named by level)."""
    stages = trained.model.stages
    indexer = stages[0]
    names = []
    labels = dict(zip(indexer.getInputCols(), indexer.labelsArray))
    for c in feature_inputs():
        if c.endswith("_vec"):
            base = c[:-4]
            levels = labels[base][:-1]          # the last (alphabetically first) level is dropped
            names.extend(f"{base}_{lvl}" for lvl in levels)
        else:
            names.append(c)
    return names


def tree_importance(trained: TrainedModel, feats: DataFrame) -> DataFrame:
    """E1 + O2 + W3: impurity importance per slot, sorted, with cumulative
    share and the 80 % mark (one row per feature: a small table)."""
    model = trained.model.stages[-1]
    names = expanded_feature_names(trained, feats)
    imp = model.featureImportances.toArray().tolist()
    spark = feats.sparkSession
    return cumulative_importance(
        spark.createDataFrame(list(zip(names, [float(x) for x in imp])), "feature string, importance double"))


def cumulative_importance(df: DataFrame) -> DataFrame:
    """O1 + W3 over (feature, importance), one row per feature."""
    order = Window.orderBy(F.desc("importance"), "feature")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("importance").over(Window.partitionBy())
    out = df.select("feature", "importance",
                    F.row_number().over(order).alias("rank"),
                    (F.sum("importance").over(run) * 100.0 / total).alias("cumulative_pct"))
    first80 = F.min(F.when(F.col("cumulative_pct") >= 80.0, F.col("rank"))).over(Window.partitionBy())
    return out.select("*", (F.col("rank") <= first80).alias("within_80pct"))


def top_features(importance: DataFrame, k: int = 10) -> DataFrame:
    """O2: the k most important features (a top-k report)."""
    return importance.orderBy("rank").limit(k)


def permutation_importance(trained: TrainedModel, feats: DataFrame, columns: list[str] | None = None,
                           key: str = "customer_id", seed: int = 7) -> DataFrame:
    """Exact AUC drop when one input column is permuted across rows.

    Rows get a hash position 0..n-1 (exact, distributed ranks).  Permuting a
    column means taking it from the row at position (p + shift) mod n.  Rows are
    encoded once, into the vector that the model reads; one join on the computed
    position brings each row its donor's vector.  A permuted column is then the
    row's own vector with that column's places taken from the donor, scored as
    one more column: a row stays one row, and only (column, score, label)
    triples, combined by score, are shuffled for the exact AUC of each column.
    """
    columns = columns or [c for c in feature_inputs() if not c.endswith("_vec")] + CATEGORICAL_INPUTS
    *prep, model = trained.model.stages
    vector = model.getFeaturesCol()
    names = expanded_feature_names(trained, feats)
    places = {c: [i for i, n in enumerate(names) if n == c or c in CATEGORICAL_INPUTS and n.startswith(f"{c}_")] for c in columns}
    h = F.pmod(split_hash(key) + F.lit(seed), F.lit(2147483647))
    coded = PipelineModel(stages=prep).transform(feats).select(
        key, LABEL, vector_to_array(vector).alias("_x"), h.alias("_h"), F.lit(1).alias("_one"))
    ranked = ordered_cumulative(coded, [], "_h", ["_one"], tiebreak_cols=[key])
    pos = materialize(ranked.select((F.col("cum__one") - 1).alias("_pos"), LABEL, "_x"), "permutation-positions")
    n = pos.count()
    shift = max(1, n // 2)
    donors = pos.select(F.pmod(F.col("_pos") - F.lit(shift), F.lit(max(1, n))).alias("_pos"), F.col("_x").alias("_donor"))
    rows = pos.join(donors, "_pos")
    scores = []
    for k, c in enumerate([None, *columns]):
        own = F.array(*[F.col("_donor" if c and i in places[c] else "_x")[i] for i in range(len(names))])
        out = model.copy().setFeaturesCol(f"_v{k}").setPredictionCol(f"_c{k}").setRawPredictionCol(f"_r{k}")
        if trained.kind not in MARGIN_KINDS:
            out = out.setProbabilityCol(f"_q{k}")
        rows = out.transform(rows.withColumn(f"_v{k}", array_to_vector(own)))
        # A calibrated margin and the margin itself have the same order.
        value = vector_to_array(f"_r{k}" if trained.kind in MARGIN_KINDS else f"_q{k}")[1]
        rows = rows.withColumn(f"_s{k}", value).drop(f"_v{k}", f"_c{k}", f"_r{k}", f"_q{k}")
        scores.append(F.struct(F.lit(c or "__none__").alias("permuted"), F.col(f"_s{k}").alias("score")))
    long = rows.select(LABEL, F.inline(F.array(*scores)))
    # One row per permuted column: collected once, so the scoring pass runs once.
    aucs = {r["permuted"]: r["roc_auc"] for r in roc_auc(long, LABEL, "score", by=["permuted"]).collect()}
    base_auc = aucs.pop("__none__", None)
    drops = [(c, None if base_auc is None or a is None else float(base_auc - a)) for c, a in aucs.items()]
    return (feats.sparkSession.createDataFrame(drops, "feature string, auc_drop double")
            .orderBy(F.desc_nulls_last("auc_drop"), "feature"))


def linear_contributions(trained: TrainedModel, feats: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Per customer, coef_i * z_i for every slot of the linear model
    (z = standardised features), the base (intercept) and the total logit;
    columns in ``keep`` are carried through."""
    if trained.kind != "lr":
        raise ValueError("additive contributions need the logistic-regression model")
    lr = trained.model.stages[-1]
    names = expanded_feature_names(trained, feats)
    coef = [float(x) for x in lr.coefficients.toArray()]
    out = trained.model.transform(feats)
    z = vector_to_array("scaled")
    contrib = F.zip_with(z, F.array(*[F.lit(c) for c in coef]), lambda a, b: a * b)
    return out.select("customer_id", LABEL, *(keep or []),
                      F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"),
                                   contrib.alias("contribution")).alias("contributions"),
                      F.lit(float(lr.intercept)).alias("base"),
                      (F.lit(float(lr.intercept)) + F.aggregate(contrib, F.lit(0.0), lambda a, b: a + b))
                      .alias("logit"))


def mean_abs_contribution(contribs: DataFrame) -> DataFrame:
    """Mean |contribution| per feature (a grouped aggregate over the
    exploded contributions; partial aggregation keeps the shuffle small)."""
    ex = contribs.select(F.inline("contributions"))
    return (ex.groupBy("feature").agg(rnd(F.avg(F.abs("contribution"))).alias("mean_abs_contribution"))
            .orderBy(F.desc("mean_abs_contribution")))


def contribution_by_band(contribs: DataFrame, feature: str, band: F.Column) -> DataFrame:
    """Mean contribution of ``feature`` per band of the customer's value;
    ``contribs`` carries the column that ``band`` reads."""
    ex = contribs.select(band.alias("band"), F.inline("contributions")).where(F.col("feature") == feature)
    return ex.groupBy("band").agg(rnd(F.avg("contribution")).alias("mean_contribution"),
                                  F.count(F.lit(1)).alias("customers"))


def band_columns() -> dict[str, F.Column]:
    """Feature -> band of its value: age bands, products 1..4, active 0/1, balance bands."""
    return {"age": age_band(), "num_products": F.col("num_products").cast("string"),
            "is_active_member": F.col("is_active_member").cast("string"), "balance": balance_band()}


def contributions_by_bands(contribs: DataFrame, bands: dict[str, F.Column] | None = None) -> DataFrame:
    """E4 for several banded views at once: each contribution finds its band in
    its own row, so one explode and one grouped aggregate do it."""
    bands = bands or band_columns()
    by_feature = F.create_map(*[x for f, band in bands.items() for x in (F.lit(f), band)])
    ex = (contribs.select(by_feature.alias("bands"), F.inline("contributions"))
          .where(F.col("feature").isin(*bands))
          .select("feature", F.element_at("bands", F.col("feature")).alias("band"), "contribution"))
    return ex.groupBy("feature", "band").agg(rnd(F.avg("contribution")).alias("mean_contribution"),
                                             F.count(F.lit(1)).alias("customers"))


def _bands(col: str, bands: list, zero_label: str | None = None) -> F.Column:
    """Band label of ``col``; a NULL or NaN value has none."""
    c = F.col(col)
    known = c.isNotNull() & ~F.isnan(c.cast("double"))
    expr = F.when(~known, F.lit(None).cast("string"))
    if zero_label is not None:
        expr = expr.when(c == 0, F.lit(zero_label))
    for (upper, label), (beyond, _) in zip(bands[:-1], bands[1:], strict=True):
        expr = expr.when(c <= upper if beyond is None else c < upper, F.lit(label))
    return expr.otherwise(F.lit(bands[-1][1]))


def age_band() -> F.Column:
    return _bands("age", C.EXPLAIN_AGE_BANDS)


def balance_band() -> F.Column:
    return _bands("balance", C.EXPLAIN_BALANCE_BANDS, zero_label="0")
