"""The named queries: each takes (spark, sf_dir) and returns a DataFrame.

They read the star-schema tables under ``sf_dir`` (customer profile built by
``build_customer_profile``) and run the package's operators over all rows.
``attrita.plans.oracle`` holds the equivalent SQL for each one that SQL can
express.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrita import config as C
from attrita.functions.stats import rnd
from attrita.operators import centres
from attrita.operators import correlation as corr
from attrita.operators import escalation as esc
from attrita.operators import evaluation as ev
from attrita.operators import explore as ex
from attrita.operators import gram
from attrita.operators import rules as ru
from attrita.operators import segments as sg
from attrita.operators.features import (align_columns, category_levels, engineer_features, one_hot_drop_first,
                                        yes_no_flag)
from attrita.operators.quantile import exact_median, exact_quantiles
from attrita.operators.split import stratified_split
from attrita.session import scratch_path
from attrita.sources.customer_csv import customer_lines, ingest_customer_csv
from attrita.sources.profile import build_customer_profile
from attrita.sources.reuse import ReusedTables
from attrita.sources.tables import table_path
from attrita.streaming import activity as act

GEO = C.TEST_HIGH_RISK_REGION
CATEGORIES = ["gender", "geography"]
YES_NO = ["has_cr_card", "is_active_member"]
INACTIVITY_DAYS = 1.0


#: The tables that the profile is built from.
PROFILE_TABLES = ["customer", "nation", "orders", "region"]
_MATERIALIZED: dict[str, ReusedTables] = {}


def _reused_profile(spark: SparkSession, sf_dir: str, tables: ReusedTables) -> DataFrame:
    name = "profile-" + hashlib.blake2b(sf_dir.encode(), digest_size=6).hexdigest()
    return tables.get(name, [table_path(sf_dir, t) for t in PROFILE_TABLES], lambda: build_customer_profile(spark, sf_dir))


def use_materialized_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From now on queries on ``sf_dir`` read the profile as a written table
    (S3), as a deployment that refreshes it and queries it many times; it is
    built now, and again when the files that it is built from have changed."""
    _MATERIALIZED[sf_dir] = ReusedTables(spark)
    return _reused_profile(spark, sf_dir, _MATERIALIZED[sf_dir])


def drop_materialized_profile(sf_dir: str) -> None:
    _MATERIALIZED.pop(sf_dir, None)


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _MATERIALIZED.get(sf_dir)
    return _reused_profile(spark, sf_dir, tables) if tables else build_customer_profile(spark, sf_dir)


def _features(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return engineer_features(_profile(spark, sf_dir), columns=columns)


def q_customer_profile(spark, sf_dir):
    return _profile(spark, sf_dir)


def q_ingested_customers(spark, sf_dir):
    """S1 + P1: the profile written as CSV lines, some of them spoilt by customer
    number, and read back: customers (reason "") and quarantine (values "" or -1)."""
    lines = customer_lines(_profile(spark, sf_dir))
    field = lambda i, new: F.array_join(F.concat(F.slice("f", 1, i), F.array(F.lit(new)), F.slice("f", i + 2, 99)), ",")
    k = F.pmod("customer_id", F.lit(C.SPOILT_EVERY))
    f = F.split("value", r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    spoilt = (F.when(k == 1, F.array_join(F.slice("f", 1, 13), ",")).when(k == 2, F.concat("value", F.lit(",extra")))
              .when(k == 3, field(6, "forty")).when(k == 4, field(13, "7")).when(k == 5, field(13, "")).otherwise(F.col("value")))
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex[:12]}")
    lines.withColumn("f", f).select(spoilt.alias("value")).write.text(path + "/lines")
    got = ingest_customer_csv(spark, path + "/lines", path + "/table", header=False)
    none = [F.lit("" if t == "string" else -1).cast(t).alias(c) for c, t in got.customers.dtypes if c != "customer_id"]
    number = F.split("line", ",")[0].cast("long")
    return got.customers.withColumn("reason", F.lit("")).unionByName(
        got.quarantine.select(number.alias("customer_id"), *none, "reason"))


def q_customer_features(spark, sf_dir):
    return _features(spark, sf_dir)


def q_median_balance(spark, sf_dir):
    return exact_quantiles(_profile(spark, sf_dir), ["balance"], [0.5]).select(
        rnd("value").alias("median_balance"))


def q_kpis(spark, sf_dir):
    return ex.kpis(_profile(spark, sf_dir))


def q_describe_numeric(spark, sf_dir):
    return ex.describe(_profile(spark, sf_dir), C.NUMERIC_COLUMNS)


def q_describe_by_class(spark, sf_dir):
    return ex.describe_transposed(_profile(spark, sf_dir), C.NUMERIC_COLUMNS)


def q_class_counts(spark, sf_dir):
    return ex.class_counts(_profile(spark, sf_dir))


def q_one_hot_features(spark, sf_dir):
    """P14 (SQL form) + P13: every feature, engineered ones too, with drop-first
    dummies for the levels that the data hold."""
    return _one_hot(_features(spark, sf_dir), category_levels(_profile(spark, sf_dir), CATEGORIES)).drop("segment", "exited")


def _one_hot(feats: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    for c in CATEGORIES:
        feats = one_hot_drop_first(feats, c, levels[c])
    return feats.drop(*CATEGORIES)


def q_aligned_model_rows(spark, sf_dir):
    """P12 + P15 + P20: customers as entered (a name, Yes/No answers) become
    rows of the training columns: answers to flags, features with the training
    median, dummies of the training levels, columns in training order (one that
    the rows lack, here a level that no customer has, is 0)."""
    prof = _profile(spark, sf_dir)
    train = stratified_split(prof).where("split = 'train'")
    levels = category_levels(train, CATEGORIES)
    median = exact_median(train, "balance")
    columns = ["customer_id", *_one_hot(engineer_features(train, median), levels).drop(
        "customer_id", "segment", "exited", "split").columns, "geography_UNSEEN"]
    answer = lambda c: F.when(F.col(c) == 1, F.lit("Yes")).otherwise(F.lit("No")).alias(c)
    entered = prof.select(*[answer(c) if c in YES_NO else F.col(c) for c in prof.columns],
                          F.lit("x").alias("surname"))
    flags = entered.select(*[yes_no_flag(c).alias(c) if c in YES_NO else F.col(c) for c in entered.columns])
    return align_columns(_one_hot(engineer_features(flags.drop("surname"), median), levels), columns)


def q_churned_only(spark, sf_dir):
    """Churned customers' numeric columns (filter by class)."""
    return _profile(spark, sf_dir).where(F.col("exited") == 1).select("customer_id", *C.NUMERIC_COLUMNS)


def q_bin_coverage(spark, sf_dir):
    """Out-of-range and null rows per binned feature (bins give null, not an error)."""
    return ex.bin_coverage(_profile(spark, sf_dir))


def q_churn_by_geography(spark, sf_dir):
    return ex.churn_rate_by(_profile(spark, sf_dir), "geography")


def q_churn_by_gender(spark, sf_dir):
    return ex.churn_rate_by(_profile(spark, sf_dir), "gender")


def q_churn_by_products(spark, sf_dir):
    return ex.churn_rate_by(_profile(spark, sf_dir), "num_products")


def q_churn_by_activity(spark, sf_dir):
    return ex.churn_rate_by_code(_profile(spark, sf_dir), "is_active_member", C.ACTIVITY_LABELS, 0)


def q_churn_by_age_group(spark, sf_dir):
    return ex.churn_rate_by_code(_features(spark, sf_dir, ["age_group"]), "age_group", C.AGE_LABELS)


def q_churn_by_credit_category(spark, sf_dir):
    return ex.churn_rate_by_code(_features(spark, sf_dir, ["credit_score_category"]), "credit_score_category",
                                 C.CREDIT_LABELS)


def q_churn_by_tenure_category(spark, sf_dir):
    return ex.churn_rate_by_code(_features(spark, sf_dir, ["tenure_category"]), "tenure_category",
                                 C.TENURE_LABELS)


def q_churn_overview(spark, sf_dir):
    """All the churn rates by one column from one scan."""
    return ex.churn_overview(_features(spark, sf_dir, ["age_group", "credit_score_category", "tenure_category"]))


def q_churn_by_risk_level(spark, sf_dir):
    return ex.churn_rate_by_equal_width(_features(spark, sf_dir, ["complain_risk_score"]), "complain_risk_score",
                                        C.RISK_SCORE_LEVELS)


def q_feature_histogram(spark, sf_dir):
    return ex.histogram(_profile(spark, sf_dir), C.NUMERIC_COLUMNS, C.HISTOGRAM_BINS)


def q_feature_histogram_by_class(spark, sf_dir):
    return ex.histogram(_profile(spark, sf_dir), C.NUMERIC_COLUMNS, C.HISTOGRAM_BINS, by_class=True)


def q_risk_score_histogram(spark, sf_dir):
    return ex.histogram(_features(spark, sf_dir, ["complain_risk_score"]), ["complain_risk_score"],
                        C.RISK_HISTOGRAM_BINS, by_class=True)


def q_correlation_matrix(spark, sf_dir):
    return corr.correlation_matrix(_profile(spark, sf_dir), C.CORRELATION_COLUMNS)


def q_wide_correlation_matrix(spark, sf_dir):
    """A17 over every numeric feature, engineered ones and the label included."""
    return gram.wide_correlation_matrix(_features(spark, sf_dir), C.WIDE_CORRELATION_COLUMNS)


def q_churn_correlation(spark, sf_dir):
    return corr.correlation_with(_profile(spark, sf_dir), C.CORRELATION_COLUMNS)


def q_feature_power(spark, sf_dir):
    return corr.feature_power(_features(spark, sf_dir), C.ORIGINAL_FEATURES, C.ENGINEERED_FEATURES)


def q_given_centre_quality(spark, sf_dir):
    """G1 + G2 + G4 on given centres: standardised customers, their nearest centre, cost and silhouette."""
    return centres.centre_quality(_profile(spark, sf_dir), C.CENTRE_COLUMNS, C.GIVEN_CENTRES)


def q_segment_profile(spark, sf_dir):
    return sg.segment_profile(_profile(spark, sf_dir))


def q_segment_sizes(spark, sf_dir):
    return sg.segment_sizes(_profile(spark, sf_dir))


def q_segment_summary(spark, sf_dir):
    return sg.summary_table(_profile(spark, sf_dir))


def q_segment_profile_table(spark, sf_dir):
    return sg.profile_table(_profile(spark, sf_dir))


def q_segment_strategy(spark, sf_dir):
    return sg.segment_strategy(_profile(spark, sf_dir))


def q_segment_impact(spark, sf_dir):
    return sg.segment_impact(_profile(spark, sf_dir))


def q_segment_budget(spark, sf_dir):
    return sg.segment_budget(_profile(spark, sf_dir))


def q_segment_budget_totals(spark, sf_dir):
    return sg.budget_totals(_profile(spark, sf_dir))


def q_rule_scores(spark, sf_dir):
    return ru.rule_score_report(_profile(spark, sf_dir), GEO)


def q_rule_factor_weights(spark, sf_dir):
    return ru.factor_weights(_profile(spark, sf_dir), GEO)


def q_rule_waterfall(spark, sf_dir):
    return ru.waterfall(_profile(spark, sf_dir), GEO)


def q_retention_actions(spark, sf_dir):
    return ru.retention_actions(_profile(spark, sf_dir), GEO)


def q_risk_portfolio(spark, sf_dir):
    return ru.risk_portfolio(_profile(spark, sf_dir), GEO)


def q_rule_confusion(spark, sf_dir):
    return ev.confusion_metrics(ru.rule_scores(_profile(spark, sf_dir), GEO))


def q_rule_auc(spark, sf_dir):
    return ev.roc_auc(ru.rule_scores(_profile(spark, sf_dir), GEO))


def q_stratified_split(spark, sf_dir):
    return stratified_split(_profile(spark, sf_dir)).select("customer_id", "exited", "split")


def q_split_counts(spark, sf_dir):
    s = stratified_split(_profile(spark, sf_dir))
    return s.groupBy("exited", "split").agg(F.count(F.lit(1)).alias("customers"))


def q_inactivity_alerts(spark, sf_dir):
    return act.inactivity_alerts(act.load_events(spark, sf_dir), INACTIVITY_DAYS)


def q_inactivity_silences(spark, sf_dir):
    return act.inactivity_silences(act.load_events(spark, sf_dir), INACTIVITY_DAYS)


def q_escalations(spark, sf_dir):
    """The monitoring plan's escalation triggers with their actions."""
    return esc.escalations(act.load_events(spark, sf_dir))


def q_weekly_activity(spark, sf_dir):
    return act.weekly_activity(act.load_events(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "customer_profile": q_customer_profile,
    "ingested_customers": q_ingested_customers,
    "customer_features": q_customer_features,
    "median_balance": q_median_balance,
    "kpis": q_kpis,
    "one_hot_features": q_one_hot_features,
    "aligned_model_rows": q_aligned_model_rows,
    "churned_only": q_churned_only,
    "bin_coverage": q_bin_coverage,
    "describe_numeric": q_describe_numeric,
    "describe_by_class": q_describe_by_class,
    "class_counts": q_class_counts,
    "churn_by_geography": q_churn_by_geography,
    "churn_by_gender": q_churn_by_gender,
    "churn_by_products": q_churn_by_products,
    "churn_by_activity": q_churn_by_activity,
    "churn_by_age_group": q_churn_by_age_group,
    "churn_by_credit_category": q_churn_by_credit_category,
    "churn_by_tenure_category": q_churn_by_tenure_category,
    "churn_by_risk_level": q_churn_by_risk_level,
    "churn_overview": q_churn_overview,
    "feature_histogram": q_feature_histogram,
    "feature_histogram_by_class": q_feature_histogram_by_class,
    "risk_score_histogram": q_risk_score_histogram,
    "correlation_matrix": q_correlation_matrix,
    "wide_correlation_matrix": q_wide_correlation_matrix,
    "churn_correlation": q_churn_correlation,
    "feature_power": q_feature_power,
    "given_centre_quality": q_given_centre_quality,
    "segment_profile": q_segment_profile,
    "segment_sizes": q_segment_sizes,
    "segment_summary": q_segment_summary,
    "segment_profile_table": q_segment_profile_table,
    "segment_strategy": q_segment_strategy,
    "segment_impact": q_segment_impact,
    "segment_budget": q_segment_budget,
    "segment_budget_totals": q_segment_budget_totals,
    "rule_scores": q_rule_scores,
    "rule_factor_weights": q_rule_factor_weights,
    "rule_waterfall": q_rule_waterfall,
    "retention_actions": q_retention_actions,
    "risk_portfolio": q_risk_portfolio,
    "rule_confusion": q_rule_confusion,
    "rule_auc": q_rule_auc,
    "stratified_split": q_stratified_split,
    "split_counts": q_split_counts,
    "inactivity_alerts": q_inactivity_alerts,
    "inactivity_silences": q_inactivity_silences,
    "weekly_activity": q_weekly_activity,
    "escalations": q_escalations,
}
