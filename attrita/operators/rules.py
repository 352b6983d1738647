"""Rule scoring and retention actions.

Scoring is a single projection per customer (no shuffle); the only joins are
to the three-row plan table, which is broadcast.  The factor explode and the
waterfall work inside each customer's row (at most nine factors), so they
need no shuffle either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrita import config as C
from attrita.functions import rules as R
from attrita.functions.stats import rnd

SCORE_COLUMNS = ["customer_id", "rule_score", "churn_probability", "risk_level", "n_factors",
                 "confidence", "expected_ltv_loss", "risk_factors"]


def rule_scores(df: DataFrame, high_risk_geography: str = C.RULE_HIGH_RISK_GEOGRAPHY,
                probability: Column | None = None) -> DataFrame:
    """R1-R7 per customer.  ``probability`` (e.g. a model's) replaces the
    capped rule score when given, as on the prediction page."""
    score_h = R.score_hundredths(high_risk_geography)
    factors = R.factor_texts(high_risk_geography)
    prob = probability if probability is not None else R.capped_probability(score_h)
    base = df.select("*", score_h.alias("_score_h"), factors.alias("risk_factors"), prob.alias("_prob"))
    keep = [c for c in base.columns if c not in ("churn_probability", "_prob", "rule_score")]
    return base.select(
        *keep,
        (F.col("_score_h") / F.lit(100.0)).alias("rule_score"),
        F.col("_prob").alias("churn_probability"),
    ).select(
        "*",
        R.risk_level(F.col("churn_probability")).alias("risk_level"),
        F.size("risk_factors").alias("n_factors"),
        R.confidence(F.size("risk_factors")).alias("confidence"),
        R.expected_ltv_loss(F.col("churn_probability")).alias("expected_ltv_loss"),
    ).drop("_score_h")


def rule_score_report(df: DataFrame, high_risk_geography: str = C.RULE_HIGH_RISK_GEOGRAPHY) -> DataFrame:
    """R1-R7 as flat columns (factor texts joined with ' | ')."""
    s = rule_scores(df, high_risk_geography)
    return s.select("customer_id", "rule_score", "churn_probability", "risk_level", "n_factors",
                    "confidence", "expected_ltv_loss",
                    F.array_join("risk_factors", " | ").alias("factor_text"))


def factor_weights(df: DataFrame, high_risk_geography: str = C.RULE_HIGH_RISK_GEOGRAPHY) -> DataFrame:
    """One row per (customer, factor that applies) with its weight."""
    return (df.select("customer_id", F.inline(R.weight_entries(high_risk_geography)))
            .select("customer_id", "factor", (F.col("weight_hundredths") / F.lit(100.0)).alias("weight")))


def waterfall(df: DataFrame, high_risk_geography: str = C.RULE_HIGH_RISK_GEOGRAPHY) -> DataFrame:
    """E5 + W4: factor contributions in ascending order with the running total;
    the last step's total is the rule score.

    The running total is computed inside each customer's row (sort the at
    most nine factors, sum each prefix), so no window and no shuffle.
    """
    entries = F.array_sort(
        R.weight_entries(high_risk_geography),
        lambda a, b: F.when(a["weight_hundredths"] < b["weight_hundredths"], -1)
                      .when(a["weight_hundredths"] > b["weight_hundredths"], 1)
                      .when(a["factor"] < b["factor"], -1)
                      .when(a["factor"] > b["factor"], 1).otherwise(0))
    steps = F.transform(entries, lambda e, i: F.struct(
        (i + 1).alias("step"), e["factor"].alias("factor"), e["weight_hundredths"].alias("w"),
        F.aggregate(F.slice(entries, 1, i + 1), F.lit(0), lambda acc, x: acc + x["weight_hundredths"])
         .alias("run")))
    return (df.select("customer_id", F.inline(steps))
            .select("customer_id", F.col("step").cast("int").alias("step"), "factor",
                    (F.col("w") / F.lit(100.0)).alias("contribution"),
                    (F.col("run") / F.lit(100.0)).alias("running_total")))


def plan_dimension(spark) -> DataFrame:
    """J4's small side: the static plan per risk level (three rows)."""
    rows = [(lvl, plan, when, " | ".join(steps), outcome, invest,
             None if cost is None else (C.CUSTOMER_LTV - cost) / cost)
            for lvl, plan, when, steps, outcome, invest, cost in C.RISK_PLANS]
    return spark.createDataFrame(rows, "risk_level string, plan string, timeframe string, step_text string, "
                                       "expected_outcome string, investment string, roi_x double")


def scores_with_actions(df: DataFrame, high_risk_geography: str = C.RULE_HIGH_RISK_GEOGRAPHY,
                        probability: Column | None = None) -> DataFrame:
    """R1-R10 in one pass: score, level, factors, the level's plan and the
    targeted actions, all from the same probability (model or rule)."""
    s = rule_scores(df, high_risk_geography, probability)
    acts = R.actions(F.col("risk_level"), high_risk_geography)
    plans = F.broadcast(plan_dimension(df.sparkSession))      # three rows
    return (s.select("*", acts.alias("actions"))
            .join(plans, "risk_level", "left")
            .select("customer_id", "churn_probability", "rule_score", "risk_level", "confidence", "n_factors",
                    "expected_ltv_loss", F.array_join("risk_factors", " | ").alias("factor_text"),
                    "plan", "timeframe", "step_text", "expected_outcome", "investment", "roi_x",
                    F.size("actions").alias("n_actions"),
                    F.array_join("actions", " | ").alias("action_text")))


def retention_actions(df: DataFrame, high_risk_geography: str = C.RULE_HIGH_RISK_GEOGRAPHY,
                      probability: Column | None = None) -> DataFrame:
    """R8-R10 + J4: per customer, its level's plan and the targeted actions."""
    return scores_with_actions(df, high_risk_geography, probability).select(
        "customer_id", "risk_level", "plan", "timeframe", "step_text", "expected_outcome", "investment", "roi_x",
        "n_actions", "action_text")


def risk_portfolio(df: DataFrame, high_risk_geography: str = C.RULE_HIGH_RISK_GEOGRAPHY,
                   probability: Column | None = None) -> DataFrame:
    """Customers, mean probability and expected LTV loss per risk level."""
    s = rule_scores(df, high_risk_geography, probability)
    n = F.count(F.lit(1))
    return (s.groupBy("risk_level")
            .agg(n.alias("customers"),
                 rnd(F.avg("churn_probability")).alias("avg_probability"),
                 F.round(F.sum("expected_ltv_loss"), 2).alias("expected_ltv_loss"),
                 F.sum("exited").cast("long").alias("churned")))
