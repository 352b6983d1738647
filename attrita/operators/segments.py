"""Segment profile, ranking, naming, strategy and impact.

Works for any segment column: the K-means cluster id from ``attrita.ml``, or a
business attribute.  The heavy step is one grouped aggregate over the customer
table (partial aggregation before the shuffle); everything after it runs on
one row per segment.  Up to ``MAX_SEGMENTS`` of them are ranked in one window
over a local table of that bound; more are ranked by range-partitioned running
sums, so any column may be the segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrita import config as C
from attrita.functions.stats import pct, rnd
from attrita.operators.broadcast import bounded_local
from attrita.operators.prefix import ordered_cumulative

SEGMENT = "segment"
MAX_SEGMENTS = 10_000


def segment_stats(df: DataFrame, segment_col: str = SEGMENT) -> DataFrame:
    """A21/A22 + W1/W2: one row per segment with its statistics and risk rank.

    rank 0 = highest churn rate; ties go to the smaller segment id.
    """
    n = F.count(F.lit(1))
    per = (df.groupBy(F.col(segment_col).alias(SEGMENT))
           .agg(n.alias("size"),
                pct(F.sum("exited"), F.count("exited")).alias("churn_rate"),
                F.coalesce(F.sum("exited"), F.lit(0)).cast("long").alias("churn_count"),
                F.avg("age").alias("avg_age"),
                F.avg("balance").alias("avg_balance"),
                F.avg("estimated_salary").alias("avg_salary"),
                F.avg("credit_score").alias("avg_credit"),
                F.avg("num_products").alias("avg_products"),
                pct(F.sum("is_active_member"), n).alias("active_pct"),
                pct(F.sum("has_cr_card"), n).alias("has_card_pct"),
                F.avg("tenure").alias("avg_tenure"),
                F.mode("gender", True).alias("gender"),
                F.mode("geography", True).alias("geography")))
    local = bounded_local(per, MAX_SEGMENTS)
    if local is not per:
        everyone = Window.partitionBy()                       # over at most MAX_SEGMENTS rows
        by_risk = Window.orderBy(F.desc("churn_rate"), F.asc(SEGMENT))
        return local.select("*", pct(F.col("size"), F.sum("size").over(everyone)).alias("size_pct"),
                            (F.row_number().over(by_risk) - 1).alias("rank"))
    order = F.coalesce(-F.col("churn_rate"), F.lit(float("inf")))       # segments without a rate come last
    ranked = ordered_cumulative(per.withColumn("_order", order).withColumn("_one", F.lit(1)), [], "_order", ["_one", "size"],
                                tiebreak_cols=[SEGMENT])
    return ranked.select(*per.columns, pct(F.col("size"), F.col("total_size")).alias("size_pct"),
                         (F.col("cum__one") - 1).cast("int").alias("rank"))


def _risk_label(rank: F.Column) -> F.Column:
    r = F.least(rank, F.lit(len(C.RISK_LABELS) - 1))
    return F.element_at(F.array(*[F.lit(x) for x in C.RISK_LABELS]), r + 1)


def _description() -> F.Column:
    """Descriptive name from activity, balance and tenure."""
    a, b, t = F.col("active_pct"), F.col("avg_balance"), F.col("avg_tenure")
    return (F.when(a < C.NAME_INACTIVE_BELOW,
                   F.when(b > C.NAME_HIGH_BALANCE_ABOVE, F.lit("Inactive High-Value")).otherwise(F.lit("Disengaged")))
             .when(a > C.NAME_ACTIVE_ABOVE,
                   F.when(b > C.NAME_HIGH_BALANCE_ABOVE, F.lit("Fully Active Premium"))
                    .otherwise(F.lit("Highly Engaged")))
             .when(b < C.NAME_LOW_BALANCE_BELOW,
                   F.when(t < C.NAME_SHORT_TENURE_BELOW, F.lit("New Short-Tenure")).otherwise(F.lit("Low-Balance")))
             .otherwise(F.lit("Moderately Engaged")))


def segment_profile(df: DataFrame, segment_col: str = SEGMENT) -> DataFrame:
    """A21 + G5 + G6: rounded statistics, rank, risk label and name per segment."""
    s = segment_stats(df, segment_col)
    risk = _risk_label(F.col("rank"))
    return s.select(
        SEGMENT, "rank", risk.alias("risk_level"),
        F.concat(risk, F.lit(" — "), _description(), F.lit(" Customers")).alias("name"),
        "size", rnd("size_pct").alias("size_pct"), rnd("churn_rate").alias("churn_rate_pct"), "churn_count",
        rnd("avg_age").alias("avg_age"), rnd("avg_balance").alias("avg_balance"),
        rnd("avg_salary").alias("avg_salary"), rnd("avg_credit").alias("avg_credit"),
        rnd("avg_products").alias("avg_products"), rnd("active_pct").alias("active_pct"),
        rnd("has_card_pct").alias("has_card_pct"), rnd("avg_tenure").alias("avg_tenure"),
        "gender", "geography")


def segment_sizes(df: DataFrame, segment_col: str = SEGMENT) -> DataFrame:
    """Churn rate, churned and total per segment id."""
    n = F.count(F.lit(1))
    return (df.groupBy(F.col(segment_col).alias(SEGMENT))
            .agg(rnd(pct(F.sum("exited"), n)).alias("churn_rate_pct"),
                 F.sum("exited").cast("long").alias("churned"),
                 n.alias("customers")))


def summary_table(df: DataFrame, segment_col: str = SEGMENT) -> DataFrame:
    """The summary table with the page's rounding (2, 2 places)."""
    s = segment_stats(df, segment_col)
    return s.select(SEGMENT, "size", F.round("size_pct", 2).alias("size_pct"),
                    F.round("churn_rate", 2).alias("churn_rate_pct"), "churn_count",
                    _risk_label(F.col("rank")).alias("risk_level"))


def profile_table(df: DataFrame, segment_col: str = SEGMENT) -> DataFrame:
    """The profile table with the page's rounding (2, 1, 0, 2, 1, 1 places)."""
    s = segment_stats(df, segment_col)
    return s.select(SEGMENT, _risk_label(F.col("rank")).alias("risk_level"), "size",
                    F.round("churn_rate", 2).alias("churn_pct"), "churn_count",
                    F.round("avg_age", 1).alias("avg_age"), F.round("avg_balance", 0).alias("avg_balance"),
                    F.round("avg_products", 2).alias("avg_products"), F.round("active_pct", 1).alias("active_pct"),
                    F.round("avg_tenure", 1).alias("avg_tenure"))


def strategy_dimension(spark) -> DataFrame:
    """J1's small side: the four strategy templates (a parameter table)."""
    rows = [(r, title, prio, budget, improve, roi, save_pct, text, acts)
            for (r, title, prio, budget, improve, roi, _), save_pct, text, acts
            in zip(C.STRATEGIES, C.STRATEGY_SAVE_PCT, C.STRATEGY_DESCRIPTIONS, C.STRATEGY_ACTIONS, strict=True)]
    return spark.createDataFrame(rows, "strategy_rank int, title string, priority string, budget_pct int, "
                                       "retention_improvement_pct int, roi string, save_pct int, "
                                       "description string, actions array<string>")


def _ranked_with_strategy(df: DataFrame, segment_col: str) -> DataFrame:
    s = segment_stats(df, segment_col)
    strat = strategy_dimension(df.sparkSession)
    # Ranks past the last template reuse it (more segments than templates).
    key = F.least(F.col("rank"), F.lit(len(C.STRATEGIES) - 1)).cast("int")
    return s.withColumn("strategy_rank", key).join(F.broadcast(strat), "strategy_rank")


def segment_strategy(df: DataFrame, segment_col: str = SEGMENT) -> DataFrame:
    """G7 + J1: each segment with the strategy of its risk rank and its actions."""
    j = _ranked_with_strategy(df, segment_col)
    return j.select(SEGMENT, "rank", _risk_label(F.col("rank")).alias("risk_level"), "title", "priority",
                    "description", F.size("actions").alias("n_actions"),
                    F.array_join("actions", " | ").alias("action_text"),
                    "budget_pct", "retention_improvement_pct", "roi",
                    (F.col("save_pct") / F.lit(100.0)).alias("save_rate"),
                    rnd("churn_rate").alias("churn_rate_pct"), "churn_count")


def _saved_value_tenths(churn_count: F.Column, save_pct: F.Column) -> F.Column:
    """round(churned * rate * 75000 / 1e6, 1) in tenths of $M, half-up, exact."""
    ltv_per_tenth = C.CUSTOMER_LTV * 10      # value in tenths of $M = n * rate * LTV * 10 / 1e6
    return F.floor((churn_count * save_pct * F.lit(ltv_per_tenth) + F.lit(50_000_000)) / F.lit(100_000_000))


def segment_impact(df: DataFrame, segment_col: str = SEGMENT) -> DataFrame:
    """G8 + O3: impact of a campaign on the highest-risk segment (rank 0).

    Integer arithmetic: saved = floor(churned * rate), value in tenths of $M,
    net = value - investment rounded to tenths, ROI = floor(value / investment).
    """
    j = _ranked_with_strategy(df, segment_col).where(F.col("rank") == 0)
    saved = F.floor(F.col("churn_count") * F.col("save_pct") / F.lit(100)).cast("long")
    value_tenths = F.floor((saved * F.lit(C.CUSTOMER_LTV * 10) + F.lit(500_000)) / F.lit(1_000_000)).cast("long")
    invest_hundredths = int(round(C.CAMPAIGN_INVESTMENT_M * 100))
    # round(value - invest, 1) in tenths: value*10 - invest*100/10, half-up.
    net_tenths = F.floor((value_tenths * F.lit(10) - F.lit(invest_hundredths) + F.lit(5)) / F.lit(10))
    return j.select(
        SEGMENT, F.col("churn_count").alias("churned"), saved.alias("saved"),
        (F.col("churn_count") - saved).alias("reduced_churn"),
        F.col("save_pct").alias("retain_pct"),
        (value_tenths / F.lit(10.0)).alias("value_saved_m"),
        F.lit(C.CAMPAIGN_INVESTMENT_M).alias("investment_m"),
        (net_tenths / F.lit(10.0)).alias("net_gain_m"),
        F.floor(value_tenths * F.lit(10) / F.lit(invest_hundredths)).cast("long").alias("roi_x"))


def segment_budget(df: DataFrame, segment_col: str = SEGMENT) -> DataFrame:
    """Budget share, expected improvement, saved value and customers per segment."""
    j = _ranked_with_strategy(df, segment_col)
    return j.select(
        SEGMENT, "rank", "budget_pct", "retention_improvement_pct",
        (_saved_value_tenths(F.col("churn_count"), F.col("save_pct")) / F.lit(10.0)).alias("saved_value_m"),
        F.floor(F.col("churn_count") * F.col("save_pct") / F.lit(100)).cast("long").alias("customers_saved"))


def budget_totals(df: DataFrame, segment_col: str = SEGMENT) -> DataFrame:
    """A25 + G9: totals over the budget table and the overall ROI."""
    b = segment_budget(df, segment_col)
    tenths = F.sum(F.round(F.col("saved_value_m") * 10).cast("long"))
    invest_tenths = int(round(C.TOTAL_INVESTMENT_M * 10))
    return b.agg((tenths / F.lit(10.0)).alias("total_saved_value_m"),
                 F.sum("customers_saved").cast("long").alias("total_customers_saved"),
                 F.lit(C.TOTAL_INVESTMENT_M).alias("total_investment_m"),
                 F.floor(tenths / F.lit(invest_tenths)).cast("long").alias("overall_roi_x"))
