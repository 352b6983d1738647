"""Rule-score expressions for the transparent churn rule set.

Every term is a CASE expression on the canonical columns, so scoring stays
inside whole-stage codegen; weights are integers (hundredths) summed exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attrita import config as C


def _c(name: str) -> Column:
    return F.col(name)


def factor_weights(high_risk_geography: str = C.RULE_HIGH_RISK_GEOGRAPHY) -> list[tuple[str, Column]]:
    """(factor name, weight-in-hundredths-or-null) for the nine factors, in rule order."""
    return [
        ("Age", F.when(_c("age") > C.RULE_AGE_OVER, F.lit(C.RULE_WEIGHT_AGE))),
        ("IsActiveMember", F.when(_c("is_active_member") == 0, F.lit(C.RULE_WEIGHT_INACTIVE))),
        ("NumOfProducts", F.when(_c("num_products") == 1, F.lit(C.RULE_WEIGHT_ONE_PRODUCT))
                           .when(_c("num_products") >= 3, F.lit(C.RULE_WEIGHT_MANY_PRODUCTS))),
        ("Geography", F.when(_c("geography") == high_risk_geography, F.lit(C.RULE_WEIGHT_GEOGRAPHY))),
        ("Balance", F.when(_c("balance") == 0, F.lit(C.RULE_WEIGHT_ZERO_BALANCE))
                     .when(_c("balance") > C.RULE_VERY_HIGH_BALANCE, F.lit(C.RULE_WEIGHT_VERY_HIGH_BALANCE))),
        ("Tenure", F.when(_c("tenure") < C.RULE_TENURE_UNDER, F.lit(C.RULE_WEIGHT_TENURE))),
        ("Gender", F.when(_c("gender") == "Female", F.lit(C.RULE_WEIGHT_FEMALE))),
        ("HasCrCard", F.when(_c("has_cr_card") == 0, F.lit(C.RULE_WEIGHT_NO_CARD))),
        ("CreditScore", F.when(_c("credit_score") < C.RULE_CREDIT_UNDER, F.lit(C.RULE_WEIGHT_CREDIT))),
    ]


def score_hundredths(high_risk_geography: str = C.RULE_HIGH_RISK_GEOGRAPHY) -> Column:
    """R1 as an exact integer: sum of the weights that apply."""
    terms = [F.coalesce(w, F.lit(0)) for _, w in factor_weights(high_risk_geography)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total.cast("int")


def _fill(template: str, value: Column) -> Column:
    head, tail = template.split("{}")
    return F.concat(F.lit(head), value.cast("string"), F.lit(tail))


def factor_texts(high_risk_geography: str = C.RULE_HIGH_RISK_GEOGRAPHY) -> Column:
    """R2: ordered risk-factor texts (Gender adds weight but no text)."""
    geo_text = C.TEXT_GEOGRAPHY.replace("Germany", high_risk_geography, 1)
    items = [
        F.when(_c("age") > C.RULE_AGE_OVER, _fill(C.TEXT_AGE, _c("age"))),
        F.when(_c("is_active_member") == 0, F.lit(C.TEXT_INACTIVE)),
        F.when(_c("num_products") == 1, _fill(C.TEXT_ONE_PRODUCT, _c("num_products")))
         .when(_c("num_products") >= 3, _fill(C.TEXT_MANY_PRODUCTS, _c("num_products"))),
        F.when(_c("geography") == high_risk_geography, F.lit(geo_text)),
        F.when(_c("balance") == 0, F.lit(C.TEXT_ZERO_BALANCE))
         .when(_c("balance") > C.RULE_VERY_HIGH_BALANCE, F.lit(C.TEXT_VERY_HIGH_BALANCE)),
        F.when(_c("tenure") < C.RULE_TENURE_UNDER, F.lit(C.TEXT_TENURE)),
        F.when(_c("has_cr_card") == 0, F.lit(C.TEXT_NO_CARD)),
        F.when(_c("credit_score") < C.RULE_CREDIT_UNDER, _fill(C.TEXT_CREDIT, _c("credit_score"))),
    ]
    return F.array_compact(F.array(*items))


def weight_entries(high_risk_geography: str = C.RULE_HIGH_RISK_GEOGRAPHY) -> Column:
    """array<struct<factor, weight_hundredths>> of the factors that apply."""
    structs = [F.struct(F.lit(name).alias("factor"), w.alias("weight_hundredths"))
               for name, w in factor_weights(high_risk_geography)]
    return F.filter(F.array(*structs), lambda s: s["weight_hundredths"].isNotNull())


def weight_map(high_risk_geography: str = C.RULE_HIGH_RISK_GEOGRAPHY) -> Column:
    """R3 as a map factor -> weight (double)."""
    entries = F.transform(weight_entries(high_risk_geography),
                          lambda s: F.struct(s["factor"], (s["weight_hundredths"] / F.lit(100.0))))
    return F.map_from_entries(entries)


def capped_probability(score_h: Column) -> Column:
    """min(score, 0.95) from the integer score."""
    return (F.least(score_h, F.lit(C.RULE_PROBABILITY_CAP)) / F.lit(100.0))


def risk_level(prob: Column) -> Column:
    """Strict thresholds on the churn probability."""
    return (F.when(prob > C.RULE_HIGH_ABOVE, F.lit("HIGH"))
             .when(prob > C.RULE_MEDIUM_ABOVE, F.lit("MEDIUM"))
             .otherwise(F.lit("LOW")))


def confidence(n_factors: Column) -> Column:
    """Heuristic confidence in percent."""
    return F.least(F.lit(C.CONFIDENCE_CAP),
                   F.lit(C.CONFIDENCE_BASE) + F.lit(C.CONFIDENCE_PER_FACTOR) * n_factors).cast("int")


def expected_ltv_loss(prob: Column) -> Column:
    """R7."""
    return F.lit(float(C.CUSTOMER_LTV)) * prob


def actions(level: Column, high_risk_geography: str = C.RULE_HIGH_RISK_GEOGRAPHY) -> Column:
    """Targeted actions for HIGH and MEDIUM risk; none for LOW."""
    regional = C.ACTION_REGIONAL.replace("Germany", high_risk_geography, 1)
    high = F.array_compact(F.array(
        F.when(_c("age") > C.RULE_AGE_OVER, F.lit(C.ACTION_AGE)),
        F.when(_c("is_active_member") == 0, F.lit(C.ACTION_REACTIVATE)),
        F.when(_c("num_products") >= 3, F.lit(C.ACTION_SIMPLIFY))
         .when(_c("num_products") == 1, F.lit(C.ACTION_CROSS_SELL)),
        F.when(_c("geography") == high_risk_geography, F.lit(regional)),
        F.when((_c("balance") == 0) | (_c("balance") > C.RULE_VERY_HIGH_BALANCE), F.lit(C.ACTION_FINANCIAL)),
    ))
    medium = F.array_compact(F.array(
        F.when(_c("num_products") == 1, F.lit(C.ACTION_MEDIUM_ONE_PRODUCT)),
        F.when(_c("is_active_member") == 0, F.lit(C.ACTION_MEDIUM_INACTIVE)),
        F.when(_c("tenure") < C.MEDIUM_TENURE_UNDER, F.lit(C.ACTION_MEDIUM_NEW)),
    ))
    return (F.when(level == "HIGH", high)
             .when(level == "MEDIUM", medium)
             .otherwise(F.array().cast("array<string>")))
