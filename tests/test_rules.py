from pyspark.sql import functions as F

from attrita.operators.rules import factor_weights, retention_actions, rule_scores, waterfall
from conftest import CANON_SCHEMA, customer_row

# Three worked profiles (card holder taken as Yes): expected score by hand.
HIGH = customer_row(1, 598, "Germany", "Female", 52, 3, 0.0, 3, 1, 0, 100000.0, 1)
MEDIUM = customer_row(2, 720, "Spain", "Male", 32, 4, 85000.0, 1, 1, 1, 100000.0, 0)
LOW = customer_row(3, 785, "France", "Male", 28, 6, 120000.0, 2, 1, 1, 100000.0, 0)


def test_worked_profiles(spark):
    df = spark.createDataFrame([HIGH, MEDIUM, LOW], CANON_SCHEMA)
    got = {r.customer_id: r for r in rule_scores(df, "Germany").collect()}
    assert got[1].rule_score == 1.15 and got[1].churn_probability == 0.95
    assert got[1].risk_level == "HIGH"
    # Gender adds weight but no text: 6 texts for 7 factors.
    assert got[1].n_factors == 6 and got[1].confidence == 95
    assert got[1].expected_ltv_loss == 75000 * 0.95
    assert got[2].rule_score == 0.15 and got[2].risk_level == "LOW" and got[2].confidence == 75
    assert got[3].rule_score == 0.0 and got[3].n_factors == 0 and got[3].confidence == 70
    assert "Age > 45 (52 years)" in got[1].risk_factors[0]


def test_weights_and_waterfall(spark):
    df = spark.createDataFrame([HIGH], CANON_SCHEMA)
    w = {r.factor: r.weight for r in factor_weights(df, "Germany").collect()}
    assert w == {"Age": 0.25, "IsActiveMember": 0.3, "NumOfProducts": 0.2, "Geography": 0.15,
                 "Balance": 0.15, "Gender": 0.05, "CreditScore": 0.05}
    steps = waterfall(df, "Germany").orderBy("step").collect()
    assert [s.step for s in steps] == list(range(1, 8))
    assert abs(steps[-1].running_total - 1.15) < 1e-12
    assert [s.contribution for s in steps] == sorted(s.contribution for s in steps)


def test_actions_follow_level(spark):
    df = spark.createDataFrame([HIGH, MEDIUM, LOW], CANON_SCHEMA)
    got = {r.customer_id: r for r in retention_actions(df, "Germany").collect()}
    assert got[1].n_actions == 5 and "Simplification" in got[1].action_text
    assert got[1].plan == "URGENT ACTION REQUIRED - High Risk Customer" and got[1].roi_x == (75000 - 800) / 800
    assert got[3].n_actions == 0 and got[3].risk_level == "LOW"


def test_model_probability_overrides_rule(spark):
    df = spark.createDataFrame([LOW], CANON_SCHEMA)
    r = rule_scores(df, "Germany", probability=F.lit(0.4)).first()
    assert r.risk_level == "MEDIUM" and r.rule_score == 0.0
    acts = retention_actions(df, "Germany", probability=F.lit(0.4)).first()
    assert acts.n_actions == 0      # 2 products, active, tenure 6: no medium action applies
