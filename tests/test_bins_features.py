from pyspark.sql import functions as F

from attrita import config as C
from attrita.functions.bins import equal_width_bin, right_closed_bin
from attrita.operators.features import align_columns, engineer_features, yes_no_flag
from conftest import CANON_SCHEMA, customer_row


def _codes(spark, values, edges):
    df = spark.createDataFrame([(v,) for v in values], "x int")
    return [r[0] for r in df.select(right_closed_bin("x", edges)).collect()]


def test_age_bins_are_right_closed(spark):
    assert _codes(spark, [30, 31, 40, 50, 60, 100, 101, 0], C.AGE_EDGES) == [1, 2, 2, 3, 4, 5, None, None]


def test_credit_and_tenure_bins(spark):
    assert _codes(spark, [600, 601, 650, 700, 850, 851], C.CREDIT_EDGES) == [1, 2, 2, 3, 4, None]
    assert _codes(spark, [0, 2, 5, 7, 10, 11], C.TENURE_EDGES) == [1, 1, 2, 3, 4, None]


def test_null_goes_to_null_code(spark):
    df = spark.createDataFrame([(None,)], "x int")
    assert df.select(right_closed_bin("x", C.AGE_EDGES)).first()[0] is None


def test_equal_width_interval_and_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0.5, 3.25, 6.5]], "x double")
    inter = [r[0] for r in df.select(equal_width_bin("x", 0.0, 6.5, 7)).collect()]
    hist = [r[0] for r in df.select(equal_width_bin("x", 0.0, 6.5, 7, right_closed=False)).collect()]
    assert inter == [1, 1, 4, 7]          # min in the first bin, max in the last
    assert hist == [0, 0, 3, 6]


def test_features_at_edges(spark):
    rows = [
        customer_row(1, balance=0.0, is_active_member=0, age=46, num_products=3),
        customer_row(2, balance=100.0),                 # equal to the median: not high value
        customer_row(3, balance=200000.0),
        customer_row(4, balance=200001.0, tenure=0, age=30),
    ]
    df = spark.createDataFrame(rows, CANON_SCHEMA)
    out = {r.customer_id: r for r in engineer_features(df, median_balance=100.0).collect()}
    assert out[1].has_zero_balance == 1 and out[1].is_high_value == 0
    assert out[1].complain_risk_score == 2 + 1.5 + 2 + 1
    assert out[2].is_high_value == 0 and out[3].is_high_value == 1
    assert out[3].active_high_balance == 1
    assert out[4].tenure_category == 1 and out[4].age_group == 1
    assert out[4].products_per_year == 2.0 and out[4].tenure_by_age == 0.0
    assert abs(out[3].balance_to_salary_ratio - 200000.0 / 100001.0) < 1e-12


def test_feature_median_defaults_to_exact_median(spark):
    rows = [customer_row(i, balance=b) for i, b in enumerate([0.0, 10.0, 20.0, 30.0])]
    df = spark.createDataFrame(rows, CANON_SCHEMA)
    out = sorted((r.balance, r.is_high_value) for r in engineer_features(df).collect())
    assert out == [(0.0, 0), (10.0, 0), (20.0, 1), (30.0, 1)]     # median 15


def test_yes_no_and_align(spark):
    df = spark.createDataFrame([("Yes",), ("No",)], "has string")
    assert [r[0] for r in df.select(yes_no_flag("has")).collect()] == [1, 0]
    out = align_columns(df.select(F.lit(1).alias("a")), ["a", "b"])
    assert out.columns == ["a", "b"] and out.first()["b"] == 0
