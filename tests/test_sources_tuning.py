"""CSV source (S1/S2), sinks (S3), grid search (M10), leaderboard."""

import pytest
from pyspark.sql import functions as F

from attrita.ml import models as md
from attrita.sources.customer_csv import read_customer_csv
from attrita.sources.sinks import materialize, write_table
from test_ml_stream import _planted

CSV = """RowNumber,CustomerId,Surname,CreditScore,Geography,Gender,Age,Tenure,Balance,NumOfProducts,HasCrCard,IsActiveMember,EstimatedSalary,Exited
1,15634602,Hargrave,619,France,Female,42,2,0,1,1,1,101348.88,1
2,15647311,Hill,608,Spain,Female,41,1,83807.86,1,0,1,112542.58,0
3,15619304,Onio,not-a-number,France,Female,42,8,159660.8,3,1,0,113931.57,1
"""


def test_csv_reader_schema_and_bad_rows(spark, tmp_path):
    p = tmp_path / "churn.csv"
    p.write_text(CSV)
    df = read_customer_csv(spark, None, default_path=str(p), keep_corrupt=True)
    assert df.columns[:12] == ["customer_id", "credit_score", "geography", "gender", "age", "tenure", "balance",
                               "num_products", "has_cr_card", "is_active_member", "estimated_salary", "exited"]
    rows = {r.customer_id: r for r in df.collect()}
    assert rows[15634602].balance == 0.0 and rows[15634602].exited == 1
    assert rows[15619304].credit_score is None and rows[15619304]._corrupt_record is not None
    with pytest.raises(ValueError):
        read_customer_csv(spark, None, None)


def test_sinks_roundtrip(spark, tmp_path):
    df = spark.range(10).withColumn("part", F.col("id") % 2)
    write_table(df, str(tmp_path / "t"), partition_by=["part"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10
    m = materialize(df, "x")
    assert sorted(r.id for r in m.collect()) == list(range(10))


def test_grid_search_and_leaderboard(spark):
    prof = _planted(spark, n=400)
    cv_model, table = md.tune_gbt(prof, max_depth=(2, 3), step_size=(0.1,), max_iter=(3,), folds=2, parallelism=2)
    rows = table.collect()
    assert len(rows) == 2 and all(0.0 <= r.mean_auc <= 1.0 for r in rows)
    board = md.leaderboard(prof, kinds=["lr", "gbt"], params={"gbt": dict(maxIter=5)}).collect()
    assert [r.model for r in board].count("vote") == 1 and len(board) == 3
    assert board[0].roc_auc == max(r.roc_auc for r in board)


def test_sized_conf_scales_with_input():
    from attrita.session import sized_conf
    small = sized_conf(10 * 1024 ** 2, 8)
    big = sized_conf(100 * 1024 ** 4, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
    assert int(big["spark.sql.shuffle.partitions"]) >= 100 * 1024 ** 4 // (200 * 1024 ** 2)
