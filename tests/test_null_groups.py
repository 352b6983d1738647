"""A NULL group is kept by the ordered sums."""

from pyspark.sql import functions as F

from attrita.operators.explore import describe
from attrita.operators.split import stratified_split


def test_null_class_is_kept(spark):
    df = spark.range(300).select(
        F.col("id").alias("customer_id"), (F.col("id") % 17).cast("double").alias("v"),
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2).cast("int").alias("exited"))
    split = stratified_split(df)
    counts = {(r.exited, r.split): r.n for r in split.groupBy("exited", "split").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == 300 and counts[(None, "test")] == 20 and counts[(None, "train")] == 80
    rows = {r.exited: r for r in describe(df, ["v"], ["exited"]).collect()}
    assert set(rows) == {None, 0, 1} and rows[None]["count"] == 100


def test_row_without_key_trains_and_empty_input_splits(spark):
    df = spark.createDataFrame([(None, 1), (5, 1), (6, 1)], "customer_id long, exited int")
    got = {(r.customer_id, r.split) for r in stratified_split(df).collect()}
    assert len(got) == 3 and (None, "train") in got and sum(s == "test" for _, s in got) == 1
    assert stratified_split(df.where("exited = 9")).count() == 0
