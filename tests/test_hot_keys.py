"""A third of all rows on one key or one value: results stay exact."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from attrita.operators.evaluation import roc_auc
from attrita.operators.quantile import exact_quantiles
from attrita.operators.split import stratified_split
from attrita.sources.profile import order_history


def test_hot_value_quantiles_and_auc(spark):
    rng = np.random.default_rng(5)
    n = 3000
    x = rng.normal(100, 20, n).round(2)
    x[: n // 3] = 0.0                                   # a third of the rows share one value
    y = (rng.random(n) < 0.3).astype("int32")
    pdf = pd.DataFrame({"customer_id": np.arange(n, dtype="int64"), "x": x, "exited": y})
    df = spark.createDataFrame(pdf)
    got = {r.prob: r.value for r in exact_quantiles(df, ["x"], [0.1, 0.33, 0.34, 0.5, 0.9]).collect()}
    for p, v in got.items():
        assert abs(v - pdf.x.quantile(p)) < 1e-9
    auc = roc_auc(df, "exited", "x").first()["roc_auc"]
    pos, neg = x[y == 1], x[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert abs(auc - round(wins / (len(pos) * len(neg)), 6)) < 1e-9


def test_hot_customer_order_history(spark):
    import datetime as dt
    rows = [(1, dt.datetime(1999, 1, 1) + dt.timedelta(days=i % 500), 10.0 + i, "1-URGENT" if i % 7 == 0 else "5-LOW")
            for i in range(3000)]                       # customer 1 holds a third of the orders
    rows += [(k, dt.datetime(2000, 1, 1), 5.0, "5-LOW") for k in range(2, 6002)]
    orders = spark.createDataFrame(rows, "o_custkey long, o_orderdate timestamp_ntz, o_totalprice double, "
                                         "o_orderpriority string").repartition(8)
    h = {r.customer_id: r for r in order_history(orders, dt.datetime(2000, 8, 1), dt.datetime(2000, 2, 1))
         .where(F.col("customer_id").isin(1, 2)).collect()}
    assert h[1].n_before == 3000 and h[1].n_after == 0 and h[1].urgent_before == 1
    assert h[1].max_price_before == 10.0 + 2999 and h[2].n_before == 1


def test_split_with_hot_class(spark):
    n = 3000
    pdf = pd.DataFrame({"customer_id": np.arange(n, dtype="int64"),
                        "exited": (np.arange(n) % 10 == 0).astype("int32")})
    s = stratified_split(spark.createDataFrame(pdf)).toPandas()
    for cls, grp in s.groupby("exited"):
        assert (grp.split == "test").sum() == -(-len(grp) * 20 // 100)
