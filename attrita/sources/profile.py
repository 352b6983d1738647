"""Customer profile table built from the star-schema tables.

Same shape as the dashboard's customer table.  Features come from orders
before a cutoff date, the churn label from orders on or after it, so the label
never leaks into the features.  Stand-in columns (age, gender, credit score)
are deterministic functions of the key (see FIXTURES.md).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrita import config as C
from attrita.operators.broadcast import bounded_local
from attrita.sources.tables import load_table

def wall_clock(t: dt.datetime) -> F.Column:
    """A TIMESTAMP_NTZ literal: compared with the NTZ order dates it needs no
    time zone, so results do not depend on the session's zone."""
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


# Region dimension: nation joined to region.  TPC-H fixes it at 25 rows; the
# check allows some headroom before falling back to a shuffle join.
GEO_MAX_ROWS = 10_000


def order_history(orders: DataFrame, cutoff: dt.datetime, active_since: dt.datetime,
                  urgent: str = C.PROFILE_URGENT_PRIORITY) -> DataFrame:
    """One row per customer with its order history split at ``cutoff``.

    A single hash aggregate: partial aggregation runs before the shuffle, so a
    customer holding a large share of all orders still reaches the reducer as
    one partial row per map task.
    """
    before = F.col("o_orderdate") < wall_clock(cutoff)
    return (orders
            .groupBy(F.col("o_custkey").alias("customer_id"))
            .agg(F.count(F.when(before, 1)).alias("n_before"),
                 F.min(F.when(before, F.col("o_orderdate"))).alias("first_before"),
                 F.max(F.when(before, F.col("o_orderdate"))).alias("last_before"),
                 F.max(F.when(before, F.col("o_totalprice"))).alias("max_price_before"),
                 F.max(F.when(before & (F.col("o_orderpriority") == urgent), 1).otherwise(0))
                  .alias("urgent_before"),
                 F.count(F.when(~before, 1)).alias("n_after")))


def build_customer_profile(spark: SparkSession, sf_dir: str,
                           cutoff: dt.datetime = C.PROFILE_CUTOFF,
                           active_since: dt.datetime = C.PROFILE_ACTIVE_SINCE,
                           tenure_year: int = C.PROFILE_TENURE_YEAR,
                           balance_scale: float = C.PROFILE_BALANCE_SCALE) -> DataFrame:
    """Canonical customer table (+ ``segment``) from customer/nation/region/orders."""
    orders = load_table(spark, sf_dir, "orders",
                        ["o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"])
    customer = load_table(spark, sf_dir, "customer",
                          ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    nation = load_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    region = load_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])

    # One small job joins and checks the dimension; up to the bound it is a local table from then on.
    geo = bounded_local(nation.join(region, nation.n_regionkey == region.r_regionkey)
                        .select("n_nationkey", "r_name"), GEO_MAX_ROWS)

    hist = order_history(orders, cutoff, active_since).where(F.col("n_before") > 0)
    key = F.col("customer_id")
    return (customer
            .join(hist, customer.c_custkey == hist.customer_id)
            .join(geo, customer.c_nationkey == geo.n_nationkey)
            .select(
                key,
                F.col("c_mktsegment").alias("segment"),
                (300 + (key * 37) % 551).cast("int").alias("credit_score"),
                F.col("r_name").alias("geography"),
                F.when(key % 2 == 0, F.lit("Female")).otherwise(F.lit("Male")).alias("gender"),
                (18 + (key * 7) % 75).cast("int").alias("age"),
                (F.lit(tenure_year) - F.year("first_before")).cast("int").alias("tenure"),
                (F.greatest(F.col("c_acctbal"), F.lit(0.0)) * F.lit(balance_scale)).alias("balance"),
                (1 + F.col("n_before") % 4).cast("int").alias("num_products"),
                F.col("urgent_before").cast("int").alias("has_cr_card"),
                (F.col("last_before") >= wall_clock(active_since)).cast("int").alias("is_active_member"),
                F.col("max_price_before").alias("estimated_salary"),
                (F.col("n_after") == 0).cast("int").alias("exited"),
            ))
