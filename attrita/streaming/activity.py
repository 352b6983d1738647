"""Activity monitoring over the ``events`` table, batch and stream.

Both are keyed aggregates (user, or user x week) with partial aggregation, so
a user producing a third of all events still shuffles one row per map task.
The stream forms keep state only per key and window, bounded by a watermark.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrita.functions.stats import rnd
from attrita.sources.tables import load_table

EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value"]
MICROS_PER_DAY = 86_400_000_000
WEEK = "7 days"


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "events", EVENT_COLUMNS)


def inactivity_alerts(events: DataFrame, threshold_days: float,
                      as_of: dt.datetime | None = None) -> DataFrame:
    """T2 (batch): per user, days since the last event as of ``as_of``
    (default: the newest event) and whether it reaches ``threshold_days``.

    The reference time is a literal of the column's own type, and the gap is
    a timestamp difference, so no session time zone enters the result."""
    ts_type = events.schema["ts"].dataType
    if as_of is None:
        as_of = events.agg(F.max("ts").alias("m")).first()["m"]
    ref = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(ts_type)
    last = events.groupBy("user_id").agg(F.max("ts").alias("last_event"),
                                         F.count(F.lit(1)).alias("events"))
    days = F.timestamp_diff("MICROSECOND", F.col("last_event"), ref) / F.lit(float(MICROS_PER_DAY))
    return last.select("user_id", "last_event", "events", rnd(days).alias("days_inactive"),
                       (days >= F.lit(float(threshold_days))).cast("int").alias("alert"))


def weekly_activity(events: DataFrame) -> DataFrame:
    """T3 (batch): events, purchases and value per user and 7-day window
    (windows aligned to the Unix epoch, as Spark's ``window`` does)."""
    return (events.groupBy("user_id", F.window("ts", WEEK).alias("w"))
            .agg(F.count(F.lit(1)).alias("events"),
                 F.count(F.when(F.col("event_type") == "purchase", 1)).alias("purchases"),
                 rnd(F.sum("value")).alias("total_value"))
            .select("user_id", F.col("w.start").alias("week_start"), "events", "purchases", "total_value"))


def utc_instant(ts: Column) -> Column:
    """A zone-less time as the instant it names in UTC, whatever the session zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts))


def utc_wall_time(instant: Column) -> Column:
    """The inverse of ``utc_instant``."""
    seconds = F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000)
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def inactivity_silences(events: DataFrame, threshold_days: float, watermark_days: float = 1.0) -> DataFrame:
    """T2 (batch twin of the stream): per user every silence longer than
    ``threshold_days`` that reached it by the newest event minus
    ``watermark_days``: last event before it, events since the silence before,
    and the time the threshold was reached.  Rows without user or time count
    for nothing.

    Events of a user within one time slot shorter than the threshold belong
    together, so each slot is first reduced to its ends and count (combined
    before the shuffle): a hot user's window then has one row per slot."""
    gap = round(threshold_days * MICROS_PER_DAY)
    instant = utc_instant(F.col("ts")) if events.schema["ts"].dataType.typeName() == "timestamp_ntz" else F.col("ts")
    timed = events.where("user_id is not null and ts is not null").select("user_id", F.unix_micros(instant).alias("t"))
    slots = timed.groupBy("user_id", F.floor(F.col("t") / F.lit(max(1, gap // 2))).alias("slot")).agg(
        F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n"))
    by_user = Window.partitionBy("user_id").orderBy("slot")
    new = F.coalesce((F.col("lo") - F.lag("hi").over(by_user) > F.lit(gap)).cast("int"), F.lit(1))
    run = by_user.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sessions = (slots.withColumn("_new", new).withColumn("_session", F.sum("_new").over(run))
                .groupBy("user_id", "_session").agg(F.max("hi").alias("hi"), F.sum("n").alias("events")))
    # The watermark works in milliseconds.
    newest = timed.agg(F.floor(F.max("t") / F.lit(1000)).alias("ms")).first()["ms"]
    over = F.lit(0 if newest is None else newest * 1000 - round(watermark_days * MICROS_PER_DAY))
    at = lambda micros: utc_wall_time(F.timestamp_micros(micros))
    return (sessions.where(F.col("hi") + F.lit(gap) <= over)
            .select("user_id", at(F.col("hi")).alias("last_event"), "events",
                    at(F.col("hi") + F.lit(gap)).alias("alert_at")))
