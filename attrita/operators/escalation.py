"""Escalation triggers of the monitoring plan, each with its action, from the events table.

* no activity for so many days: days since the last event as of the newest one;
* balance drop: a week's value under so much of the week before (a week without
  events between two others, or up to the newest event, has the value 0);
* closed-account attempt and negative feedback: events of given types and least
  values.

Each trigger is one grouped aggregate over the events, weeks are combined before
the shuffle, and the drop looks one week ahead within a user's weeks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrita import config as C
from attrita.streaming.activity import MICROS_PER_DAY, utc_instant, utc_wall_time

WEEK = 7 * MICROS_PER_DAY


def _micros(events: DataFrame):
    ts = F.col("ts")
    return F.unix_micros(utc_instant(ts) if events.schema["ts"].dataType.typeName() == "timestamp_ntz" else ts)


def balance_drops(timed: DataFrame, newest: int, share: float) -> DataFrame:
    """user_id, at (start of the poorer week, microseconds): each week whose value is under ``share`` of the week before."""
    weeks = timed.groupBy("user_id", (F.floor(F.col("t") / WEEK) * WEEK).alias("week")).agg(F.sum("value").alias("total"))
    ahead = Window.partitionBy("user_id").orderBy("week")
    after = F.when(F.lead("week").over(ahead) == F.col("week") + WEEK, F.lead("total").over(ahead)).otherwise(F.lit(0.0))
    return (weeks.withColumn("after", after)
            .where((F.col("total") > 0) & (F.col("week") + WEEK <= F.lit(newest)) & (F.col("after") < F.col("total") * F.lit(share)))
            .select("user_id", (F.col("week") + WEEK).alias("at")))


def escalations(events: DataFrame, inactive_days: float = C.ESCALATION_INACTIVE_DAYS, drop_to: float = C.ESCALATION_DROP_TO,
                signs: Sequence[tuple[str, str, float, float]] = C.ESCALATION_SIGNS) -> DataFrame:
    """user_id, trigger, action, occurrences, last_at: a row for each user and trigger that fired.

    ``signs``: (trigger, event type, least value, value that is too much for it).  Rows without user or time count for
    nothing, a null value is 0."""
    timed = events.where("user_id is not null and ts is not null").select(
        "user_id", "event_type", F.coalesce("value", F.lit(0.0)).alias("value"), _micros(events).alias("t"))
    newest = timed.agg(F.max("t")).first()[0]
    newest = 0 if newest is None else newest
    quiet = (timed.groupBy("user_id").agg(F.max("t").alias("at"))
             .where(F.lit(newest) - F.col("at") >= F.lit(round(inactive_days * MICROS_PER_DAY)))
             .select("user_id", F.lit("No activity").alias("trigger"), "at"))
    drops = balance_drops(timed, newest, drop_to).select("user_id", F.lit("Balance drop").alias("trigger"), "at")
    sign = F.coalesce(*[F.when((F.col("event_type") == kind) & (F.col("value") >= low) & (F.col("value") < high), F.lit(name))
                        for name, kind, low, high in signs], F.lit(None).cast("string"))
    marked = timed.select("user_id", sign.alias("trigger"), F.col("t").alias("at")).where("trigger is not null")
    action = F.create_map(*[F.lit(x) for pair in C.ESCALATION_ACTIONS.items() for x in pair])
    return (quiet.unionByName(drops).unionByName(marked).groupBy("user_id", "trigger")
            .agg(F.count(F.lit(1)).alias("occurrences"), F.max("at").alias("at"))
            .select("user_id", "trigger", F.element_at(action, F.col("trigger")).alias("action"), "occurrences",
                    utc_wall_time(F.timestamp_micros("at")).alias("last_at")))
