"""T3 with its late rows kept: weekly activity from event files that arrive in any order.

A windowed stream drops rows behind its watermark without a trace.  Here each
micro-batch is split before it is aggregated.  The watermark a batch meets is
the newest event time of all batches before it, less the allowed lateness; a
row whose week had ended by then is late.  A batch writes three things, each
under its own batch number and overwriting what an attempt before it left:

* ``weeks``: partial sums per user and week of the rows in time,
* ``late``: the late rows themselves, with the watermark that they missed,
* ``marks``: its newest event time, its rows and how many of them were late.

So the answer is exact and each row counted once whatever fails and restarts;
state is one small file a batch, and the weekly totals are sums of partial sums.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrita.functions.stats import rnd
from attrita.session import scratch_path
from attrita.sources.sinks import path_exists
from attrita.streaming.activity import EVENT_COLUMNS, MICROS_PER_DAY, utc_instant, utc_wall_time

#: Lateness allowed before a closed week takes no more rows.
ALLOWED_DAYS = 1.0
WEEK_MICROS = 7 * MICROS_PER_DAY
MARKS = "newest long, rows long, late long, batch_id long"


def _micros(events: DataFrame) -> Column:
    ts = F.col("ts")
    return F.unix_micros(utc_instant(ts) if events.schema["ts"].dataType.typeName() == "timestamp_ntz" else ts)


def newest_before(spark: SparkSession, out: str, batch_id: int) -> int | None:
    """The newest event time, in microseconds, of the batches before ``batch_id``."""
    if not path_exists(spark, out + "/marks"):
        return None
    marks = spark.read.schema(MARKS).parquet(out + "/marks").where(F.col("batch_id") < batch_id)
    return marks.agg(F.max("newest")).first()[0]


def write_batch(out: str, allowed_days: float = ALLOWED_DAYS) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` does with a batch of events.  Rows without user or time count for nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = newest_before(spark, out, batch_id)
        mark = None if newest is None else newest - round(allowed_days * MICROS_PER_DAY)
        rows = batch.where("user_id is not null and ts is not null").withColumn("_t", _micros(batch)).persist()
        try:
            week = F.floor(F.col("_t") / F.lit(WEEK_MICROS)) * F.lit(WEEK_MICROS)
            behind = F.lit(False) if mark is None else week + F.lit(WEEK_MICROS) <= F.lit(mark)
            rows = rows.withColumn("_week", week).withColumn("_late", behind)
            partial = rows.where(~F.col("_late")).groupBy("user_id", "_week").agg(
                F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("purchases"),
                F.sum("value").alias("value"))
            for name, part in (("weeks", partial),
                               ("late", rows.where("_late").select(*batch.columns, F.lit(mark).cast("long").alias("watermark")))):
                part.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
            (rows.agg(F.max("_t").alias("newest"), F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("_late"), 1)).alias("late"))
             .write.mode("overwrite").parquet(f"{out}/marks/batch_id={batch_id}"))
        finally:
            rows.unpersist()

    return write


def start_weekly_activity(events: DataFrame, out: str, checkpoint: str, allowed_days: float = ALLOWED_DAYS):
    """The stream: ``events`` (any streaming source) into the folder ``out``, to the end of what is there."""
    return (events.writeStream.foreachBatch(write_batch(out, allowed_days)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def weekly_totals(spark: SparkSession, out: str) -> DataFrame:
    """user_id, week_start, events, purchases, total_value of the rows in time."""
    return (spark.read.parquet(out + "/weeks").groupBy("user_id", "_week")
            .agg(F.sum("events").alias("events"), F.sum("purchases").alias("purchases"), rnd(F.sum("value")).alias("total_value"))
            .select("user_id", utc_wall_time(F.timestamp_micros("_week")).alias("week_start"), "events", "purchases", "total_value"))


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """The late rows, the watermark that each missed, and the batch that brought it."""
    rows = spark.read.parquet(out + "/late")
    return rows.withColumn("watermark", utc_wall_time(F.timestamp_micros("watermark")))


def land_in_order(events: DataFrame, slot: Column, folder: str) -> int:
    """Write ``events`` as one folder of files a slot, one after the other, as an arriving source would; the number of slots."""
    placed = events.withColumn("_slot", slot)
    slots = [r[0] for r in placed.select("_slot").distinct().orderBy("_slot").collect()]
    for s in slots:
        placed.where(F.col("_slot") == s).drop("_slot").coalesce(1).write.parquet(f"{folder}/slot={s:06d}")
    return len(slots)


def replay_with_late_files(events: DataFrame, slot: Column, allowed_days: float = ALLOWED_DAYS) -> str:
    """Let ``events`` arrive slot by slot, a file a batch, and run the stream to the end; the folder of its results."""
    spark = events.sparkSession
    run = uuid.uuid4().hex[:12]
    source, out, checkpoint = (scratch_path(spark, f"late-{run}/{p}") for p in ("source", "out", "checkpoint"))
    rows = events.select(*EVENT_COLUMNS)
    land_in_order(rows, slot, source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    start_weekly_activity(stream, out, checkpoint, allowed_days).awaitTermination()
    return out
