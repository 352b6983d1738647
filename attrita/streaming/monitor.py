"""T2/T3 as streams over event files.

T3: weekly activity per user with a watermark; emitted in update mode
through ``foreachBatch`` into a parquet folder tagged with the batch id, so
the latest version of each (user, week) is the answer and state is dropped
once the watermark passes a week's end.

T2: inactivity alerts from session windows: a session of a user ends where the
next event is further away than the threshold; once the watermark passes that end,
the alert is emitted, once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrita.functions.stats import rnd
from attrita.session import scratch_path
from attrita.sources.tables import table_path
from attrita.streaming.activity import EVENT_COLUMNS, MICROS_PER_DAY, WEEK, utc_instant, utc_wall_time

WATERMARK = "1 day"


def weekly_activity_stream(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    return (events.withWatermark("ts", watermark)
            .groupBy("user_id", F.window("ts", WEEK).alias("w"))
            .agg(F.count(F.lit(1)).alias("events"),
                 F.count(F.when(F.col("event_type") == "purchase", 1)).alias("purchases"),
                 rnd(F.sum("value")).alias("total_value"))
            .select("user_id", F.col("w.start").alias("week_start"), "events", "purchases", "total_value"))


def _is_file(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a single file, on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def _events_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Event files as a stream: ``path`` is a folder, or one file within a folder."""
    schema = spark.read.parquet(path).select(*EVENT_COLUMNS).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    folder, _, name = path.rstrip("/").rpartition("/")
    if _is_file(spark, path):       # a stream source is a folder
        r, path = r.option("pathGlobFilter", name), folder
    events = r.parquet(path).select(*EVENT_COLUMNS)
    # Watermarks need TIMESTAMP (not TIMESTAMP_NTZ).
    ntz = schema["ts"].dataType.typeName() == "timestamp_ntz"
    return events.withColumn("ts", utc_instant(F.col("ts"))) if ntz else events


def latest_versions(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row per key across update-mode batches (a keyed shuffle)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return updates.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "batch_id")


def replay_inactivity_alerts(spark: SparkSession, sf_dir: str, threshold_days: float,
                             max_files: int | None = None) -> DataFrame:
    """Run T2 over the event files to the end (availableNow) and read the alerts."""
    run = uuid.uuid4().hex[:12]
    sink, ckpt = (scratch_path(spark, f"inactive-{run}/{p}") for p in ("sink", "checkpoint"))
    q = (inactivity_alert_stream(_events_stream(spark, table_path(sf_dir, "events"), max_files), threshold_days)
         .writeStream.format("parquet").outputMode("append").option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start(sink))
    q.awaitTermination()
    alerts = spark.read.schema(ALERT_SCHEMA).parquet(sink)
    return alerts.select("user_id", utc_wall_time(F.col("last_event")).alias("last_event"), "events",
                         utc_wall_time(F.col("alert_at")).alias("alert_at"))


def replay_weekly_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = uuid.uuid4().hex[:12]
    sink, ckpt = (scratch_path(spark, f"weekly-{run}/{p}") for p in ("sink", "checkpoint"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(sink)

    q = (weekly_activity_stream(_events_stream(spark, table_path(sf_dir, "events")))
         .writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return (latest_versions(spark.read.parquet(sink), ["user_id", "week_start"])
            .withColumn("week_start", utc_wall_time(F.col("week_start"))))


ALERT_SCHEMA = "user_id long, last_event timestamp, events long, alert_at timestamp"


def inactivity_alert_stream(events: DataFrame, threshold_days: float, watermark: str = WATERMARK) -> DataFrame:
    """One alert row per silence longer than ``threshold_days``, once the
    watermark has passed the threshold: the last event before it, the events
    since the silence before, and the time the threshold was reached.

    A session window per user closes where the next event is further away than
    the threshold, so a silence inside one micro-batch is seen as well as one
    across files.  Sessions are merged within each partition before the
    shuffle, so a user with a large share of all events sends few rows."""
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    gap = f"{round(threshold_days * MICROS_PER_DAY)} microseconds"
    return (events.where("user_id is not null").select("user_id", "ts").withWatermark("ts", watermark)
            .groupBy("user_id", F.session_window("ts", gap).alias("w"))
            .agg(F.max("ts").alias("last_event"), F.count(F.lit(1)).alias("events"))
            .select("user_id", "last_event", "events", F.col("w.end").alias("alert_at")))
