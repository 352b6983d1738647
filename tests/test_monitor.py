"""Activity monitoring streams agree with their batch forms."""

import datetime as dt

import pandas as pd

from attrita.streaming.activity import inactivity_silences, load_events, weekly_activity
from attrita.streaming.monitor import inactivity_alert_stream, replay_inactivity_alerts, replay_weekly_activity
from conftest import SF001


def test_weekly_stream_equals_batch(spark):
    batch = weekly_activity(load_events(spark, SF001)).toPandas()
    stream = replay_weekly_activity(spark, SF001).toPandas()
    key = ["user_id", "week_start"]
    b = batch.sort_values(key).reset_index(drop=True)
    s = stream[b.columns].sort_values(key).reset_index(drop=True)
    s["week_start"] = pd.to_datetime(s["week_start"]).astype("datetime64[us]")
    b["week_start"] = pd.to_datetime(b["week_start"]).astype("datetime64[us]")
    pd.testing.assert_frame_equal(b, s, check_dtype=False)


def test_inactivity_alerts_fire_for_silent_users(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=h), 1, "click", 1.0) for i, h in enumerate(range(0, 24))]  # user 1: day 1
    rows += [(100 + i, t0 + dt.timedelta(days=d), 2, "view", 1.0) for i, d in enumerate(range(0, 10))]  # user 2: daily
    rows += [(200 + i, t0 + dt.timedelta(days=9, hours=i), 3, "view", 1.0) for i in range(3)]          # user 3: late
    src = str(tmp_path / "events")
    (spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
     .repartition(3).write.parquet(src))
    stream = (spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double")
              .parquet(src))
    q = (inactivity_alert_stream(stream, threshold_days=3.0)
         .writeStream.format("memory").queryName("alerts_test").outputMode("append")
         .trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ckpt")).start())
    q.awaitTermination()
    got = {r.user_id: r for r in spark.sql("SELECT * FROM alerts_test").collect()}
    # Watermark = last event (day 9 02:00) - 1 day: only user 1 (silent since day 1) has timed out.
    assert set(got) == {1}
    assert got[1].events == 24 and got[1].last_event == t0 + dt.timedelta(hours=23)


def test_silences_inside_a_batch_and_across_files(spark, tmp_path):
    """One file, or many in time order: the stream gives the batch's rows; a gap of exactly the threshold is none."""
    t0 = dt.datetime(2024, 1, 1)
    day = dt.timedelta(days=1)
    times = [(1, t0), (1, t0 + day), (1, t0 + 2 * day + dt.timedelta(microseconds=1)), (1, t0 + 7 * day),
             (2, t0 + dt.timedelta(hours=3)), (2, t0 + 9 * day), (None, t0)]
    rows = [(i, ts, u, "view", 1.0) for i, (u, ts) in enumerate(sorted(times, key=lambda x: x[1]))]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    folders = [str(tmp_path / n) for n in ("one", "many")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folders[0]}/events.parquet")
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{folders[1]}/events.parquet")
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    batch = key(inactivity_silences(load_events(spark, folders[0]), 1.0))
    want = [(1, t0 + day, 2), (1, t0 + 2 * day + dt.timedelta(microseconds=1), 1), (2, t0 + dt.timedelta(hours=3), 1)]
    assert sorted(r[:3] for r in batch) == sorted(want + [(1, t0 + 7 * day, 1)])
    assert key(replay_inactivity_alerts(spark, folders[0], 1.0)) == batch
    assert key(replay_inactivity_alerts(spark, folders[1], 1.0, max_files=1)) == batch
    assert key(inactivity_silences(load_events(spark, folders[0]).where("user_id = 99"), 1.0)) == []
