"""Customer scoring as a Structured Streaming query.

Customer rows arrive as files; each micro-batch gets the engineered features
(with the *training* median), the saved model's probability, the risk level,
confidence, LTV loss and the rule factors, and is appended to a parquet sink.
The query is stateless, so it scales with the input rate alone; the model is
loaded, never fitted, inside the stream.  Checkpoints live under the session's
shared checkpoint folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrita import config as C
from attrita.ml.models import TrainedModel, score
from attrita.operators import rules as ru
from attrita.operators.features import engineer_features
from attrita.session import scratch_path

OUTPUT_COLUMNS = ["customer_id", "churn_probability", "risk_level", "confidence", "n_factors",
                  "expected_ltv_loss", "rule_score", "factor_text"]


def score_stream(stream: DataFrame, trained: TrainedModel | None,
                 high_risk_geography: str = C.RULE_HIGH_RISK_GEOGRAPHY) -> DataFrame:
    """The scoring transformation; works on a batch or a streaming frame alike.
    Without a model the rule score gives the probability."""
    if trained is None:
        out = ru.rule_scores(stream, high_risk_geography)
    else:
        feats = engineer_features(stream, trained.median_balance)
        scored = score(trained, feats).select(*feats.columns, "churn_probability")
        out = ru.rule_scores(scored, high_risk_geography, probability=F.col("churn_probability"))
    return out.select(*OUTPUT_COLUMNS[:-1], F.array_join("risk_factors", " | ").alias("factor_text"))


def start_scoring(spark: SparkSession, source_dir: str, schema, trained: TrainedModel | None, sink_dir: str,
                  checkpoint: str, high_risk_geography: str = C.RULE_HIGH_RISK_GEOGRAPHY,
                  available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the stream from parquet files in ``source_dir`` into ``sink_dir``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    writer = (score_stream(stream, trained, high_risk_geography).writeStream
              .format("parquet").outputMode("append").option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(sink_dir)


def replay_profile_scoring(spark: SparkSession, profile: DataFrame, trained: TrainedModel | None,
                           high_risk_geography: str = C.RULE_HIGH_RISK_GEOGRAPHY) -> DataFrame:
    """Land ``profile`` as files, score them with the stream, read the sink back."""
    run = uuid.uuid4().hex[:12]
    src, sink, ckpt = (scratch_path(spark, f"stream-{run}/{p}") for p in ("source", "sink", "checkpoint"))
    profile.write.mode("overwrite").parquet(src)
    q = start_scoring(spark, src, profile.schema, trained, sink, ckpt, high_risk_geography)
    q.awaitTermination()
    return spark.read.parquet(sink)
