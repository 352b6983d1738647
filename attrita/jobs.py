"""Batch entry points: train (fit + save) and score (load + apply).

    python -m attrita.jobs train --tables /data/sf1 --out /models/churn
    python -m attrita.jobs train --csv /data/churn.csv --out /models/churn
    python -m attrita.jobs score --model /models/churn --tables /data/sf1 --out /scores
    python -m attrita.jobs segment --tables /data/sf1 --out /segments

Scoring never fits anything: it loads the saved pipeline and training median.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrita import config as C
from attrita.ml import clustering as cl
from attrita.ml import models as md
from attrita.operators import rules as ru
from attrita.operators import segments as sg
from attrita.operators.features import engineer_features
from attrita.session import get_spark, sized_conf
from attrita.sources.customer_csv import read_customer_csv
from attrita.sources.profile import build_customer_profile
from attrita.sources.sinks import materialize, path_exists, write_table


def load_customers(spark: SparkSession, tables: str | None, csv: str | None) -> DataFrame:
    if csv:
        return read_customer_csv(spark, csv)
    if tables:
        return build_customer_profile(spark, tables)
    raise ValueError("give --tables or --csv")


def train_job(spark: SparkSession, customers: DataFrame, out: str, kind: str = "gbt") -> dict:
    trained, feats = md.train_model(customers, kind)
    trained.save(out)
    metrics = md.evaluate(md.score(trained, feats.where(F.col("split") == "test")), kind)
    return {"fit_seconds": trained.fit_seconds, **metrics}


def score_job(spark: SparkSession, model_path: str, customers: DataFrame, out: str,
              high_risk_geography: str = C.RULE_HIGH_RISK_GEOGRAPHY) -> None:
    """Score every customer; without a saved model at ``model_path`` the rule
    score stands in, and ``score_source`` says which of the two it was."""
    if path_exists(spark, model_path + "/model"):
        trained = md.TrainedModel.load(spark, model_path)
        scored = md.score_profile(trained, customers).select(*customers.columns, "churn_probability")
        out_df = ru.scores_with_actions(scored, high_risk_geography, probability=F.col("churn_probability"))
        source = "model"
    else:
        out_df, source = ru.scores_with_actions(customers, high_risk_geography), "rule"
    write_table(out_df.withColumn("score_source", F.lit(source)), out, partition_by=["risk_level"])


def segment_job(spark: SparkSession, customers: DataFrame, out: str) -> None:
    feats = engineer_features(customers)
    seg = cl.segment_customers(feats)
    assigned = materialize(seg.assign(feats), "assigned")     # clusters are assigned once
    write_table(assigned.select("customer_id", "cluster"), out + "/assignments")
    write_table(sg.segment_profile(assigned, "cluster"), out + "/profiles")
    write_table(sg.segment_strategy(assigned, "cluster"), out + "/strategies")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="attrita.jobs")
    p.add_argument("job", choices=["train", "score", "segment"])
    p.add_argument("--tables")
    p.add_argument("--csv")
    p.add_argument("--model")
    p.add_argument("--out", required=True)
    p.add_argument("--kind", default="gbt", choices=["gbt", "lr", "rf", "svm"])
    p.add_argument("--high-risk-geography", default=C.RULE_HIGH_RISK_GEOGRAPHY)
    p.add_argument("--input-gb", type=float, help="with --cores: settings sized for this input")
    p.add_argument("--cores", type=int)
    a = p.parse_args(argv)
    sized = sized_conf(int(a.input_gb * 1024 ** 3), a.cores) if a.input_gb and a.cores else None
    spark = get_spark(extra=sized)
    customers = load_customers(spark, a.tables, a.csv)
    if a.job == "train":
        print(train_job(spark, customers, a.out, a.kind))
    elif a.job == "score":
        if not a.model:
            p.error("score needs --model (the folder train wrote)")
        score_job(spark, a.model, customers, a.out, a.high_risk_geography)
    else:
        segment_job(spark, customers, a.out)


if __name__ == "__main__":
    main()
