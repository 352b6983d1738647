"""A fitted model does not depend on the number of cores."""

import os
import subprocess
import sys

from attrita.ml.models import MAX_ROWS_PER_TRAINING_PARTITION, training_partitions

SCRIPT = """
import sys
from attrita.session import get_spark
spark = get_spark(sys.argv[1], shuffle_partitions=int(sys.argv[2]), extra={"spark.ui.enabled": "false"})
spark.sparkContext.setLogLevel("ERROR")
from attrita.ml import models as md
from test_ml_stream import _planted
from pyspark.sql import functions as F
# 4,000 rows: several training partitions, and rows are sampled by partition.
trained, feats = md.train_model(_planted(spark, n=4000), "gbt", maxIter=3)
s = md.score(trained, feats).agg(F.sum("churn_probability"), F.max("churn_probability")).first()
print("SCORES", round(s[0], 6), round(s[1], 9))
"""


def _scores(master: str, partitions: int) -> str:
    here = os.path.dirname(os.path.abspath(__file__))
    env = dict(os.environ, PYTHONPATH=os.pathsep.join([os.path.dirname(here), here]))
    out = subprocess.run([sys.executable, "-c", SCRIPT, master, str(partitions)], env=env, text=True,
                         stdout=subprocess.PIPE, timeout=600, check=True).stdout
    return next(line for line in out.splitlines() if "SCORES" in line).split("SCORES")[1]


def test_same_model_on_two_and_on_eight_cores():
    assert _scores("local[2]", 2) == _scores("local[8]", 8)


def test_partitions_follow_the_rows():
    assert [training_partitions(n, 1_500) for n in (0, 1, 1_500, 12_000)] == [1, 1, 1, 8]
    for n in (10 ** 6, 10 ** 9, 10 ** 11):
        parts = training_partitions(n, 1_500)
        assert 1_500 <= -(-n // parts) <= MAX_ROWS_PER_TRAINING_PARTITION + 1
