"""S3 + sinks: write results as parquet, and cut long lineages.

A written table in the shared checkpoint folder (``spark.checkpoint.dir``)
survives lost executors: downstream jobs read files instead of recomputing a
long lineage.  Nothing here uses machine-local storage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from attrita.session import scratch_path


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Write features, scores or segments as parquet (optionally partitioned)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def materialize(df: DataFrame, name: str | None = None) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    The result's lineage starts at those files, so it is reused by several
    jobs without recomputation and survives executor loss."""
    path = scratch_path(df.sparkSession, f"tables/{name or 't'}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
