"""The training-data pipeline over ``documents``: five operators in a row.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept; its result is written and read again as the next one's ``docs``:

1. quality: documents that the classifier rejects go;
2. near_duplicates: of the documents that links of the n-gram Jaccard join tie
   together (five words a shingle, a similarity of 0.8) one stays, that with the
   smallest doc_id;
3. decontamination: documents that hold a benchmark item go;
4. secrets: each secret that is not a widely copied example is replaced by
   ``[SECRET]`` (n_chars follows);
5. tokens: BPE ids of every text, with the digests of ids and decoded text.

Edge cases: stage 2 tells rows apart by doc_id and text, so rows that repeat a
doc_id with different texts are compared like any others, and so are rows
without doc_id (they come last in the order); rows alike in both are one, that
whose other columns have the least hash.  Null and empty texts pass stages 2 to
4 unchanged, white space alone too.  Extra columns are
carried through stages 1 to 4, whatever their names.  Stage 1 scores null and
empty texts like any others; without labels it keeps all rows.  An empty table
stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrita.llm import bpe_stream, decontaminate, ngram_jaccard, quality_mil, secret_scan
from attrita.llm.common import free_name, written

#: Words a shingle and least similarity (per cent) of the near-duplicate stage.
WIDTH = 5
PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_mil.keep_good(docs, quality_mil.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    worded = F.col("text").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    key, least = free_name("_row", docs.columns), free_name("_least", docs.columns)
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    named = docs.where(worded).withColumn(key, row)
    groups = ngram_jaccard.ngram_jaccard_join(named.select(F.col(key).alias("_row"), "text"), "_row", width=WIDTH, percent=PERCENT)
    stay = groups.where(F.col("_row") == F.col("component_id")).select(F.col("_row").alias(key)).distinct()
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("none")]
    rows = named.groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.sha2(F.to_json(F.struct(*others)), 256)).alias(least))
    return rows.join(stay, key, "left_semi").select(f"{least}.*").unionByName(docs.where(~worded))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, chars_col="n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_stream.encode_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("tokens", tokens)]

#: A trained classifier, edit matching and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: doc_id, ids, n_tokens, ids_sha256, decoded_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
