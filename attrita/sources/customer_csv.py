"""The customer CSV of the original dashboard, read with a fixed schema.

The CSV's CamelCase columns are renamed to the package's canonical snake_case
names; identifiers that carry no signal (row number, surname) are dropped.

``ingest_customer_csv`` sets bad lines apart: one pass parses every line, gives
the bad ones a reason and writes one table partitioned by status, of which good
rows, quarantine and the counts of both are read back.  (Counting with an
``Observation`` in the pass itself would leave the session's fitted models
unserialisable in Spark 4.1; the counts come from the written files' footers.)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUSTOMER_CSV_SCHEMA = T.StructType([
    T.StructField("RowNumber", T.LongType()),
    T.StructField("CustomerId", T.LongType()),
    T.StructField("Surname", T.StringType()),
    T.StructField("CreditScore", T.IntegerType()),
    T.StructField("Geography", T.StringType()),
    T.StructField("Gender", T.StringType()),
    T.StructField("Age", T.IntegerType()),
    T.StructField("Tenure", T.IntegerType()),
    T.StructField("Balance", T.DoubleType()),
    T.StructField("NumOfProducts", T.IntegerType()),
    T.StructField("HasCrCard", T.IntegerType()),
    T.StructField("IsActiveMember", T.IntegerType()),
    T.StructField("EstimatedSalary", T.DoubleType()),
    T.StructField("Exited", T.IntegerType()),
    T.StructField("_corrupt_record", T.StringType()),
])

# CSV column -> canonical column.
CANONICAL_NAMES = {
    "CustomerId": "customer_id",
    "CreditScore": "credit_score",
    "Geography": "geography",
    "Gender": "gender",
    "Age": "age",
    "Tenure": "tenure",
    "Balance": "balance",
    "NumOfProducts": "num_products",
    "HasCrCard": "has_cr_card",
    "IsActiveMember": "is_active_member",
    "EstimatedSalary": "estimated_salary",
    "Exited": "exited",
}

PROFILE_COLUMNS = ["customer_id", "credit_score", "geography", "gender", "age", "tenure",
                   "balance", "num_products", "has_cr_card", "is_active_member",
                   "estimated_salary", "exited"]


def read_customer_csv(spark: SparkSession, path: str | None = None,
                      default_path: str | None = None, keep_corrupt: bool = False) -> DataFrame:
    """Read the given file, else the default one (S2); no schema inference.

    Malformed lines are kept as nulls with the raw text in ``_corrupt_record``
    (PERMISSIVE); pass ``keep_corrupt=True`` to see that column.
    """
    src = path or default_path
    if not src:
        raise ValueError("no customer file given and no default configured")
    raw = (spark.read.schema(CUSTOMER_CSV_SCHEMA)
           .option("header", True)
           .option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record")
           .csv(src))
    return to_canonical(raw, keep_corrupt=keep_corrupt)


def to_canonical(df: DataFrame, keep_corrupt: bool = False) -> DataFrame:
    """P1 + renaming: drop RowNumber/Surname, keep CustomerId as the key."""
    missing = [c for c in CANONICAL_NAMES if c not in df.columns]
    if missing:
        raise ValueError(f"customer table lacks columns {missing}")
    cols = [F.col(src).alias(dst) for src, dst in CANONICAL_NAMES.items()]
    if keep_corrupt and "_corrupt_record" in df.columns:
        cols.append(F.col("_corrupt_record"))
    return df.select(*cols)


# Fields are separated by commas outside quotes.
_FIELD = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
_FIELDS = [f for f in CUSTOMER_CSV_SCHEMA.fields if f.name != "_corrupt_record"]


def _line_reason(line: Column) -> Column:
    """Why a line could not be parsed: its number of fields, or the first value of a wrong type."""
    tokens = F.split(line, _FIELD, -1)
    bare = lambda i: F.trim(F.regexp_replace(F.get(tokens, F.lit(i)), '^"|"$', ""))
    wrong = [F.when((bare(i) != "") & bare(i).try_cast(f.dataType).isNull(), F.lit(f"type {f.name}"))
             for i, f in enumerate(_FIELDS)]
    return F.when(F.size(tokens) != len(_FIELDS), F.concat(F.lit("fields "), F.size(tokens))).otherwise(
        F.coalesce(*wrong, F.lit("unreadable")))


def _value_reason() -> Column:
    """Why a line that was parsed is no customer: no key, or a label that is neither 0 nor 1."""
    return (F.when(F.col("CustomerId").isNull(), F.lit("missing CustomerId"))
            .when(F.col("Exited").isNull(), F.lit("missing Exited"))
            .when(~F.col("Exited").isin(0, 1), F.lit("label")))


@dataclass
class Ingested:
    """Good rows (canonical columns), bad lines (line, reason), and how many of each went by."""
    customers: DataFrame
    quarantine: DataFrame
    counts: dict[str, int]


def ingest_customer_csv(spark: SparkSession, path: str, out: str, header: bool = True) -> Ingested:
    """S1 with a quarantine: parse ``path`` into the table ``out``, in one pass.

    No line is lost: each one is a customer or stands in the quarantine as it
    was (a parsed one as its fields, joined by commas) with its reason.
    ``header``: whether each file begins with the column names."""
    raw = (spark.read.schema(CUSTOMER_CSV_SCHEMA).option("header", header).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").option("enforceSchema", True).csv(path))
    corrupt = F.col("_corrupt_record")
    reason = F.when(corrupt.isNotNull(), _line_reason(corrupt)).otherwise(_value_reason())
    fields = F.array_join(F.array(*[F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in _FIELDS]), ",")
    judged = raw.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "customer").otherwise("quarantine"))
    bad = F.col("reason").isNotNull()
    rows = judged.select("status", "reason", F.when(bad, F.coalesce(corrupt, fields)).alias("line"),
                         *[F.when(~bad, F.col(a)).alias(b) for a, b in CANONICAL_NAMES.items()])
    rows.write.mode("overwrite").partitionBy("status").parquet(out)
    table = spark.read.schema(rows.schema).parquet(out)
    by = {r["status"]: r["count"] for r in table.groupBy("status").count().collect()}     # two rows
    counts = {"lines": sum(by.values()), "quarantined": by.get("quarantine", 0)}
    return Ingested(table.where("status = 'customer'").select(*CANONICAL_NAMES.values()),
                    table.where("status = 'quarantine'").select("line", "reason"), counts)


def customer_lines(profile: DataFrame) -> DataFrame:
    """The customers as CSV lines of the original layout (column ``value``), surnames quoted."""
    number = {v: k for k, v in CANONICAL_NAMES.items()}
    text = {number[c]: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in PROFILE_COLUMNS}
    text |= {"RowNumber": F.col("customer_id").cast("string"), "Surname": F.lit('"Doe, J"')}
    return profile.select("*", F.array_join(F.array(*[text[f.name] for f in _FIELDS]), ",").alias("value"))
