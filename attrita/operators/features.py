"""The engineered feature table, one projection.

``engineer_features`` is used by batch training, batch scoring and the stream:
the balance median is a parameter, so scoring reuses the training median
instead of recomputing it on whatever rows are being scored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrita import config as C
from attrita.functions.bins import right_closed_bin
from attrita.operators.quantile import exact_median

ENGINEERED_COLUMNS = ["balance_to_salary_ratio", "tenure_by_age", "products_per_year",
                      "is_high_value", "has_zero_balance", "age_group", "credit_score_category",
                      "tenure_category", "active_high_balance", "complain_risk_score"]

# Levels of a categorical column that are turned into columns.
MAX_LEVELS = 1_000


def complain_risk_score() -> F.Column:
    """2[age>45] + 1.5[products>=3] + 2[inactive] + 1[zero balance]."""
    age = F.col("age") > C.COMPLAIN_AGE_OVER
    prod = F.col("num_products") >= C.COMPLAIN_PRODUCTS_AT_LEAST
    inactive = F.col("is_active_member") == 0
    zero = F.col("balance") == 0
    return (age.cast("double") * C.COMPLAIN_WEIGHT_AGE
            + prod.cast("double") * C.COMPLAIN_WEIGHT_PRODUCTS
            + inactive.cast("double") * C.COMPLAIN_WEIGHT_INACTIVE
            + zero.cast("double") * C.COMPLAIN_WEIGHT_ZERO_BALANCE)


MEDIAN_COLUMNS = {"is_high_value", "active_high_balance"}


def feature_columns(median_balance: float | None) -> list[tuple[str, F.Column]]:
    """(name, expression) of the engineered columns, in order; without a
    median the two median-based ones are left out."""
    bal, sal, ten, age = F.col("balance"), F.col("estimated_salary"), F.col("tenure"), F.col("age")
    high_value = None if median_balance is None else (bal > F.lit(float(median_balance))).cast("int")
    cols = [
        ("balance_to_salary_ratio", F.try_divide(bal, sal + 1)),
        ("tenure_by_age", F.try_divide(ten.cast("double"), (age + 1).cast("double"))),
        ("products_per_year", F.try_divide(F.col("num_products").cast("double"), (ten + 1).cast("double"))),
        ("is_high_value", high_value),
        ("has_zero_balance", (bal == 0).cast("int")),
        ("age_group", right_closed_bin(age, C.AGE_EDGES)),
        ("credit_score_category", right_closed_bin(F.col("credit_score"), C.CREDIT_EDGES)),
        ("tenure_category", right_closed_bin(ten, C.TENURE_EDGES)),
        ("active_high_balance", None if high_value is None
         else ((F.col("is_active_member") == 1) & (high_value == 1)).cast("int")),
        ("complain_risk_score", complain_risk_score()),
    ]
    return [(n, c) for n, c in cols if c is not None]


def engineer_features(df: DataFrame, median_balance: float | None = None,
                      columns: list[str] | None = None) -> DataFrame:
    """Add the engineered columns (all, or just ``columns``) to a canonical
    customer table.

    Without ``median_balance`` the exact median of ``balance`` over ``df`` is
    computed first (a distributed job, see ``exact_median``) - unless the
    requested columns do not depend on it.
    """
    wanted = set(columns) if columns is not None else set(ENGINEERED_COLUMNS)
    if median_balance is None and wanted & MEDIAN_COLUMNS:
        median_balance = exact_median(df, "balance")
    return df.select("*", *[c.alias(n) for n, c in feature_columns(median_balance) if n in wanted])


def yes_no_flag(col: str) -> F.Column:
    """P12: "Yes" -> 1, anything else -> 0."""
    return F.when(F.col(col) == "Yes", F.lit(1)).otherwise(F.lit(0))


def align_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Select ``columns`` in order; a column the frame lacks becomes 0."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(0).alias(c) for c in columns])


def category_levels(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """The sorted levels of each categorical column, in one aggregate.  Each
    level becomes a column, so past ``MAX_LEVELS`` it is no categorical input."""
    row = df.agg(*[F.collect_set(c).alias(c) for c in cols]).first()
    wide = [c for c in cols if len(row[c]) > MAX_LEVELS]
    if wide:
        raise ValueError(f"more than {MAX_LEVELS} levels in {', '.join(wide)}")
    return {c: sorted(row[c]) for c in cols}


def one_hot_drop_first(df: DataFrame, col: str, levels: list[str]) -> DataFrame:
    """P14 in SQL form: one 0/1 column per level but the alphabetically first.

    ``levels`` are the training levels (a parameter, so scoring one row cannot
    lose its dummies); the model pipeline uses StringIndexer + OneHotEncoder
    with the same drop-first rule.
    """
    kept = sorted(levels)[1:]
    return df.select("*", *[(F.col(col) == lvl).cast("int").alias(dummy_name(col, lvl)) for lvl in kept])


def dummy_name(col: str, level: str) -> str:
    """Column name of a dummy: non-identifier characters become underscores."""
    return f"{col}_" + re.sub(r"\W+", "_", level)
