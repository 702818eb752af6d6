"""First arrival wins: one row per seq_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cleaning import first_per_key

BUCKET = 1 << 14


def with_bucket(rows: DataFrame) -> DataFrame:
    return rows.withColumn("seq_bucket", F.floor(F.col("seq_id") / F.lit(BUCKET)).cast("bigint"))


def first_arrivals(rows: DataFrame, order: str = "arrival_no") -> DataFrame:
    return first_per_key(rows, ["seq_id"], order)


def new_rows(arrivals: DataFrame, known: DataFrame) -> DataFrame:
    """Arrivals (first ones) whose id is not among the ``known``: those of the id ranges they touch."""
    return arrivals.join(known.select("seq_id"), "seq_id", "left_anti")
