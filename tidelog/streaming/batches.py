"""Tables that micro-batches write: one folder a batch, which the batch replaces when it is run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.log_table import read_or_empty


def write_batch(rows: DataFrame, root: str, batch_id: int, *folders: str) -> None:
    rows.write.mode("overwrite").partitionBy(*folders).parquet(f"{root}/batch={batch_id}")


def read_batches(spark: SparkSession, root: str, schema: str, before: int | None = None) -> DataFrame:
    """All rows; ``before`` leaves out batches from this one on."""
    rows = read_or_empty(spark, root, f"{schema}, batch BIGINT")
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def run_to_end(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
