"""Dataset files: one JSON record per line, one folder per hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variants as V
from ..operators.numbering import number_rows
from ..schema import DATASET_SCHEMA
from .log_table import by_hour


def as_lines(records: DataFrame, *more: str) -> DataFrame:
    """hour_key, seq_id, the columns ``more`` and the record as a JSON line. Keys absent from a request
    stay absent; the fixed response and metadata keys are always written."""
    whole = F.to_json(
        F.struct(
            F.parse_json(F.to_json("request")).alias("request"),
            F.parse_json(F.to_json("response", {"ignoreNullFields": "false"})).alias("response"),
            F.parse_json(F.to_json("metadata", {"ignoreNullFields": "false"})).alias("metadata"),
        )
    )
    return records.select("hour_key", "seq_id", *more, whole.alias("value"))


def write_dataset(records: DataFrame, path: str) -> None:
    """Replaces the hours found in ``records``, sorted by seq_id within an hour."""
    lines = by_hour(as_lines(records)).select("value", "hour_key")
    lines.write.mode("overwrite").partitionBy("hour_key").option("partitionOverwriteMode", "dynamic").option(
        "compression", "gzip"
    ).text(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Records of all hours; lines that are no JSON are skipped."""
    return (
        spark.read.schema(f"{DATASET_SCHEMA}, hour_key STRING")
        .option("mode", "DROPMALFORMED")
        .json(path)
    )


def dataset_summary(records: DataFrame, first: int = 0) -> DataFrame:
    """One line per record; ``rec_no`` counts them within their hour, by seq_id."""
    usage = F.col("response.usage")

    def tokens(name: str):
        return F.try_variant_get(usage[name], "$", "bigint")

    rows = records.select(
        "hour_key", F.col("metadata.seq_id").alias("seq_id"),
        F.coalesce(V.text_of(F.col("request.model"), ""), F.lit("?")).alias("model"),
        F.coalesce(F.size(V.items(F.col("request.messages"))), F.lit(0)).cast("bigint").alias("turns"),
        F.coalesce(F.length("response.text"), F.lit(0)).cast("bigint").alias("text_len"),
        F.coalesce(F.length("response.thinking"), F.lit(0)).cast("bigint").alias("thinking_len"),
        F.col("response.is_streaming").alias("is_streaming"),
        F.col("response.stop_reason").alias("stop_reason"),
        tokens("input_tokens").alias("input_tokens"), tokens("output_tokens").alias("output_tokens"),
        F.col("metadata.duration_ms").alias("duration_ms"),
    )
    return number_rows(rows, "seq_id", "rec_no", within=["hour_key"], start=first)


def record_at(records: DataFrame, hour_key: str, index: int) -> DataFrame:
    """The n-th record (from 0) of an hour."""
    return (
        records.where(F.col("hour_key") == hour_key).orderBy("metadata.seq_id").offset(index).limit(1)
    )
