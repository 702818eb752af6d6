"""Counts per hour, model and status, kept up to date by a stream.

The state is one row a group, not a request, so nothing has to be dropped to bound it and late rows
still count. A batch gives the new values of the groups it changed. They replace the old ones in the
folders of their days, so the table holds each group once, however long the stream runs, and a batch
that is run again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reports import GROUP, GROUPED, grouped
from ..session import work_dir
from ..sources.log_table import drop_folder, read_or_empty

STATE = "hour_start TIMESTAMP_NTZ, count BIGINT, body_total BIGINT, hour_key STRING"


def hourly_counts(rows: DataFrame) -> DataFrame:
    """Tumbling windows by request start."""
    counts = rows.groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("count"), F.sum("body_len").alias("body_total"))
    start = F.col("window.start")
    return counts.select(start.alias("hour_start"), "count", "body_total", F.date_format(start, "yyyy-MM-dd_HH").alias("hour_key"))


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_or_empty(spark, path, f"{schema}, day STRING")


def _keep(changed: DataFrame, path: str, checkpoint: str, schema: str, group: list[str], available_now: bool) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # the days of a batch, a few characters each, choose the folders to read
        batch = batch.withColumn("day", F.substring("hour_key", 1, 10)).persist()
        try:
            days = [row.day for row in batch.select("day").distinct().collect()]
            old = _stored(spark, path, schema).where(F.col("day").isin(days)).join(batch.select(*group), group, "left_anti")
            # landed first: a folder cannot be read and replaced in one job
            staging = work_dir(spark, "hourly")
            batch.unionByName(old).write.parquet(staging)
        finally:
            batch.unpersist()
        rows = spark.read.schema(f"{schema}, day STRING").parquet(staging).hint("rebalance", "day")
        rows.write.mode("overwrite").partitionBy("day").option("partitionOverwriteMode", "dynamic").parquet(path)
        drop_folder(spark, staging)

    writer = changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")).start()


def start_hourly(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    return _keep(hourly_counts(rows), path, checkpoint, STATE, ["hour_key"], available_now)


def read_hourly(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, STATE).drop("hour_key", "day")


def start_summary(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keep ``reports.grouped`` of a stream; every report can be answered from it."""
    return _keep(grouped(rows), path, checkpoint, GROUPED, GROUP, available_now)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, GROUPED).drop("day")
