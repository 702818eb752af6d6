"""Rows that end after their hour was closed.

A row belongs to the hour in which its request started but exists only once
the request has finished. An hour closes ``allowed`` after its end; a row that
finishes later goes to a quarantine table instead of an hour that is already
archived. The rule looks at the row alone, so batches can come in any order.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import hours as H
from .batches import write_batch

# longest upstream wait is 20 minutes; half an hour leaves room
ALLOWED = timedelta(minutes=30)


def finished_at() -> Column:
    micros = F.round(F.col("duration_ms") * 1000).cast("bigint")
    return F.col("ts") + F.make_dt_interval(secs=(micros / F.lit(1_000_000)).cast("decimal(18,6)"))


def closes_at(allowed: timedelta, zone: str = "UTC") -> Column:
    return H.hour_end(F.col("hour_key"), zone) + F.lit(allowed)


def is_late(allowed: timedelta = ALLOWED, zone: str = "UTC") -> Column:
    """A row without a duration or a start is not known to be late."""
    return F.coalesce(finished_at() > closes_at(allowed, zone), F.lit(False))


def late_rows(log: DataFrame, allowed: timedelta = ALLOWED, zone: str = "UTC") -> DataFrame:
    return log.where(is_late(allowed, zone))


def closed_hours(windows: DataFrame, now: Column, allowed: timedelta = ALLOWED, zone: str = "UTC") -> DataFrame:
    """Hours that may be archived; ``now`` is UTC."""
    return windows.where(closes_at(allowed, zone) <= now)


def start_routing(
    rows: DataFrame, root: str, checkpoint: str, allowed: timedelta = ALLOWED, available_now: bool = False,
    zone: str = "UTC",
) -> StreamingQuery:
    """Send rows to ``late=false`` (the log) or ``late=true`` (the quarantine) in one write."""

    def write(batch: DataFrame, batch_id: int) -> None:
        tagged = batch.withColumn("late", is_late(allowed, zone)).hint("rebalance", "late", "hour_key")
        write_batch(tagged, root, batch_id, "late", "hour_key")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")).start()
