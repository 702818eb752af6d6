"""Reading slices of the log.

An hour or a day is what ``hour_key`` says, in the zone of the capture; the
predicate prunes partitions. Times compare ``ts``, or ``ts_epoch`` where a row
was landed without ``ts``.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hours as H

# the zone farthest west of UTC
WIDEST_OFFSET = timedelta(hours=12)

def in_hour(key: str) -> Column:
    return F.col("hour_key") == key


def in_hours(keys: Iterable[str | None]) -> Column:
    """Any of these hours; they are literals of the plan, so folders prune."""
    keys = list(keys)
    named = F.col("hour_key").isin([k for k in keys if k is not None])
    return named | F.col("hour_key").isNull() if None in keys else named


def on_date(date: str) -> Column:
    return F.startswith("hour_key", F.lit(f"{date}_"))


def last_day(as_of: datetime) -> Column:
    """The 24 hours before ``as_of`` (UTC). Partitions prune by a bound that holds in every zone."""
    cutoff = as_of - timedelta(days=1)
    without = F.col("ts").isNull() & (F.col("ts_epoch") >= cutoff.replace(tzinfo=timezone.utc).timestamp())
    earliest = (cutoff - WIDEST_OFFSET).strftime("%Y-%m-%d_%H")
    return ((F.col("ts") >= H.ntz(cutoff)) | without) & (F.col("hour_key") >= earliest)


def scan_window(log: DataFrame, key: str) -> DataFrame:
    """All columns of one hour, by seq_id."""
    return log.where(in_hour(key)).orderBy("seq_id")


def id_bounds(log: DataFrame) -> DataFrame:
    """(hour_key, low, high): the ids of every hour. Kept beside a log, it bounds a point lookup."""
    return log.groupBy("hour_key").agg(F.min("seq_id").alias("low"), F.max("seq_id").alias("high"))


def get_request(log: DataFrame, seq_id: int, bounds: DataFrame | None = None) -> DataFrame:
    """Point lookup; no row when the id is unknown.

    With the log's ``bounds`` only the hours that may hold the id are opened. Inside, the
    files' statistics and Bloom filters (``write_log``) leave out row groups.
    """
    found = log.where(F.col("seq_id") == seq_id)
    if bounds is None:
        return found
    return found.where(in_hours(r.hour_key for r in bounds.where(F.lit(seq_id).between(F.col("low"), F.col("high"))).collect()))


def list_requests(log: DataFrame, date: str | None = None, hour: str | None = None) -> DataFrame:
    """Listing without payloads, oldest first. An hour without a date is ignored."""
    if date and hour:
        log = log.where(in_hour(f"{date}_{hour}"))
    elif date:
        log = log.where(on_date(date))
    return log.select(
        "seq_id", "ts", "model", "method", "path", "status", "duration_ms", "body_len",
        F.coalesce(F.octet_length("response"), F.lit(0)).cast("bigint").alias("resp_size"),
    ).orderBy("ts", "seq_id")


def time_filter(
    log: DataFrame, hour_key: str | None = None, date: str | None = None, as_of: datetime | None = None
) -> DataFrame:
    """An hour, else a day, else the 24 hours before ``as_of``."""
    if hour_key:
        return log.where(in_hour(hour_key))
    if date:
        return log.where(on_date(date))
    if as_of is None:
        raise ValueError("give hour_key, date or as_of")
    return log.where(last_day(as_of))


def list_windows(log: DataFrame) -> DataFrame:
    return log.select("hour_key").distinct().orderBy("hour_key")


def list_dates(log: DataFrame) -> DataFrame:
    return log.select(H.date_of(F.col("hour_key")).alias("date")).distinct().orderBy(F.desc("date"))


def first_hour_of_day(log: DataFrame, date: str) -> DataFrame:
    """First hour of a day that has rows; NULL for a day without rows."""
    return log.where(on_date(date)).agg(F.min("hour_key").alias("hour_key"))


def latest(log: DataFrame) -> DataFrame:
    """The newest row; a top-1, not a sort."""
    return log.orderBy(F.desc("ts"), F.desc("seq_id")).limit(1)
