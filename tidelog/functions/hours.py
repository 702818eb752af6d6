"""Hour windows of the log."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_FORMAT = "yyyy-MM-dd_HH"


def hour_key(ts: Column) -> Column:
    return F.date_format(ts, HOUR_FORMAT)


def moment(epoch: Column) -> Column:
    """TIMESTAMP of an epoch in seconds, to the microsecond."""
    return F.timestamp_micros(F.round(epoch * 1_000_000).cast("bigint"))


def local_hour_key(moment: Column, zone: str) -> Column:
    """The wall-clock hour of a TIMESTAMP in a zone; the session's zone is UTC."""
    return hour_key(F.from_utc_timestamp(moment, zone))


def hour_end(key: Column, zone: str = "UTC") -> Column:
    """UTC wall clock of the end of a zone's hour. An hour that a clock change
    repeats ends after the second time."""
    local = hour_start(key) + F.lit(timedelta(hours=1))
    return F.to_utc_timestamp(local.cast("timestamp"), zone).cast("timestamp_ntz")


def hour_start(key: Column) -> Column:
    return F.to_timestamp_ntz(key, F.lit(HOUR_FORMAT))


def date_of(key: Column) -> Column:
    return F.substring(key, 1, 10)


def hour_of(key: Column) -> Column:
    return F.when(F.contains(key, F.lit("_")), F.split_part(key, F.lit("_"), F.lit(2))).otherwise("")


def label_of(key: Column) -> Column:
    return F.when(
        F.contains(key, F.lit("_")), F.concat(date_of(key), F.lit(" "), hour_of(key), F.lit(":00"))
    ).otherwise(key)


def ntz(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def span_of(date: str, hour: str | None = None) -> tuple[datetime, datetime]:
    """Start and end of a day or of one of its hours."""
    start = datetime.strptime(date if hour is None else f"{date}_{hour}", "%Y-%m-%d" if hour is None else "%Y-%m-%d_%H")
    return start, start + (timedelta(days=1) if hour is None else timedelta(hours=1))
