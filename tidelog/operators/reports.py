"""Counts over the log. Every report is one pass with map-side partial sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hours as H
from .rules import skip_reason


def _resp_size():
    return F.coalesce(F.octet_length("response"), F.lit(0)).cast("bigint")


def summary(log: DataFrame) -> DataFrame:
    def total(condition):
        return F.count_if(condition)

    status = F.col("status")
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        total(status == 200).alias("success"),
        total(status != 200).alias("errors"),
        total(status.isNull()).alias("pending"),
        # timeouts carry no status, so they hide among the pending rows
        total(F.coalesce("error", F.lit("")) != "").alias("with_error"),
        F.coalesce(F.sum("body_len"), F.lit(0)).alias("body_total"),
        F.coalesce(F.sum(_resp_size()), F.lit(0)).alias("resp_total"),
    )


# What the reports can be answered from: narrow sums per hour, model and status.
GROUP = ["hour_key", "model", "status", "failed"]
GROUPED = "model STRING, status INT, failed BOOLEAN, n BIGINT, body_total BIGINT, resp_total BIGINT, hour_key STRING"


def grouped(log: DataFrame) -> DataFrame:
    # NULLs are groups of their own; a key that is joined on later must not be NULL
    model, status = F.coalesce("model", F.lit("")), F.coalesce("status", F.lit(-1))
    failed = F.coalesce("error", F.lit("")) != ""
    sums = log.groupBy("hour_key", model.alias("model"), status.alias("status"), failed.alias("failed")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("body_len"), F.lit(0)).alias("body_total"), F.sum(_resp_size()).alias("resp_total")
    )
    return sums.select([part.split()[0] for part in GROUPED.split(", ")])


def summary_of(groups: DataFrame) -> DataFrame:
    """``summary`` from the rows of ``grouped``."""

    def total(value, where=None):
        return F.coalesce(F.sum(value if where is None else F.when(where, value)), F.lit(0)).cast("bigint")

    n, status = F.col("n"), F.col("status")
    return groups.agg(
        total(n).alias("total"), total(n, status == 200).alias("success"), total(n, (status != 200) & (status != -1)).alias("errors"),
        total(n, status == -1).alias("pending"), total(n, F.col("failed")).alias("with_error"),
        total(F.col("body_total")).alias("body_total"), total(F.col("resp_total")).alias("resp_total"),
    )


def by_model_of(groups: DataFrame) -> DataFrame:
    return groups.groupBy("model").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "model")


def by_model(log: DataFrame) -> DataFrame:
    return log.groupBy("model").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "model")


def top_models(log: DataFrame, n: int = 8) -> DataFrame:
    return by_model(log).limit(n)


def count_by_hour(log: DataFrame) -> DataFrame:
    return log.groupBy("hour_key").agg(F.count(F.lit(1)).alias("count"))


def hours(log: DataFrame) -> DataFrame:
    key = F.col("hour_key")
    return (
        count_by_hour(log)
        .select(
            "hour_key", H.date_of(key).alias("date"), H.hour_of(key).alias("hour"), H.label_of(key).alias("label"),
            "count",
        )
        .orderBy(F.desc("hour_key"))
    )


def recent_hours(log: DataFrame, n: int = 30) -> DataFrame:
    return count_by_hour(log).orderBy(F.desc("hour_key")).limit(n)


def activity_share(log: DataFrame, window: int = 30, shown: int = 15) -> DataFrame:
    """Share of the busiest recent hour, in percent, oldest first."""
    recent = recent_hours(log, window)
    peak = F.max("count").over(Window.partitionBy())  # at most ``window`` rows
    return (
        recent.withColumn("share", F.round(F.col("count") / F.greatest(peak, F.lit(1)) * 100, 1))
        .orderBy(F.desc("hour_key"))
        .limit(shown)
        .orderBy("hour_key")
    )


def hours_by_date(log: DataFrame) -> DataFrame:
    """Hours listed under their date; a date has at most 24."""
    each = F.struct(F.col("hour_key"), F.col("count"))
    return (
        count_by_hour(log)
        .groupBy(H.date_of(F.col("hour_key")).alias("date"))
        .agg(F.sort_array(F.collect_list(each), asc=False).alias("hours"))
        .orderBy(F.desc("date"))
    )


def window_sizes(log: DataFrame) -> DataFrame:
    """Rows and bytes per hour plus the grand total (NULL hour, ``is_total``).

    Summed per hour first, so the rollup expands a few rows, not the log.
    """
    return _rolled_up(
        log.groupBy("hour_key").agg(F.count(F.lit(1)).alias("n"), F.sum("body_len").alias("b"), F.sum(_resp_size()).alias("r"))
    )


def window_sizes_of(groups: DataFrame) -> DataFrame:
    """``window_sizes`` from the rows of ``grouped``."""
    return _rolled_up(groups.groupBy("hour_key").agg(F.sum("n").alias("n"), F.sum("body_total").alias("b"), F.sum("resp_total").alias("r")))


def _rolled_up(hourly: DataFrame) -> DataFrame:
    return (
        hourly.rollup("hour_key")
        .agg(
            (F.grouping("hour_key") == 1).alias("is_total"),
            F.sum("n").alias("entries"),
            F.coalesce(F.sum("b"), F.lit(0)).alias("body_total"),
            F.coalesce(F.sum("r"), F.lit(0)).alias("resp_total"),
        )
        .orderBy("is_total", F.desc("hour_key"))
    )


def skip_reasons(log: DataFrame) -> DataFrame:
    reason = F.coalesce(skip_reason(), F.lit("keep"))
    return log.groupBy(reason.alias("skip_reason")).agg(F.count(F.lit(1)).alias("count")).orderBy("skip_reason")


def max_seq(*tables: DataFrame) -> int:
    """High-water mark of the ids over log and archives, 0 when empty."""
    marks = [t.agg(F.max("seq_id")).first()[0] for t in tables]
    return max((m for m in marks if m is not None), default=0)
