"""Pages of a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..functions import variants as V
from .scans import in_hours


def newest_first(df: DataFrame, page: int, limit: int) -> DataFrame:
    """One page; ties in time are broken by id so pages never overlap."""
    if page < 1 or limit < 1:
        raise ValueError("page and limit start at 1")
    return df.orderBy(F.desc("ts"), F.desc("seq_id")).offset((page - 1) * limit).limit(limit)


def spans_of_time(log: DataFrame) -> list[tuple[list[str | None], int]]:
    """Hours with rows and their number, newest first. Hours whose times touch are one span, as are those with a
    row without a time; so every row of a span is newer than all rows of the spans behind it.

    One row an hour comes to the driver, from three narrow columns.
    """
    hours = log.groupBy("hour_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"), F.count("ts").alias("timed")
    ).collect()
    # a row without a time sorts behind all others
    timeless = [h for h in hours if h.timed < h.n]
    spans, low = [], None
    for hour in sorted((h for h in hours if h.high is not None), key=lambda h: h.high, reverse=True):
        if spans and hour.high >= low:
            spans[-1] = (spans[-1][0] + [hour.hour_key], spans[-1][1] + hour.n)
            low = min(low, hour.low)
        else:
            spans.append(([hour.hour_key], hour.n))
            low = hour.low
    if timeless:
        open_end = {h.hour_key for h in timeless}
        first = next((i for i, (keys, _) in enumerate(spans) if open_end & set(keys)), len(spans))
        behind = spans[first:] + [([h.hour_key], h.n) for h in timeless if h.high is None]
        spans[first:] = [([k for keys, _ in behind for k in keys], sum(n for _, n in behind))]
    return spans


def newest_by_rank(log: DataFrame, page: int, limit: int) -> tuple[DataFrame, int]:
    """One page and the number of rows of the whole listing; the order is that of ``newest_first``.

    Prefix sums over the counts of the hours tell in which of them the page lies. Only those are sorted, with
    their keys in the plan, so that a page far down reads no more than one at the top.
    """
    if page < 1 or limit < 1:
        raise ValueError("page and limit start at 1")
    first, at, skipped, keys = (page - 1) * limit, 0, 0, []
    for hours, n in spans_of_time(log):
        if at + n <= first:
            skipped += n
        elif at < first + limit:
            keys += hours
        at += n
    rows = log.where(in_hours(keys)).orderBy(F.desc("ts"), F.desc("seq_id"))
    return rows.offset(max(first - skipped, 0)).limit(limit), at


def msg_count(body_text: Column) -> Column:
    """Messages of a body that are not from the system; 0 for an unreadable body."""
    turns = V.items(V.parse_object(body_text), "messages")
    counted = F.filter(turns, lambda m: ~V.text_of(m, "role").eqNullSafe("system"))
    return F.coalesce(F.size(counted), F.lit(0)).cast("bigint")


def request_page(
    log: DataFrame, page: int = 1, limit: int = 50, model: str | None = None, status: int | None = None
) -> DataFrame:
    """Page of a (time-filtered) log with the size of the whole listing.

    The hours are counted at once; the page is sorted from the hours it lies in. Bodies
    are decoded after the limit, so only the rows of the page travel to Python.
    """
    if model is not None:
        log = log.where(F.col("model") == model)
    if status is not None:
        log = log.where(F.col("status") == status)
    rows, total = newest_by_rank(log, page, limit)
    return rows.withColumn("_body", codec.decode_lenient(F.col("body"))).select(
        "seq_id",
        F.date_format("ts", "HH:mm:ss").alias("time"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        "model", "method", "path", "status", "duration_ms", "body_len",
        F.coalesce(F.octet_length("response"), F.lit(0)).cast("bigint").alias("resp_size"),
        msg_count(F.col("_body")).alias("msg_count"),
        F.lit(total).cast("bigint").alias("total"),
        F.lit(-(-total // limit)).cast("bigint").alias("total_pages"),
    )
