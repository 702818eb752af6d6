"""Keyword search over decoded text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import find_ignore_case, snippet
from ..sources.log_table import landed
from .decoding import compute_once
from .paging import newest_first
from .rules import searchable
from .scans import time_filter


def reply_of() -> Column:
    """What is searched of a reply: its text, then its thinking."""
    return F.concat(F.coalesce("reply_text", F.lit("")), F.lit(" "), F.coalesce("reply_thinking", F.lit("")))


def search(decoded: DataFrame, query: str, scope: str = "all") -> DataFrame:
    """Rows that contain ``query``, in any case: body first, then the rebuilt reply.

    ``decoded`` has body_text and the reply columns reply_text, reply_thinking.
    One hit per row, with the text around it. Columns a scope does not need
    are not read.
    """
    query = query.strip()
    if scope not in ("all", "body", "response"):
        raise ValueError(f"unknown scope {scope!r}")
    if not query:
        return search(decoded, "x", scope).where(F.lit(False))
    body = F.col("body_text") if scope != "response" else F.lit(None).cast("string")
    reply = reply_of() if scope != "body" else F.lit(None).cast("string")
    in_body = find_ignore_case(body, query)
    hit = F.when(in_body > 0, F.struct(F.lit("body").alias("scope"), in_body.alias("at"))).otherwise(
        F.struct(F.lit("response").alias("scope"), find_ignore_case(reply, query).alias("at"))
    )
    found = compute_once(decoded.where(searchable()), hit, "_hit").where("_hit.at > 0")
    where = F.when(F.col("_hit.scope") == "body", body).otherwise(reply)
    return found.select(
        "seq_id", "ts",
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "HH:mm:ss").alias("time"),
        "model", "status", "duration_ms", "body_len", "resp_size",
        F.col("_hit.scope").alias("scope"),
        snippet(where, F.col("_hit.at"), query).alias("snippet"),
    )


def search_within(
    decoded: DataFrame, query: str, scope: str = "all", hour_key: str | None = None, date: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """Hits of an hour, else of a day, else of the 24 hours before ``as_of``. The time prunes partitions first."""
    return search(time_filter(decoded, hour_key, date, as_of), query, scope)


def search_page(hits: DataFrame, page: int = 1, limit: int = 30) -> DataFrame:
    """A page of hits, newest first; the total counts all of them. Hits are landed (they hold
    snippets, no texts), so that the log is searched once for both."""
    hits = landed(hits, "hits")
    total = hits.agg(F.count(F.lit(1))).scalar()
    return newest_first(hits, page, limit).withColumn("total", total)
