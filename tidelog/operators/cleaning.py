"""Log rows -> dataset records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..functions import events as E
from ..functions import replies as R
from ..functions import variants as V
from ..functions.memo import once_per_application
from ..functions.text import stripped_length
from ..schema import METADATA_TYPE, REQUEST_KEYS, RESPONSE_TYPE, TOOL_CALL_TYPE
from .decoding import compute_once
from .rules import kept_row

HARD_MINIMUM = 2


def request_fields(body: Column) -> Column:
    """The kept request keys as one struct; an absent key is NULL, a null one a Variant null."""
    return F.struct(*[V.get(body, key, "variant").alias(key) for key in REQUEST_KEYS])


def _dedup_key(request: Column) -> Column:
    """Hash of model and messages; Variant text has sorted keys, so key order does not matter."""
    null = F.lit("null")
    return F.md5(
        F.concat(
            F.coalesce(F.to_json(request["model"]), null), F.lit("\n"),
            F.coalesce(F.to_json(request["messages"]), null),
        )
    )


@once_per_application
def _parsed(mode: str, compat_sniff: bool, keep_tool_calls: bool) -> Column:
    """Body and reply of a row with its texts in _body and _text."""
    text = F.col("_text")
    streamed = R.streamed_reply(text, mode, with_tools=keep_tool_calls)
    reply = F.when(E.looks_streaming(text, compat_sniff), streamed).otherwise(
        R.plain_reply_clean(text, mode, keep_tool_calls)
    )
    return F.struct(V.parse_object(F.col("_body")).alias("body"), reply.alias("reply"))


@once_per_application
def _measured() -> Column:
    answer = F.col("_p.reply")
    return F.struct(
        request_fields(F.col("_p.body")).alias("request"),
        F.greatest(
            F.coalesce(stripped_length(answer["text"]), F.lit(0)),
            F.coalesce(stripped_length(answer["thinking"]), F.lit(0)),
        ).alias("out_len"),
    )


def clean_records(
    log: DataFrame, mode: str = E.ALL_LINES, compat_sniff: bool = False, keep_tool_calls: bool = False,
    with_unreadable: bool = False,
) -> DataFrame:
    """Records that pass every row rule, before dedup.

    Columns: hour_key, seq_id, request, response, metadata, dedup_key, out_len.
    All row-local: the cheap rules reach the scan, decoding happens once.
    ``keep_tool_calls`` adds the tool calls and keeps replies that only call tools.
    ``with_unreadable`` adds rows that pass the row rules but whose body is no JSON object (too large or
    malformed ones too), marked in the column ``unreadable``.
    """
    filled, replied = F.octet_length("body") > 0, F.octet_length("response") > 0
    rows = log.where(kept_row() & (filled | replied if with_unreadable else replied)).select(
        "hour_key", "seq_id", "model", "status", "duration_ms",
        codec.decode_body(F.col("body")).alias("_body"),
        codec.decode_response(F.col("response")).alias("_text"),
        F.coalesce(filled, F.lit(False)).alias("_filled"), F.coalesce(replied, F.lit(False)).alias("_replied"),
    )
    parsed = compute_once(
        rows, _parsed(mode, compat_sniff, keep_tool_calls), "_p", "hour_key", "seq_id", "model", "status", "duration_ms",
        "_filled", "_replied",
    )
    answer = F.col("_p.reply")
    unreadable = F.col("_filled") & F.col("_p.body").isNull() if with_unreadable else F.lit(False)
    usable = F.col("_replied") & V.truthy(F.col("_p.body"), "messages")
    measured = compute_once(parsed.where(unreadable | usable), _measured(), "_m")
    said_enough = unreadable | (F.col("_m.out_len") >= HARD_MINIMUM)
    if keep_tool_calls:
        said_enough = said_enough | (F.size(answer["tool_calls"]) > 0)
    response = F.struct(
        answer["text"].alias("text"), answer["thinking"].alias("thinking"),
        answer["is_streaming"].alias("is_streaming"),
        F.coalesce(answer["usage"], F.create_map().cast("map<string,variant>")).alias("usage"),
        answer["stop_reason"].alias("stop_reason"),
        *([answer["tool_calls"].alias("tool_calls")] if keep_tool_calls else []),
    )
    extra = f", tool_calls: ARRAY<{TOOL_CALL_TYPE}>>" if keep_tool_calls else ">"
    return measured.where(said_enough).select(
        "hour_key", "seq_id",
        F.col("_m.request").alias("request"),
        response.cast(RESPONSE_TYPE[:-1] + extra).alias("response"),
        F.struct("seq_id", "model", "status", "duration_ms").cast(METADATA_TYPE).alias("metadata"),
        _dedup_key(F.col("_m.request")).alias("dedup_key"),
        F.col("_m.out_len").alias("out_len"),
        *([unreadable.alias("unreadable")] if with_unreadable else []),
    )


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row of each key.

    ``row_number = 1`` is planned with a group limit before the shuffle: a task
    sends at most one row of a key, so a key with a third of all rows is no
    hot spot.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def dedup(records: DataFrame, scope: str = "hour") -> DataFrame:
    """First record (by seq_id) of each request, per hour or over the whole log."""
    return first_per_key(records, scope_keys(scope), "seq_id")


def clean_dataset(
    log: DataFrame, min_output_len: int = HARD_MINIMUM, scope: str = "hour", **options
) -> DataFrame:
    """Dataset records. The length rule comes after dedup: a short first copy
    hides a longer later one."""
    kept = dedup(clean_records(log, **options), scope)
    if min_output_len > HARD_MINIMUM:
        kept = kept.where(F.col("out_len") >= min_output_len)
    return kept.select("hour_key", "seq_id", "request", "response", "metadata")


def scope_keys(scope: str) -> list[str]:
    if scope not in ("hour", "global"):
        raise ValueError(f"unknown scope {scope!r}")
    return ["hour_key", "dedup_key"] if scope == "hour" else ["dedup_key"]


def copies_of(records: DataFrame, scope: str = "hour", known: DataFrame | None = None) -> DataFrame:
    """(hour_key, seq_id) of records that copy another one: the first by seq_id, or, with ``known``
    (hour_key, dedup_key, seq_id), one that was stored before. Only narrow columns are read."""
    keys = scope_keys(scope)
    narrow = records.select("hour_key", "seq_id", "dedup_key")
    first = narrow.groupBy(*keys).agg(F.min("seq_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    if known is None:
        first = first.where("_n > 1")
    else:
        stored = known.groupBy(*keys).agg(F.min("seq_id").alias("_stored"))
        first = first.join(stored, keys, "left").where("_n > 1 OR _stored IS NOT NULL")
        first = first.withColumn("_first", F.coalesce("_stored", "_first")).drop("_stored")
    return narrow.join(first, keys).where(F.col("seq_id") != F.col("_first")).select("hour_key", "seq_id")


def without_copies(records: DataFrame, scope: str = "hour", min_output_len: int = HARD_MINIMUM) -> DataFrame:
    """``clean_dataset`` for landed records: the ids to leave out come from narrow columns.

    Requests with copies, and first copies that are too short, are few; the payloads are neither sorted
    nor shuffled unless the list of ids is too long to be broadcast.
    """
    kept = records.join(copies_of(records, scope), ["hour_key", "seq_id"], "left_anti")
    if min_output_len > HARD_MINIMUM:
        kept = kept.where(F.col("out_len") >= min_output_len)
    return kept.select("hour_key", "seq_id", "request", "response", "metadata")


def clean_stats(log: DataFrame, min_output_len: int = HARD_MINIMUM, **options) -> DataFrame:
    """Per hour: total, deduped, short_output, kept.

    One pass: each request's count and whether its first copy is long enough
    are partial sums, so only (hour, hash) pairs are shuffled.
    """
    records = clean_records(log, **options).select("hour_key", "seq_id", "dedup_key", "out_len")
    return stats_of(records, min_output_len)


def stats_of(records: DataFrame, min_output_len: int) -> DataFrame:
    per_request = records.groupBy("hour_key", "dedup_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.col("out_len") >= min_output_len, "seq_id").alias("long_enough"),
    )
    return (
        per_request.groupBy("hour_key")
        .agg(
            F.sum("n").alias("records_total"),
            F.sum(F.col("n") - 1).alias("records_deduped"),
            F.count_if(~F.col("long_enough")).alias("short_output"),
            F.count_if(F.col("long_enough")).alias("records_kept"),
        )
        .orderBy("hour_key")
    )


def archivable_hours(log: DataFrame, min_output_len: int = HARD_MINIMUM, **options) -> DataFrame:
    """Hours with something to archive; the others are neither archived nor purged."""
    return clean_stats(log, min_output_len, **options).where("records_kept > 0").select("hour_key", "records_kept")


def dedup_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Exact copies by md5: the first id of each text and the number of copies."""
    return df.groupBy(F.md5(F.col(text)).alias("text_md5")).agg(
        F.min(key).alias(key), F.count(F.lit(1)).alias("copies")
    )
