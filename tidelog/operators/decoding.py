"""From stored bytes to text and from text to replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..functions import events as E
from ..functions import replies as R
from ..functions.memo import once_per_application
from ..schema import MESSAGES_PATH


def compute_once(df: DataFrame, value: Column, name: str, *keep: str) -> DataFrame:
    """Add a struct column that later filters cannot make Spark compute again.

    A filter on a projected expression is pushed below the projection, which
    would evaluate it twice; it is not pushed below a generator.
    """
    columns = keep or tuple(df.columns)
    return df.select(*columns, F.explode(F.array(value)).alias(name))


def decode(log: DataFrame, strict_body: bool = False) -> DataFrame:
    """Replace the BINARY payloads by text; keep the stored response size."""
    body = codec.decode_body if strict_body else codec.decode_lenient
    others = [c for c in log.columns if c not in ("body", "response")]
    return log.select(
        *others,
        body(F.col("body")).alias("body_text"),
        F.coalesce(F.octet_length("response"), F.lit(0)).cast("bigint").alias("resp_size"),
        codec.decode_response(F.col("response")).alias("response_text"),
    )


def reply_of(
    text: Column, mode: str = E.ALL_LINES, compat_sniff: bool = False, with_tools: bool = True
) -> Column:
    """Streamed or plain reply as the viewer shows it."""
    streamed = R.streamed_reply(text, mode, with_tools=with_tools)
    return F.when(E.looks_streaming(text, compat_sniff), streamed).otherwise(R.plain_reply_view(text, with_tools))


@once_per_application
def _reply(mode: str, compat_sniff: bool, with_tools: bool) -> Column:
    return reply_of(F.col("response_text"), mode, compat_sniff, with_tools)


def with_reply(
    decoded: DataFrame, mode: str = E.ALL_LINES, compat_sniff: bool = False, with_tools: bool = True
) -> DataFrame:
    """Add the ``reply`` struct of every response."""
    return compute_once(decoded, _reply(mode, compat_sniff, with_tools), "reply")


def with_shown_reply(
    decoded: DataFrame, mode: str = E.ALL_LINES, compat_sniff: bool = False, with_tools: bool = True
) -> DataFrame:
    """As ``with_reply``, but rows outside the messages path show what came back
    as it is, and rows without a response an empty text."""
    text = F.col("response_text")
    chat = (F.col("method") == "POST") & F.contains("path", F.lit(MESSAGES_PATH)) & (text != "")
    raw = F.struct(
        text.alias("text"), F.lit("").alias("thinking"), F.lit(False).alias("is_streaming"),
        F.lit(None).cast("map<string,variant>").alias("usage"), F.lit(None).cast("string").alias("stop_reason"),
        F.array().alias("tool_calls"),
    ).cast(R.REPLY_TYPE)
    return compute_once(decoded, F.when(chat, _reply(mode, compat_sniff, with_tools)).otherwise(raw), "reply")


def explode_events(decoded: DataFrame, mode: str = E.ALL_LINES) -> DataFrame:
    """One row per event of the streamed replies: seq_id, pos, fields."""
    streamed = decoded.where(E.looks_streaming(F.col("response_text")))
    return streamed.select(
        "seq_id", F.posexplode(E.readable_events_of(F.col("response_text"), mode)).alias("pos", "event")
    )


def assemble_chunks(chunks: DataFrame, segment: int = 1024) -> DataFrame:
    """Bytes of each request from its chunks ``(seq_id, chunk_no, bytes)``.

    Two levels: runs of ``segment`` chunks are joined first, so the chunks of
    one huge reply are spread over tasks and the last step sees few pieces.
    """
    in_run = F.expr("listagg(bytes, x'') within group (order by chunk_no)")
    in_order = F.expr("listagg(_piece, x'') within group (order by _run)")
    runs = chunks.groupBy("seq_id", F.floor(F.col("chunk_no") / F.lit(segment)).alias("_run")).agg(
        in_run.alias("_piece")
    )
    return runs.groupBy("seq_id").agg(in_order.alias("bytes"))
