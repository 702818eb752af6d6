"""A whole reply, streamed or plain, as one struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import events as E
from . import variants as V

REPLY_TYPE = (
    "STRUCT<text: STRING, thinking: STRING, is_streaming: BOOLEAN, usage: MAP<STRING, VARIANT>, "
    "stop_reason: STRING, tool_calls: ARRAY<STRUCT<id: STRING, name: STRING, input_json: STRING>>>"
)


def _joined(blocks: Column, kind: str) -> Column:
    chosen = F.filter(blocks, lambda b: V.text_of(b, "type") == kind)
    return F.coalesce(F.array_join(F.transform(chosen, lambda b: V.text_of(b, kind)), ""), F.lit(""))


def content_text(blocks: Column) -> Column:
    """Concatenated text blocks of ARRAY<VARIANT>."""
    return _joined(blocks, "text")


def content_thinking(blocks: Column) -> Column:
    return _joined(blocks, "thinking")


def content_tools(blocks: Column) -> Column:
    chosen = F.filter(blocks, lambda b: V.text_of(b, "type") == "tool_use")

    def call(b: Column) -> Column:
        given = V.get(b, "input", "variant")
        return F.struct(
            F.coalesce(V.text_of(b, "id"), F.lit("")).alias("id"),
            F.coalesce(V.text_of(b, "name"), F.lit("")).alias("name"),
            F.coalesce(F.to_json(given), F.lit("{}")).alias("input_json"),
        )

    return F.transform(chosen, call)


def _reply(text, thinking, streaming, usage, stop, tools) -> Column:
    return F.struct(
        text.alias("text"),
        thinking.alias("thinking"),
        F.lit(streaming).alias("is_streaming"),
        F.coalesce(usage, F.lit(None).cast("map<string,variant>")).alias("usage"),
        stop.alias("stop_reason"),
        F.coalesce(tools, F.array()).alias("tool_calls"),
    ).cast(REPLY_TYPE)


def streamed_reply(
    text: Column, mode: str = E.ALL_LINES, start_usage: bool = True, with_tools: bool = True
) -> Column:
    """``with_tools=False`` leaves the tool calls out (an empty array) and saves their work."""
    return V.bind(
        E.events_of(text, mode),
        lambda ev: _reply(
            E.rebuild_text(ev), E.rebuild_thinking(ev), True,
            E.rebuild_usage(ev, start_usage), E.rebuild_stop_reason(ev),
            E.rebuild_tool_calls(ev) if with_tools else F.array(),
        ),
    )


def _from_message(message: Column, with_tools: bool = True) -> Column:
    return V.bind(
        V.items(message, "content"),
        lambda blocks: _reply(
            content_text(blocks), content_thinking(blocks), False,
            V.entries(message, "usage"), V.text_of(message, "stop_reason"),
            content_tools(blocks) if with_tools else F.array(),
        ),
    )


def _says_something(reply: Column, with_tools: bool = False) -> Column:
    said = (reply["text"] != "") | (reply["thinking"] != "")
    return said | (F.size(reply["tool_calls"]) > 0) if with_tools else said


def plain_reply_view(text: Column, with_tools: bool = True) -> Column:
    """Viewer rule: the JSON message, or the whole text of anything else."""
    other = _reply(text, F.lit(""), False, F.lit(None), F.lit(None), F.array())
    return V.bind(
        V.parse_object(text), lambda whole: F.when(whole.isNotNull(), _from_message(whole, with_tools)).otherwise(other)
    )


def plain_reply_clean(text: Column, mode: str = E.ALL_LINES, with_tools: bool = False) -> Column:
    """Dataset rule: a JSON message that says something, else the first ``message``
    event or non-empty ``message_start`` content, else NULL. ``with_tools`` lets
    a message that only calls tools count too."""

    def read(message: Column) -> Column:
        return _from_message(message, with_tools)

    def candidate(event: Column) -> Column:
        kind = V.text_of(event, "type")
        started = V.bind(
            V.bind(V.get(event, "message", "variant"), read), lambda r: F.when(_says_something(r, with_tools), r)
        )
        return F.when(kind == "message", read(event)).when(kind == "message_start", started)

    found = F.filter(F.transform(E.event_objects(text, mode), candidate), lambda r: r.isNotNull())
    return V.bind(
        V.bind(V.parse_object(text), read),
        lambda whole: F.when(_says_something(whole, with_tools), whole).otherwise(F.get(found, 0)),
    )
