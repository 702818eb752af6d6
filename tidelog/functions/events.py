"""Server-sent events of a streamed reply, rebuilt row by row.

A reply is one cell, so everything here is an expression over that cell: split
the text, parse each data line once, read the few fields needed, fold. Nothing
is exploded, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import variants as V
from .text import strip_line

# Event names whose presence marks a streamed reply (fixed values).
STREAM_MARKS = ("content_block_delta", "message_start", "message_delta")
END_MARK = "[DONE]"

FIRST_LINE = "first"  # one data line per blank-line separated frame
ALL_LINES = "all"  # every data line; also right for CRLF streams


def looks_streaming(text: Column, compat: bool = False) -> Column:
    """Does the reply look like an event stream?

    ``compat`` is the bare substring test, which a plain reply that merely
    mentions an event name passes too; by default some line must also start
    like a stream line.
    """
    marks = F.lit(False)
    for mark in STREAM_MARKS:
        marks = marks | F.contains(text, F.lit(mark))
    return marks if compat else marks & text.rlike(r"(?m)^[ \t]*(data|event):")


_END = 2**31 - 1


def _payloads(lines: Column) -> Column:
    """Contents of the data lines. The usual line starts right away and ends in a
    brace; only others are worth the slower full strip."""
    mark = F.lit("data:")
    data = F.filter(
        lines,
        lambda line: F.startswith(line, mark)
        | (F.contains(line, mark) & F.startswith(strip_line(line), mark)),
    )
    contents = F.transform(
        data,
        lambda line: F.trim(
            F.substring(F.when(F.startswith(line, mark), line).otherwise(strip_line(line)), F.lit(6), F.lit(_END))
        ),
    )
    return F.transform(contents, lambda c: F.when(F.startswith(c, F.lit("{")) & F.endswith(c, F.lit("}")), c).otherwise(strip_line(c)))


def payloads(text: Column, mode: str = ALL_LINES) -> Column:
    """JSON texts of the events in order."""
    if mode == FIRST_LINE:
        first = F.transform(F.split(text, "\n\n"), lambda f: F.get(_payloads(F.split(f, "\n")), 0))
        return F.filter(first, lambda p: p.isNotNull())
    if mode == ALL_LINES:
        found = _payloads(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"))
        return F.filter(found, lambda p: p != END_MARK)
    raise ValueError(f"unknown event mode {mode!r}")


def event_objects(text: Column, mode: str = ALL_LINES) -> Column:
    """The events in order as ARRAY<VARIANT>; unreadable ones are left out."""
    return F.filter(F.transform(payloads(text, mode), V.parse_stripped), lambda v: v.isNotNull())


# What a rebuild needs of an event. One typed parse reads it all, at a fraction
# of the cost of a VARIANT per event and a path lookup per field.
EVENT_FIELDS = """
    type: STRING, index: BIGINT,
    content_block: STRUCT<type: STRING, text: STRING, thinking: STRING, id: STRING, name: STRING, input: VARIANT>,
    delta: STRUCT<type: STRING, text: STRING, thinking: STRING, partial_json: STRING, stop_reason: STRING>,
    message: STRUCT<usage: MAP<STRING, VARIANT>>,
    usage: MAP<STRING, VARIANT>
"""


def _fields(payload: Column) -> Column:
    return F.from_json(payload, f"STRUCT<{EVENT_FIELDS}>")


def _with_stop(event: Column, payload: Column) -> Column:
    """A typed parse cannot tell a null stop reason from a missing one, so the few
    events that mention it are looked at again."""
    has_stop = F.contains(payload, F.lit('"stop_reason"')) & V.has_key(
        V.parse_stripped(payload), "delta", "stop_reason"
    )
    return F.struct(event.alias("e"), has_stop.alias("has_stop"))


def read_events(contents: Column) -> Column:
    """ARRAY<STRUCT<e, has_stop>> of ARRAY<STRING>.

    All events of a reply are read by one parse of one JSON array. If an event is
    broken the array is too; then, and only then, they are read one by one.
    """
    together = F.from_json(
        F.concat(F.lit("["), F.array_join(contents, ","), F.lit("]")), f"ARRAY<STRUCT<{EVENT_FIELDS}>>"
    )
    read = V.bind(
        together,
        lambda all_read: F.when(F.size(all_read) == F.size(contents), all_read).otherwise(
            F.transform(contents, _fields)
        ),
    )
    return F.transform(read, lambda event, at: _with_stop(event, F.get(contents, at)))


def events_of(text: Column, mode: str = ALL_LINES) -> Column:
    """ARRAY<STRUCT<e, has_stop>>. Unreadable events have no type and add nothing."""
    return V.bind(F.filter(payloads(text, mode), V.looks_like_object), read_events)


def readable_events_of(text: Column, mode: str = ALL_LINES) -> Column:
    """As ``events_of`` without the unreadable events, for listing them."""
    return V.bind(
        F.filter(payloads(text, mode), lambda p: V.parse_stripped(p).isNotNull()), read_events
    )


def _is(event: Column, kind: str) -> Column:
    return event["e"]["type"] == kind


def _part(event: Column, kind: str, delta_kind: str, field: str) -> Column:
    block, delta = event["e"]["content_block"], event["e"]["delta"]
    return F.when(_is(event, "content_block_delta") & (delta["type"] == delta_kind), delta[field]).when(
        _is(event, "content_block_start") & (block["type"] == kind), block[field]
    )


def text_part(event: Column) -> Column:
    """What one event adds to the visible text."""
    return _part(event, "text", "text_delta", "text")


def thinking_part(event: Column) -> Column:
    return _part(event, "thinking", "thinking_delta", "thinking")


def rebuild_text(events: Column) -> Column:
    return F.array_join(F.transform(events, text_part), "")


def rebuild_thinking(events: Column) -> Column:
    return F.array_join(F.transform(events, thinking_part), "")


def merge_maps(maps: Column) -> Column:
    """Key-wise merge of ARRAY<MAP>, the last value of a key wins (a session setting)."""
    filled = F.filter(maps, lambda m: m.isNotNull())
    return F.map_from_entries(F.flatten(F.transform(filled, F.map_entries)))


def rebuild_usage(events: Column, with_start: bool = True) -> Column:
    """Token usage; ``with_start=False`` looks at message_delta events only."""

    def usage(event: Column) -> Column:
        found = F.when(_is(event, "message_delta"), event["e"]["usage"])
        return found.when(_is(event, "message_start"), event["e"]["message"]["usage"]) if with_start else found

    return merge_maps(F.transform(events, usage))


def rebuild_stop_reason(events: Column) -> Column:
    """From the last message_delta that has the key, even if it is null there."""
    marked = F.filter(events, lambda e: _is(e, "message_delta") & e["has_stop"])
    return F.try_element_at(marked, F.lit(-1))["e"]["delta"]["stop_reason"]


def count_blocks(events: Column) -> Column:
    return F.size(F.filter(events, lambda e: _is(e, "content_block_start"))).cast("bigint")


def _is_start(event: Column) -> Column:
    return _is(event, "content_block_start")


def _given_input(event: Column) -> Column:
    """Input a start event brings along; an empty one means it follows in deltas."""
    text = F.to_json(event["e"]["content_block"]["input"])
    return F.when(text.isin(*V.EMPTY_JSON), "").otherwise(F.coalesce(text, F.lit("")))


def _number_blocks(events: Column) -> Column:
    """ARRAY<BIGINT>: the block index of each tool event. An event without one takes
    the number of blocks known so far. Only a reply that names some and leaves out others is folded."""
    given = F.transform(events, lambda e: e["e"]["index"])
    nothing = F.array().cast("array<bigint>")
    start = F.struct(nothing.alias("known"), nothing.alias("numbers"))

    def step(state: Column, index: Column) -> Column:
        known = state["known"]

        def placed(number: Column) -> Column:
            more = F.when(F.array_contains(known, number), known).otherwise(F.concat(known, F.array(number)))
            return F.struct(more.alias("known"), F.concat(state["numbers"], F.array(number)).alias("numbers"))

        return V.bind(F.coalesce(index, F.size(known).cast("bigint")), placed)

    folded = F.aggregate(given, start, step, lambda state: state["numbers"])
    counted = F.transform(given, lambda _, at: at.cast("bigint"))
    some, lacking = F.exists(given, lambda i: i.isNotNull()), F.exists(given, lambda i: i.isNull())
    return F.when(~lacking, given).when(~some, counted).otherwise(folded)


def rebuild_tool_calls(events: Column) -> Column:
    """ARRAY<STRUCT<id, name, input_json>> in first-seen order.

    A start (re)sets the block of its index; deltas append to it, and a delta
    whose block never started opens an empty one.
    """
    wanted = F.filter(
        events,
        lambda e: (_is(e, "content_block_delta") & (e["e"]["delta"]["type"] == "input_json_delta"))
        | (_is_start(e) & (e["e"]["content_block"]["type"] == "tool_use")),
    )
    return V.bind(wanted, lambda tools: V.bind(_number_blocks(tools), lambda index: _calls(tools, index)))


def _calls(tools: Column, index: Column) -> Column:
    """The events sorted by block and place once; a block is one slice of them, between two borders."""

    def piece(event: Column, at: Column) -> Column:
        block = event["e"]["content_block"]
        started = _is_start(event)
        text = F.when(started, _given_input(event)).otherwise(F.coalesce(event["e"]["delta"]["partial_json"], F.lit("")))
        return F.struct(
            F.get(index, at).alias("index"), at.alias("at"), started.alias("started"),
            F.when(started, F.coalesce(block["id"], F.lit(""))).otherwise("").alias("id"),
            F.when(started, F.coalesce(block["name"], F.lit(""))).otherwise("").alias("name"), text.alias("text"),
        )

    def blocks(pieces: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(pieces) - 1)
        borders = F.filter(places, lambda i: (i == 0) | (F.get(pieces, i)["index"] != F.get(pieces, i - 1)["index"]))
        return V.bind(borders, lambda found: F.flatten(F.transform(found, lambda b, k: V.bind(
            F.slice(pieces, b + 1, F.coalesce(F.get(found, k + 1), F.size(pieces)) - b), entries
        ))))

    def entries(block: Column) -> Column:
        # an entry for every start and for the first event; all show the block as its last start leaves it
        last = F.coalesce(F.try_element_at(F.filter(block, lambda p: p["started"]), F.lit(-1)), F.get(block, 0))
        listed = F.filter(block, lambda p, n: p["started"] | (n == 0))

        def whole(first: Column) -> Column:
            text = F.array_join(F.transform(F.filter(block, lambda p: p["at"] >= first["at"]), lambda p: p["text"]), "")
            call = F.struct(first["id"].alias("id"), first["name"].alias("name"), text.alias("input_json"))
            return V.bind(call, lambda c: F.transform(listed, lambda p: F.struct(p["at"].alias("at"), c.alias("call"))))

        return V.bind(last, whole)

    none = F.array().cast("array<struct<id: string, name: string, input_json: string>>")
    in_order = V.bind(F.array_sort(F.transform(tools, piece)), blocks)
    return F.when(F.size(tools) == 0, none).otherwise(F.transform(F.array_sort(in_order), lambda entry: entry["call"]))


def named_events(text: Column) -> Column:
    """ARRAY<STRUCT<event_name, data>>: every data line with the name the line before it gives."""

    def pair_up(lines: Column) -> Column:
        def read(line: Column, at: Column) -> Column:
            before = strip_line(F.when(at > 0, F.get(lines, at - 1)))
            name = F.when(
                F.startswith(before, F.lit("event:")), strip_line(F.substring(before, F.lit(7), F.length(before)))
            )
            data = V.parse_object(F.substring(line, F.lit(6), F.lit(_END)))
            return F.when(F.startswith(line, F.lit("data:")), F.struct(name.alias("event_name"), data.alias("data")))

        return F.filter(F.transform(lines, read), lambda e: e.isNotNull())

    # the lines are bound: looking back at one must not split the text again
    return V.bind(F.split(text, "\n"), pair_up)


def _repair_line(line: Column, before: Column) -> Column:
    def fix(event: Column) -> Column:
        kind = V.text_of(event, "type")
        named = F.coalesce(F.startswith(before, F.lit("event: ")), F.lit(False))
        head = F.when(~named & (kind != ""), F.concat(F.lit("event: "), kind, F.lit("\n"))).otherwise("")
        lacking = (
            (kind == "message_delta") & V.has_key(event, "usage", "output_tokens")
            & ~V.has_key(event, "usage", "input_tokens")
        )
        usage = F.to_variant_object(
            F.map_concat(V.entries(event, "usage"), F.create_map(F.lit("input_tokens"), F.try_parse_json(F.lit("1"))))
        )
        others = F.map_filter(V.entries(event), lambda key, _: key != "usage")
        whole = F.to_json(F.map_concat(others, F.create_map(F.lit("usage"), usage)))
        return F.concat(head, F.when(lacking, F.concat(F.lit("data: "), whole)).otherwise(line))

    repaired = V.bind(V.parse_object(F.substring(line, F.lit(7), F.lit(_END))), fix)
    return F.when(F.startswith(line, F.lit("data: ")), repaired).otherwise(line)


def repair_lines(text: Column) -> Column:
    """Fix streams of upstreams that leave things out; other lines stay as they are.

    A data line that does not directly follow an ``event:`` line gets one named
    after its type. A message_delta usage with output but no input tokens gets
    ``input_tokens`` 1; that line is written back as key-sorted JSON.
    """

    def repair(lines: Column) -> Column:
        return F.transform(lines, lambda line, at: _repair_line(line, F.when(at > 0, F.get(lines, at - 1))))

    return F.array_join(V.bind(F.split(text, "\n"), repair), "\n")
