import json
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import delta, sse, start_text, stop
from tidelog.functions import events as E
from tidelog.functions import replies as R
from tidelog.functions import variants as V


def tool_start(index, name="f", given=None, **extra):
    block = {"type": "tool_use", "id": f"id-{name}", "name": name, "input": given or {}}
    event = {"type": "content_block_start", "content_block": block, **extra}
    return event if index is None else {**event, "index": index}


def tool_delta(index, text):
    event = {"type": "content_block_delta", "delta": {"type": "input_json_delta", "partial_json": text}}
    return event if index is None else {**event, "index": index}


def calls(value, *events):
    got = value(lambda T: E.rebuild_tool_calls(E.events_of(T)), t=sse(*events))
    return [(c.id, c.name, c.input_json) for c in got]


def test_text_in_start_and_deltas(value):
    text = sse({"type": "message_start", "message": {}}, start_text("Hé"), delta("llo"), delta(" 😀"), stop())
    assert value(lambda T: E.rebuild_text(E.events_of(T)), t=text) == "Héllo 😀"


def test_modes_differ_on_two_lines_and_crlf(value):
    two = sse("data: " + json.dumps(delta("a")) + "\ndata: " + json.dumps(delta("b")), delta("c"))
    assert value(lambda T: E.rebuild_text(E.events_of(T)), t=two) == "abc"
    assert value(lambda T: E.rebuild_text(E.events_of(T, E.FIRST_LINE)), t=two) == "ac"
    crlf = sse(delta("a"), delta("b")).replace("\n", "\r\n")
    assert value(lambda T: E.rebuild_text(E.events_of(T)), t=crlf) == "ab"
    assert value(lambda T: E.rebuild_text(E.events_of(T, E.FIRST_LINE)), t=crlf) == "a"


def test_unknown_mode(value):
    with pytest.raises(ValueError):
        E.events_of(F.col("t"), "some")


@pytest.mark.parametrize(
    "frame",
    [
        'data: {"type":"content_block_delta"', "data: [DONE]", "data: [1,2]", 'data: "text"', "data: 5", "data:",
        'data: {"a":"}', 'data: {","b":1}', 'data: {"type":"x"} trailing', ": comment",
    ],
)
def test_unreadable_frames_are_skipped(value, frame):
    assert value(lambda T: E.rebuild_text(E.events_of(T)), t=sse(delta("a"), frame, delta("b"))) == "ab"
    assert value(lambda T: F.size(E.readable_events_of(T)), t=sse(delta("a"), frame, delta("b"))) == 2


def test_two_broken_events_that_join_to_a_valid_one(value):
    text = sse(delta("a"), 'data: {"a":"}', 'data: {","b":1}', delta("b"))
    assert value(lambda T: E.rebuild_text(E.events_of(T)), t=text) == "ab"


def test_lines_may_be_indented(value):
    assert value(lambda T: E.rebuild_text(E.events_of(T)), t="\t data:" + json.dumps(delta("x")) + " \t\n\n") == "x"


def test_odd_types_do_not_break_the_rest(value):
    odd = {"type": "content_block_delta", "index": "x", "delta": [1]}
    assert value(lambda T: E.rebuild_text(E.events_of(T)), t=sse(delta("a"), odd, {"type": {"k": 1}}, delta("b"))) == "ab"


def test_usage_last_wins(value):
    first = {"type": "message_start", "message": {"usage": {"input_tokens": 7, "output_tokens": 1}}}
    text = sse(first, stop(output_tokens=5), stop(output_tokens=6, cache_read_input_tokens=2))

    def usage(**options):
        got = value(lambda T: E.rebuild_usage(E.events_of(T), **options), t=text)
        return {k: json.loads(v.toJson()) for k, v in got.items()}

    assert usage() == {"input_tokens": 7, "output_tokens": 6, "cache_read_input_tokens": 2}
    assert usage(with_start=False) == {"output_tokens": 6, "cache_read_input_tokens": 2}


def test_duplicate_key_keeps_the_last(value):
    text = sse('data: {"type":"message_delta","delta":{},"usage":{"output_tokens":1,"output_tokens":2}}')
    got = value(lambda T: E.rebuild_usage(E.events_of(T)), t=text)
    assert {k: v.toPython() for k, v in got.items()} == {"output_tokens": 2}


@pytest.mark.parametrize(
    "events, expected",
    [
        ([stop("end_turn")], "end_turn"),
        ([stop("end_turn"), stop(None)], None),
        ([stop("tool_use"), {"type": "message_delta", "delta": {}}], "tool_use"),
        ([stop("tool_use"), {"type": "message_delta"}], "tool_use"),
        ([delta("x")], None),
    ],
)
def test_stop_reason(value, events, expected):
    assert value(lambda T: E.rebuild_stop_reason(E.events_of(T)), t=sse(*events)) == expected


def test_tool_calls_interleaved(value):
    got = calls(
        value, tool_start(1, "a"), tool_start(2, "b"), tool_delta(1, '{"x"'), tool_delta(2, "{}"), tool_delta(1, ":1}")
    )
    assert got == [("id-a", "a", '{"x":1}'), ("id-b", "b", "{}")]


def test_tool_call_input_in_start(value):
    assert calls(value, tool_start(0, "a", {"k": "é"})) == [("id-a", "a", '{"k":"é"}')]


def test_orphan_delta_opens_a_block(value):
    assert calls(value, tool_delta(4, "{}"), tool_delta(4, "!")) == [("", "", "{}!")]


def test_missing_index_is_the_number_of_blocks(value):
    got = calls(value, tool_start(None, "a"), tool_start(None, "b"), tool_delta(None, "x"), tool_delta(1, "y"))
    # the third event opens block 2; block 1 is the second tool
    assert got == [("id-a", "a", ""), ("id-b", "b", "y"), ("", "", "x")]


def test_second_start_resets_and_is_listed_twice(value):
    got = calls(value, tool_start(0, "a"), tool_delta(0, "old"), tool_start(0, "b"), tool_delta(0, "new"))
    assert got == [("id-b", "b", "new"), ("id-b", "b", "new")]


def test_block_count(value):
    assert value(lambda T: E.count_blocks(E.events_of(T)), t=sse(start_text(), delta("x"), tool_start(1))) == 2


def test_sniff(value):
    plain = json.dumps({"content": [{"type": "text", "text": "about message_start events\ndata: x"}]})
    assert value(lambda T: E.looks_streaming(T), t=plain) is False
    assert value(lambda T: E.looks_streaming(T, compat=True), t=plain) is True
    assert value(lambda T: E.looks_streaming(T), t=sse(delta("x"))) is True
    assert value(lambda T: E.looks_streaming(T), t=sse({"type": "ping"})) is False


def repaired(value, text):
    return value(lambda T: E.repair_lines(T), t=text)


def test_repair_adds_names_and_tokens(value):
    text = 'data: {"type":"ping"}\n\nevent: message_delta\ndata: {"type":"message_delta","usage":{"output_tokens":3}}\n: x'
    lines = repaired(value, text).split("\n")
    assert lines[:4] == ["event: ping", 'data: {"type":"ping"}', "", "event: message_delta"]
    assert json.loads(lines[4][6:]) == {"type": "message_delta", "usage": {"output_tokens": 3, "input_tokens": 1}}
    assert lines[5:] == [": x"]


@pytest.mark.parametrize(
    "line",
    [
        "data: not json", "data: {}", 'event: a\ndata: {"type":"b"}',
        'event: message_delta\ndata: {"type":"message_delta","usage":{"input_tokens":2,"output_tokens":3}}',
        'event: message_delta\ndata: {"type":"message_delta","usage":{"x":3}}', "", "other",
    ],
)
def test_repair_leaves_the_rest(value, line):
    assert repaired(value, line) == line


def test_second_data_line_of_a_frame_gets_its_own_name(value):
    text = 'event: a\ndata: {"type":"a"}\ndata: {"type":"b"}'
    assert repaired(value, text) == 'event: a\ndata: {"type":"a"}\nevent: b\ndata: {"type":"b"}'


# ------------------------------------------------------------------ plain replies

def test_view_of_plain_replies(value):
    def view(text):
        r = value(lambda T: R.plain_reply_view(T), t=text)
        return r.text, r.thinking, len(r.tool_calls), r.stop_reason

    blocks = [{"type": "text", "text": "a"}, 5, {"type": "tool_use", "id": "i", "name": "n", "input": {"k": 1}},
              {"type": "thinking", "thinking": "t"}, {"type": "text", "text": "b"}]
    assert view(json.dumps({"content": blocks, "stop_reason": "x"})) == ("ab", "t", 1, "x")
    assert view("x" * 600) == ("x" * 600, "", 0, None)
    assert view("[1]") == ("[1]", "", 0, None)


def test_clean_rule_prefers_json_then_events(value):
    def clean(text):
        r = value(lambda T: R.plain_reply_clean(T), t=text)
        return r and (r.text, r.thinking)

    said = {"content": [{"type": "text", "text": "hi"}]}
    assert clean(json.dumps(said)) == ("hi", "")
    assert clean(json.dumps({"content": []})) is None
    assert clean("no json") is None
    assert clean("[1, 2]") is None
    assert clean(sse({"type": "message", **said})) == ("hi", "")
    assert clean(sse({"type": "message", "content": []})) == ("", "")
    assert clean(sse({"type": "message_start", "message": {"content": []}}, {"type": "message", **said})) == ("hi", "")
    assert clean(sse({"type": "message_start", "message": said})) == ("hi", "")


def test_parse_object_is_strict_about_the_ends(value):
    for text, found in [('{"a":1}', True), (' {"a":1}\n', True), ('{"a":1} x', False), ("[1]", False), ('{"a":1', False)]:
        assert value(lambda T: V.parse_object(T).isNotNull(), t=text) is found, text


def test_a_tab_behind_the_mark(value):
    event = json.dumps(delta("tabbed"))
    assert value(lambda t: E.rebuild_text(E.events_of(t)), text=f"data:\t{event}\n\ndata: \t{event}\t\n\n") == "tabbedtabbed"


def test_long_replies_are_folded_in_one_pass(value):
    changes = "".join(f'data: {{"type":"message_delta","delta":{{}},"usage":{{"output_tokens":{n}}}}}\n\n' for n in range(8000))
    calls = "".join(
        f'data: {{"type":"content_block_start","index":{n},"content_block":{{"type":"tool_use","id":"t{n}","name":"f","input":{{}}}}}}\n\n'
        f'data: {{"type":"content_block_delta","index":{n},"delta":{{"type":"input_json_delta","partial_json":"{n}"}}}}\n\n' for n in range(3000)
    )
    started = time.time()
    usage = value(lambda t: F.to_json(E.rebuild_usage(E.events_of(t))), text=changes)
    middle = time.time()
    got = value(lambda t: E.rebuild_tool_calls(E.events_of(t)), text=calls)
    assert usage == '{"output_tokens":7999}'
    assert [(c.id, c.input_json) for c in got] == [(f"t{n}", str(n)) for n in range(3000)]
    assert middle - started < 10 and time.time() - middle < 10


def test_many_tool_calls_in_one_reply(value):
    frames, lacking = [], []
    for n in range(12_000):
        for event in (
            {"type": "content_block_start", "content_block": {"type": "tool_use", "id": f"t{n}", "name": "f", "input": {}}},
            {"type": "content_block_delta", "delta": {"type": "input_json_delta", "partial_json": f'{{"n":{n}}}'}},
        ):
            frames.append({**event, "index": n})
            lacking.append(event)
    started = time.time()
    calls = value(lambda text: E.rebuild_tool_calls(E.events_of(text)), text=sse(*frames))
    assert [(c.id, c.input_json) for c in calls] == [(f"t{n}", f'{{"n":{n}}}') for n in range(12_000)]
    assert len(value(lambda text: E.rebuild_tool_calls(E.events_of(text)), text=sse(*lacking))) == 24_000
    assert time.time() - started < 60
