import json

import pytest
from pyspark.sql import functions as F

from tidelog.functions import chat as C
from tidelog.functions import variants as V
from tidelog.operators import turns


@pytest.fixture()
def on(value):
    """Evaluate an expression of the parsed body."""

    def run(make, body):
        return value(lambda t: make(V.parse_object(t)), t=json.dumps(body))

    return run


def messages(on, profile, *msgs):
    out = on(lambda b: C.convert_messages(b, profile), {"messages": list(msgs)})
    return [(m.role, m.content_text, m.content_parts and [p.type for p in m.content_parts], m.reasoning) for m in out]


def user(content):
    return {"role": "user", "content": content}


def text(t):
    return {"type": "text", "text": t}


@pytest.mark.parametrize("profile", [C.VIEWER, C.CONVERTER])
def test_simple_content(on, profile):
    assert messages(on, profile, user("hi")) == [("user", "hi", None, None)]
    assert messages(on, profile, user("")) == [("user", "", None, None)]
    assert messages(on, profile, user([text("hi")])) == [("user", "hi", None, None)]
    assert messages(on, profile, user([text("a"), 5, "x", text("b")])) == [("user", None, ["text", "text"], None)]
    assert messages(on, profile, {"role": "system", "content": "s"}, user("q")) == [("user", "q", None, None)]


def test_empty_text_block(on):
    assert messages(on, C.VIEWER, user([text("")])) == [("user", "", None, None)]
    assert messages(on, C.CONVERTER, user([text("")])) == []


@pytest.mark.parametrize("profile", [C.VIEWER, C.CONVERTER])
def test_thinking_goes_to_reasoning(on, profile):
    thought = {"type": "thinking", "thinking": "hm"}
    assert messages(on, profile, {"role": "assistant", "content": [thought, thought]}) == [("assistant", None, None, "hmhm")]
    assert messages(on, profile, {"role": "user", "content": [thought]}) == []
    assert messages(on, profile, {"role": "user", "content": None}) == []


def test_hidden_thinking(on):
    hidden = {"role": "assistant", "content": [{"type": "redacted_thinking", "data": "x"}, text("a")]}
    assert messages(on, C.VIEWER, hidden) == [("assistant", "a", None, "[redacted thinking]")]
    assert messages(on, C.CONVERTER, hidden) == [("assistant", "a", None, None)]


def test_tool_parts(on):
    use = {"type": "tool_use", "id": "i", "name": "n", "input": {"k": [1]}}
    result = {"type": "tool_result", "tool_use_id": "i", "content": [text("out")]}
    got = on(lambda b: C.convert_messages(b, C.VIEWER), {"messages": [user([use, result])]})[0].content_parts
    assert [(p.type, p.id or p.tool_use_id, p.input or p.content) for p in got] == [
        ("tool_use", "i", '{"k":[1]}'), ("tool_result", "i", '[{"text":"out","type":"text"}]')
    ]
    # one tool part is never simplified to a string
    assert messages(on, C.VIEWER, user([use])) == [("user", None, ["tool_use"], None)]
    assert messages(on, C.CONVERTER, user([use, text("a")])) == [("user", "a", None, None)]


@pytest.mark.parametrize(
    "source, url",
    [
        ({"type": "url", "url": "http://x"}, "http://x"), ({"type": "url"}, ""),
        ({"type": "base64", "media_type": "image/png", "data": "QQ"}, "data:image/png;base64,QQ"),
        ({"type": "base64", "data": "QQ"}, "data:image/jpeg;base64,QQ"),
    ],
)
def test_images(on, source, url):
    body = {"messages": [user([{"type": "image", "source": source}])]}
    assert on(lambda b: C.convert_messages(b, C.CONVERTER), body)[0].content_parts[0].url == url
    assert on(lambda b: C.convert_messages(b, C.VIEWER), body) == []


def test_image_without_source(on):
    assert messages(on, C.CONVERTER, user([{"type": "image", "source": {}}])) == []


BILL = text("x-anthropic-billing-header: 1")


@pytest.mark.parametrize(
    "body, viewer, converter",
    [
        ({}, None, None),
        ({"system": ""}, None, None),
        ({"system": "a"}, "a", "a"),
        ({"system": [BILL, text("a"), {"type": "image"}, text("b")]}, BILL["text"] + "\n\na\n\nb", "ab"),
        ({"system": "a", "messages": [user("q"), {"role": "system", "content": [BILL, text("b")]}]},
         "a\n\n" + BILL["text"] + "\n\nb", "ab"),
        ({"system": [text("")]}, "", None),
        ({"system": "x-anthropic-billing-header"}, "x-anthropic-billing-header", "x-anthropic-billing-header"),
        ({"messages": [{"role": "system"}, {"role": "system", "content": "c"}]}, "\n\nc", "c"),
    ],
)
def test_system(on, body, viewer, converter):
    assert on(lambda b: C.merge_system(b, C.VIEWER), body) == viewer
    assert on(lambda b: C.merge_system(b, C.CONVERTER), body) == converter


def test_system_leads_the_messages(on):
    got = on(lambda b: C.with_system(b, C.CONVERTER), {"system": "s", "messages": [user("q")]})
    assert [(m.role, m.content_text) for m in got] == [("system", "s"), ("user", "q")]


def test_tools(on):
    done = {"type": "function", "function": {"name": "d"}}
    got = on(C.convert_tools, {"tools": [{"name": "n", "description": "x", "input_schema": {"type": "object", "a": 1}}, {"name": "m"}, done]})
    assert [json.loads(t) for t in got] == [
        {"type": "function", "function": {"name": "n", "description": "x", "parameters": {"type": "object", "a": 1}}},
        {"type": "function", "function": {"name": "m", "description": "", "parameters": {"type": "object"}}}, done,
    ]
    assert on(C.convert_tools, {"tools": []}) is None
    assert on(C.convert_tools, {}) is None


@pytest.mark.parametrize(
    "body, choice",
    [
        ({}, None), ({"tools": [{"name": "n"}]}, "auto"), ({"tool_choice": {"type": "auto"}}, "auto"),
        ({"tool_choice": {"type": "any"}}, "required"), ({"tool_choice": {"type": "none"}}, "none"),
        ({"tool_choice": "any"}, "required"), ({"tool_choice": {"type": "odd"}}, None),
        ({"tool_choice": {"type": "odd"}, "tools": [{"name": "n"}]}, "auto"),
        ({"tool_choice": {"type": "tool", "name": "n"}}, '{"type":"function","function":{"name":"n"}}'),
    ],
)
def test_tool_choice(on, body, choice):
    assert on(C.convert_tool_choice, body) == choice


def test_scalars(on):
    def all_of(body):
        return on(lambda b: F.struct(*[c.alias(n) for n, c in C.request_scalars(b).items()]), body).asDict()

    none = {"max_tokens": None, "temperature": None, "top_p": None, "stop": None}
    assert all_of({}) == none
    assert all_of({"max_tokens": 0, "temperature": None, "stop_sequences": []}) == none
    assert all_of({"max_tokens": 5, "temperature": 0, "top_p": 0.5, "stop_sequences": ["a"]}) == {
        "max_tokens": 5, "temperature": 0.0, "top_p": 0.5, "stop": '["a"]'
    }


def prompt(on, body, **options):
    return on(lambda b: C.render_prompt(C.with_system(b, C.CONVERTER), C.convert_tools(b), **options), body)


def test_prompt(on):
    body = {"system": " You are kind. ", "messages": [user([text("He"), text("llo")])]}
    turns_text = "▌system\nYou are kind.▌\n▌user\nHello▌\n"
    assert prompt(on, body) == turns_text + "▌assistant\n▌thinking\n"
    assert prompt(on, body, thinking=False) == turns_text + "▌assistant\n▌thinking\n\n▌end_of_thought\n\n"
    assert prompt(on, body, generation=False) == turns_text
    assert prompt(on, {"messages": [user("q")]}, generation=False) == "▌user\nq▌\n"


def test_prompt_with_tools(on):
    got = prompt(on, {"system": "S", "messages": [user("q")], "tools": [{"name": "n"}]}, generation=False, instructions="I")
    tool = '{"type":"function","function":{"name":"n","description":"","parameters":{"type":"object"}}}'
    assert got == (
        "▌system\n# Tools\n\nYou have access to the following functions:\n\n<tools>\n" + tool + "\n</tools>\n\nI\n\nS▌\n▌user\nq▌\n"
    )


def test_converted_json(spark):
    body = {
        "model": "m", "system": "s", "max_tokens": 5, "tools": [{"name": "n"}], "tool_choice": {"type": "tool", "name": "n"},
        "messages": [user([text("a"), {"type": "image", "source": {"type": "url", "url": "u"}}])],
    }
    df = spark.createDataFrame([(1, json.dumps(body))], "seq_id BIGINT, body_text STRING")
    got = json.loads(turns.converted_json(turns.convert_requests(df)).first().openai_request)
    assert got == {
        "model": "m", "max_tokens": 5,
        "messages": [
            {"role": "system", "content": "s"},
            {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image_url", "image_url": {"url": "u"}}]},
        ],
        "tools": [{"type": "function", "function": {"name": "n", "description": "", "parameters": {"type": "object"}}}],
        "tool_choice": {"type": "function", "function": {"name": "n"}},
    }


def test_convert_stats_of_nothing(spark):
    df = spark.createDataFrame([(1, "not json")], "seq_id BIGINT, body_text STRING")
    assert tuple(turns.convert_stats(df).first()) == (1, None, 0, 0, 0, 0, 0)


def test_tail_turns(spark):
    def flags(n):
        body = json.dumps({"messages": [user(str(i)) for i in range(n)]})
        df = spark.createDataFrame([(1, body)], "seq_id BIGINT, body_text STRING")
        return [r.earlier for r in turns.tail_turns(df).orderBy("turn").collect()]

    assert flags(4) == [False] * 4
    assert flags(6) == [True] * 3 + [False] * 3


def test_tool_fields(spark):
    given = {"s": "é😀", "n": 1.5, "b": True, "z": None, "a": [1, 2], "o": {"k": 1, "l": 2}, "e": {}}
    df = spark.createDataFrame([(1, json.dumps(given))], "seq_id BIGINT, input_json STRING")
    got = {r.key: (r.type_label, r.field_count) for r in turns.tool_fields(df).collect()}
    assert got == {
        "s": ("string (2)", None), "n": ("number", None), "b": ("boolean", None), "z": ("null", None),
        "a": ("array [2]", None), "o": ("object", 2), "e": ("object", 0),
    }
