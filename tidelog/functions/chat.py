"""Requests of one chat schema rewritten to another, as Column expressions.

Input is the request body as VARIANT: ``content`` and ``system`` may each be a
string or an array of typed blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import variants as V

# Text that marks a block to drop, stand-in for hidden reasoning.
BILLING_PREFIX = "x-anthropic-billing-header"
REDACTED = "[redacted thinking]"
DEFAULT_MEDIA_TYPE = "image/jpeg"
DEFAULT_PARAMETERS = '{"type":"object"}'


@dataclass(frozen=True)
class Profile:
    """Where the two conversions of the same request differ."""

    system_separator: str
    drop_billing: bool
    keep_empty_text: bool
    images: bool
    tool_parts: bool
    redacted: bool
    tool_messages: bool = False


VIEWER = Profile("\n\n", False, True, False, True, True)
CONVERTER = Profile("", True, False, True, False, False)
# tool calls as fields of the assistant's message, results as messages of their own
AGENT = Profile("", True, False, True, True, False, tool_messages=True)

PART_TYPE = (
    "STRUCT<type: STRING, text: STRING, url: STRING, id: STRING, name: STRING, "
    "input: STRING, tool_use_id: STRING, content: STRING>"
)
MESSAGE_TYPE = (
    f"STRUCT<role: STRING, content_text: STRING, content_parts: ARRAY<{PART_TYPE}>, reasoning: STRING>"
)
AGENT_MESSAGE_TYPE = (
    MESSAGE_TYPE[:-1] + ", tool_calls: ARRAY<STRUCT<id: STRING, name: STRING, arguments: STRING>>, tool_call_id: STRING>"
)


def _nothing() -> Column:
    return F.lit(None).cast("string")


def _part(kind: str, **fields: Column) -> Column:
    names = ("text", "url", "id", "name", "input", "tool_use_id", "content")
    given = [fields.get(name, _nothing()).alias(name) for name in names]
    return F.struct(F.lit(kind).alias("type"), *given).cast(PART_TYPE)


def _blank(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _system_texts(source: Column, profile: Profile) -> Column:
    """Texts of a string or block-array value as ARRAY<STRING>."""

    def text(block: Column) -> Column:
        found = V.text_of(block, "text")
        wanted = V.text_of(block, "type") == "text"
        if profile.keep_empty_text:
            return F.when(wanted, _blank(found))
        wanted = wanted & (found != "")
        return F.when(wanted & ~F.startswith(found, F.lit(BILLING_PREFIX)), found)

    from_blocks = F.filter(F.transform(V.items(source), text), lambda t: t.isNotNull())
    as_string = V.plain_string(source)
    return F.coalesce(from_blocks, F.when(as_string.isNotNull(), F.array(as_string)), F.array().cast("array<string>"))


def is_system(message: Column) -> Column:
    return V.text_of(message, "role").eqNullSafe("system")


def system_parts(body: Column, profile: Profile) -> Column:
    """Top-level parts, then the parts of system messages, in order."""
    top_source = V.get(body, "system", "variant")
    top = F.filter(
        _system_texts(top_source, profile),
        # an empty top-level string counts as no system at all
        lambda t: (t != "") | V.items(top_source).isNotNull(),
    )
    inline = F.flatten(
        F.transform(
            F.filter(V.items(body, "messages"), is_system),
            lambda m: F.when(V.has_key(m, "", "content"), _system_texts(V.get(m, "content", "variant"), profile))
            .otherwise(F.array(F.lit(""))),
        )
    )
    return F.concat(top, F.coalesce(inline, F.array().cast("array<string>")))


def merge_system(body: Column, profile: Profile) -> Column:
    """Text of the leading system message; NULL when there is none."""
    return V.bind(
        system_parts(body, profile),
        lambda parts: F.when(
            (F.size(parts) > 0)
            & (F.lit(profile.keep_empty_text) | (F.array_join(parts, "") != "")),
            F.array_join(parts, profile.system_separator),
        ),
    )


def image_url(block: Column) -> Column:
    """Plain URL, or a data URL of inline bytes."""
    inline = F.concat(
        F.lit("data:"), F.coalesce(V.text_of(block, "source.media_type"), F.lit(DEFAULT_MEDIA_TYPE)),
        F.lit(";base64,"), _blank(V.text_of(block, "source.data")),
    )
    return F.when(V.text_of(block, "source.type") == "url", _blank(V.text_of(block, "source.url"))).otherwise(inline)


def _convert_block(block: Column, profile: Profile) -> Column:
    kind = V.text_of(block, "type")
    text = V.text_of(block, "text")
    keep_text = kind == "text" if profile.keep_empty_text else (kind == "text") & (text != "")
    out = F.when(keep_text, _part("text", text=_blank(text)))
    if profile.images:
        has_source = V.truthy(block, "source")
        out = out.when((kind == "image") & has_source, _part("image_url", url=image_url(block)))
    if profile.tool_parts:
        given = V.get(block, "input", "variant")
        result = V.get(block, "content", "variant")
        out = out.when(
            kind == "tool_use",
            _part(
                "tool_use", id=_blank(V.text_of(block, "id")), name=_blank(V.text_of(block, "name")),
                input=F.coalesce(F.to_json(given), F.lit("{}")),
            ),
        ).when(
            kind == "tool_result",
            _part(
                "tool_result", tool_use_id=_blank(V.text_of(block, "tool_use_id")),
                content=F.coalesce(F.to_json(result), F.lit('""')),
            ),
        )
    return out


def _reasoning(blocks: Column, profile: Profile) -> Column:
    def piece(block: Column) -> Column:
        kind = V.text_of(block, "type")
        thought = V.text_of(block, "thinking")
        if not profile.redacted:
            return F.when(kind == "thinking", thought)
        return F.when(kind == "thinking", _blank(thought)).when(kind == "redacted_thinking", F.lit(REDACTED))

    pieces = F.filter(F.transform(blocks, piece), lambda p: p.isNotNull())
    return F.when(F.size(pieces) > 0, F.array_join(pieces, ""))


def _convert_message(message: Column, profile: Profile) -> Column:
    """Content and blocks are taken out of the message once and bound."""
    given = F.struct(
        F.when(V.has_key(message, "", "content"), V.plain_string(V.get(message, "content", "variant")))
        .otherwise(F.lit("")).alias("as_string"),
        F.filter(V.items(message, "content"), V.is_object).alias("blocks"),
    )

    def with_parts(content: Column) -> Column:
        parts = F.filter(
            F.transform(content["blocks"], lambda b: _convert_block(b, profile)), lambda p: p.isNotNull()
        )
        return V.bind(parts, lambda found: build(content, found))

    def build(content: Column, found: Column) -> Column:
        only_text = (F.size(found) == 1) & (F.get(found, 0)["type"] == "text")
        role = V.text_of(message, "role")
        return F.struct(
            (F.coalesce(role, F.lit("")) if profile is VIEWER else role).alias("role"),
            F.coalesce(content["as_string"], F.when(only_text, F.get(found, 0)["text"])).alias("content_text"),
            F.when((F.size(found) > 0) & ~only_text, found).alias("content_parts"),
            _reasoning(content["blocks"], profile).alias("reasoning"),
        ).cast(MESSAGE_TYPE)

    return V.bind(given, with_parts)


def convert_messages(body: Column, profile: Profile) -> Column:
    """ARRAY of messages without the system ones; user messages left empty are dropped."""
    turns = F.filter(V.items(body, "messages"), lambda m: ~is_system(m))
    converted = F.transform(turns, lambda m: _convert_message(m, profile))
    kept = F.filter(
        converted,
        lambda m: ~(
            m["role"].eqNullSafe("user") & m["content_text"].isNull() & m["content_parts"].isNull()
        ),
    )
    return F.coalesce(kept, F.array().cast(f"array<{MESSAGE_TYPE}>"))


def _result_text(content: Column) -> Column:
    """Text of a tool result: a string, the text blocks of an array on lines of their own, else its JSON."""

    def read(result: Column) -> Column:
        texts = F.filter(F.transform(V.items(result), lambda b: V.text_of(b, "text")), lambda t: t.isNotNull())
        return F.coalesce(V.plain_string(result), F.when(F.size(texts) > 0, F.array_join(texts, "\n")), content)

    return V.bind(F.try_parse_json(content), read)


def _agent_message(role, text, parts, reasoning, calls, call_id) -> Column:
    return F.struct(
        role.alias("role"), text.alias("content_text"), parts.alias("content_parts"), reasoning.alias("reasoning"),
        calls.alias("tool_calls"), call_id.alias("tool_call_id"),
    ).cast(AGENT_MESSAGE_TYPE)


def tool_messages(messages: Column) -> Column:
    """Messages with tool parts as messages with tool calls: a call moves into ``tool_calls`` of its
    message, a result becomes a message of role ``tool`` in front of what else its turn says."""

    def split(m: Column) -> Column:
        parts = F.coalesce(m["content_parts"], F.array().cast(f"array<{PART_TYPE}>"))
        uses = F.filter(parts, lambda p: p["type"] == "tool_use")
        results = F.transform(
            F.filter(parts, lambda p: p["type"] == "tool_result"),
            lambda p: _agent_message(F.lit("tool"), _result_text(p["content"]), F.lit(None), F.lit(None), F.lit(None), p["tool_use_id"]),
        )
        calls = F.transform(uses, lambda p: F.struct(p["id"].alias("id"), p["name"].alias("name"), p["input"].alias("arguments")))

        def own(rest: Column) -> Column:
            single = (F.size(rest) == 1) & (F.get(rest, 0)["type"] == "text")
            text = F.coalesce(m["content_text"], F.when(single, F.get(rest, 0)["text"]))
            several = F.when((F.size(rest) > 0) & ~single, rest)
            message = _agent_message(m["role"], text, several, m["reasoning"], F.when(F.size(uses) > 0, calls), F.lit(None))
            empty = (F.size(results) > 0) & text.isNull() & (F.size(rest) == 0) & (F.size(uses) == 0)
            return F.when(empty, results).otherwise(F.concat(results, F.array(message)))

        return V.bind(F.filter(parts, lambda p: ~p["type"].isin("tool_use", "tool_result")), own)

    return F.flatten(F.transform(messages, split))


def with_system(body: Column, profile: Profile) -> Column:
    """System message first, when there is one, then the converted turns."""

    def lead(text: Column) -> Column:
        first = F.struct(
            F.lit("system").alias("role"), text.alias("content_text"),
            F.lit(None).cast(f"array<{PART_TYPE}>").alias("content_parts"), _nothing().alias("reasoning"),
        ).cast(MESSAGE_TYPE)
        return F.when(text.isNotNull(), F.array(first)).otherwise(F.array().cast(f"array<{MESSAGE_TYPE}>"))

    found = F.concat(V.bind(merge_system(body, profile), lead), convert_messages(body, profile))
    return tool_messages(found) if profile.tool_messages else found


def convert_tools(body: Column) -> Column:
    """Tools as ARRAY<STRING> of JSON; NULL when there are none. Converted ones pass."""

    def convert(tool: Column) -> Column:
        function = F.struct(
            _blank(V.text_of(tool, "name")).alias("name"),
            _blank(V.text_of(tool, "description")).alias("description"),
            F.coalesce(V.get(tool, "input_schema", "variant"), F.parse_json(F.lit(DEFAULT_PARAMETERS))).alias(
                "parameters"
            ),
        )
        wrapped = F.to_json(F.struct(F.lit("function").alias("type"), function.alias("function")))
        return F.when(V.has_key(tool, "", "function"), F.to_json(tool)).otherwise(wrapped)

    tools = V.items(body, "tools")
    return F.when(F.size(tools) > 0, F.transform(tools, convert))


def convert_tool_choice(body: Column) -> Column:
    """``auto``, ``required``, ``none``, the JSON of a named function, or NULL."""
    choice = V.get(body, "tool_choice", "variant")
    kind = F.coalesce(V.text_of(choice, "type"), V.plain_string(choice))
    default = F.when(F.size(V.items(body, "tools")) > 0, F.lit("auto"))
    named = F.to_json(
        F.struct(
            F.lit("function").alias("type"),
            F.struct(_blank(V.text_of(choice, "name")).alias("name")).alias("function"),
        )
    )
    return (
        F.when(kind == "auto", F.lit("auto"))
        .when(kind == "any", F.lit("required"))
        .when(kind == "none", F.lit("none"))
        .when((kind == "tool") & V.is_object(choice), named)
        .otherwise(default)
    )


def request_scalars(body: Column) -> dict[str, Column]:
    """Optional settings; NULL means the converted request leaves the key out."""
    limit = V.get(body, "max_tokens", "bigint")
    stop = V.get(body, "stop_sequences", "variant")
    return {
        "max_tokens": F.when(limit != 0, limit),
        "temperature": V.get(body, "temperature", "double"),
        "top_p": V.get(body, "top_p", "double"),
        "stop": F.when(V.truthy(body, "stop_sequences"), F.to_json(stop)),
    }


def message_text(message: Column) -> Column:
    """Visible text of a converted message."""
    texts = F.transform(message["content_parts"], lambda p: F.when(p["type"] == "text", p["text"]))
    return F.coalesce(message["content_text"], F.array_join(texts, ""), F.lit(""))


def tool_text(message: Column) -> Column:
    """Calls of a message as the prompt shows them, one JSON object a line; empty without any."""

    def show(call: Column) -> Column:
        whole = F.struct(call["name"].alias("name"), F.try_parse_json(call["arguments"]).alias("arguments"))
        return F.concat(F.lit("\n<tool_call>"), F.to_json(whole), F.lit("</tool_call>"))

    return F.coalesce(F.array_join(F.transform(message["tool_calls"], show), ""), F.lit(""))


# Fixed values of the prompt format.
TURN = "▌"
THINK_OPEN = "▌thinking\n"
THINK_SKIPPED = "▌thinking\n\n▌end_of_thought\n\n"
TOOLS_HEAD = "# Tools\n\nYou have access to the following functions:\n\n<tools>"
TOOLS_TAIL = "\n</tools>"
TOOL_INSTRUCTIONS = "[tool call format instructions]..."


def render_prompt(
    messages: Column, tools: Column, generation: bool = True, thinking: bool = True,
    instructions: str = TOOL_INSTRUCTIONS, tools_shown: bool = False,
) -> Column:
    """Prompt text of converted messages: text, and with ``tools_shown`` calls and results.

    Tools go in front of the system text, inside the system section.
    """
    first = F.get(messages, 0)
    led = F.coalesce(first["role"] == "system", F.lit(False))
    system = F.trim(message_text(first), F.lit(" \t\r\n"))
    preamble = F.concat(
        F.lit(f"{TURN}system\n{TOOLS_HEAD}"),
        F.array_join(F.transform(tools, lambda t: F.concat(F.lit("\n"), t)), ""),
        F.lit(f"{TOOLS_TAIL}\n\n{instructions}"),
        F.when(led & (system != ""), F.concat(F.lit("\n\n"), system)).otherwise(""),
        F.lit(f"{TURN}\n"),
    )
    plain = F.when(led, F.concat(F.lit(f"{TURN}system\n"), system, F.lit(f"{TURN}\n"))).otherwise("")
    turns = F.filter(messages, lambda m: m["role"] != "system")
    body = F.array_join(
        F.transform(
            turns, lambda m: F.concat(F.lit(TURN), m["role"], F.lit("\n"), message_text(m), tool_text(m) if tools_shown else F.lit(""), F.lit(f"{TURN}\n"))
        ),
        "",
    )
    suffix = f"{TURN}assistant\n" + (THINK_OPEN if thinking else THINK_SKIPPED) if generation else ""
    return F.concat(F.coalesce(preamble, plain), body, F.lit(suffix))
