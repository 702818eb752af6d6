"""Requests opened up: turns, tools, details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chat as C
from ..functions import variants as V
from ..functions.memo import once_per_application


def parsed_body(decoded: DataFrame) -> DataFrame:
    return decoded.withColumn("body_json", V.parse_object(F.col("body_text")))


def _turn_text(message: Column) -> Column:
    content = V.get(message, "content", "variant")
    blocks = F.filter(V.items(content), V.is_object)
    texts = F.transform(blocks, lambda b: F.coalesce(V.text_of(b, "text"), F.lit("")))
    return F.coalesce(V.plain_string(content), F.array_join(texts, " "), F.lit(""))


def explode_turns(decoded: DataFrame, head: int = 120) -> DataFrame:
    """One row per turn; block texts are joined by a space."""
    turns = parsed_body(decoded).select("seq_id", F.posexplode(V.items(F.col("body_json"), "messages")).alias("turn", "m"))
    return turns.select(
        "seq_id", "turn",
        F.coalesce(V.text_of(F.col("m"), "role"), F.lit("?")).alias("role"),
        _turn_text(F.col("m")).alias("text"),
    ).withColumn("head", F.left("text", F.lit(head)))


def tail_turns(decoded: DataFrame, n: int = 3, threshold: int = 4) -> DataFrame:
    """Turns of the converted request; in long ones all but the last ``n`` are ``earlier``.

    The list sits in one cell, so its size is known without a window.
    """
    messages = C.convert_messages(F.col("body_json"), C.VIEWER)
    listed = parsed_body(decoded).select("seq_id", F.explode(F.array(messages)).alias("ms"))
    count = F.size("ms")
    return (
        listed.select("seq_id", count.alias("turns"), F.posexplode("ms").alias("turn", "m"))
        .select(
            "seq_id", "turn", F.col("m.role").alias("role"),
            ((F.col("turns") > threshold) & (F.col("turn") < F.col("turns") - n)).alias("earlier"),
        )
    )


def tool_catalog(decoded: DataFrame) -> DataFrame:
    """One row per offered tool, in either schema."""
    tools = V.items(F.col("body_json"), "tools")
    listed = parsed_body(decoded).select(
        "seq_id", F.size(tools).alias("tool_count"), F.posexplode(tools).alias("pos", "tool")
    )
    tool = F.col("tool")
    wrapped = V.truthy(tool, "function")
    plain_name = F.when(V.text_of(tool, "name") != "", V.text_of(tool, "name")).otherwise("?")
    return listed.select(
        "seq_id", F.col("tool_count").cast("bigint").alias("tool_count"), "pos",
        F.when(wrapped, V.text_of(tool, "function.name")).otherwise(plain_name).alias("name"),
        F.when(wrapped, F.coalesce(V.text_of(tool, "function.description"), F.lit("")))
        .otherwise(F.coalesce(V.text_of(tool, "description"), F.lit(""))).alias("description"),
    )


def tool_fields(calls: DataFrame, json_column: str = "input_json") -> DataFrame:
    """Fields of a tool input: key, type label and the number of fields of an object."""
    whole = V.parse_object(F.col(json_column))
    others = [c for c in calls.columns if c != json_column]
    fields = calls.select(*others, F.explode(V.entries(whole)).alias("key", "value"))
    value = F.col("value")
    kind = F.when(V.items(value).isNotNull(), F.lit("array")).when(V.is_object(value), F.lit("object")).otherwise(
        F.schema_of_variant(value)
    )
    label = (
        F.when(kind == "array", F.concat(F.lit("array ["), F.size(V.items(value)).cast("string"), F.lit("]")))
        .when(kind == "object", F.lit("object"))
        .when(kind == "VOID", F.lit("null"))
        .when(kind == "STRING", F.concat(F.lit("string ("), F.length(V.text_of(value, "")).cast("string"), F.lit(")")))
        .when(kind == "BOOLEAN", F.lit("boolean"))
        .otherwise("number")
    )
    return fields.select(
        *others, "key", label.alias("type_label"),
        F.when(kind == "object", F.size(V.entries(value))).cast("bigint").alias("field_count"),
    )


def convert_requests(decoded: DataFrame, profile: C.Profile = C.AGENT) -> DataFrame:
    """Add the converted request: system, messages (system first), tools, tool_choice, settings.

    By default tool calls and results are kept, in the target schema's form.
    """
    return parsed_body(decoded).select(*decoded.columns, "body_json", *_converted(profile))


@once_per_application
def _converted(profile: C.Profile) -> list[Column]:
    body = F.col("body_json")
    return [
        F.coalesce(V.text_of(body, "model"), F.lit("")).alias("request_model"),
        C.merge_system(body, profile).alias("system_text"),
        C.with_system(body, profile).alias("messages"),
        C.convert_tools(body).alias("tools"),
        C.convert_tool_choice(body).alias("tool_choice"),
        *[column.alias(name) for name, column in C.request_scalars(body).items()],
    ]


@once_per_application
def _shown() -> list[Column]:
    body = F.col("body_json")
    return [
        C.convert_messages(body, C.VIEWER).alias("messages"),
        C.convert_tools(body).alias("tools"),
        F.coalesce(C.merge_system(body, C.VIEWER), F.lit("")).alias("system_prompt"),
    ]


def convert_stats(decoded: DataFrame, profile: C.Profile = C.CONVERTER) -> DataFrame:
    """Sizes before and after conversion."""
    return convert_requests(decoded, profile).select("seq_id", *source_facts())


def source_facts() -> list[Column]:
    """Of a converted request: its model and sizes before and after."""
    body = F.col("body_json")
    system = V.get(body, "system", "variant")
    blocks = F.coalesce(F.size(V.items(system)), F.when(V.truthy(body, "system"), F.lit(1)).otherwise(0))

    def count(column: Column) -> Column:
        return F.coalesce(column, F.lit(0)).cast("bigint")

    return [
        V.text_of(body, "model").alias("original_model"),
        count(F.size(V.items(body, "messages"))).alias("original_messages_count"),
        blocks.cast("bigint").alias("original_system_blocks"),
        count(F.size(V.items(body, "tools"))).alias("original_tools_count"),
        count(F.length("system_text")).alias("converted_system_length"),
        count(F.size("messages")).alias("converted_messages_count"),
    ]


def converted_json(converted: DataFrame, *keep: str | Column) -> DataFrame:
    """The converted request as one JSON text per row, keys left out where there is no value.

    ``keep``: further columns of the result.
    """
    has_tools = "tool_calls" in converted.schema["messages"].dataType.elementType.names

    def call(c: Column) -> Column:
        function = F.struct(c["name"].alias("name"), c["arguments"].alias("arguments"))
        return F.struct(c["id"].alias("id"), F.lit("function").alias("type"), function.alias("function"))

    def part(p: Column) -> Column:
        image = F.struct(F.lit("image_url").alias("type"), F.struct(p["url"].alias("url")).alias("image_url"))
        plain = F.struct(
            p["type"].alias("type"), p["text"].alias("text"), p["name"].alias("name"), p["id"].alias("id"),
            F.try_parse_json(p["input"]).alias("input"), p["tool_use_id"].alias("tool_use_id"),
            F.try_parse_json(p["content"]).alias("content"),
        )
        return F.try_parse_json(F.when(p["type"] == "image_url", F.to_json(image)).otherwise(F.to_json(plain)))

    def message(m: Column) -> Column:
        parts = F.to_json(F.transform(m["content_parts"], part))
        content = F.coalesce(F.to_json(F.to_variant_object(F.array(m["content_text"]))), parts)
        as_text = F.when(m["content_text"].isNotNull(), F.get(V.items(F.try_parse_json(content)), 0))
        return F.struct(
            m["role"].alias("role"), F.coalesce(as_text, F.try_parse_json(parts)).alias("content"),
            m["reasoning"].alias("reasoning"),
            *([F.transform(m["tool_calls"], call).alias("tool_calls"), m["tool_call_id"].alias("tool_call_id")] if has_tools else []),
        )

    choice = F.col("tool_choice")
    return converted.select(
        "seq_id",
        F.to_json(
            F.struct(
                F.col("request_model").alias("model"),
                F.transform("messages", message).alias("messages"),
                "max_tokens", "temperature", "top_p", F.try_parse_json("stop").alias("stop"),
                F.transform("tools", lambda t: F.try_parse_json(t)).alias("tools"),
                F.when(F.startswith(choice, F.lit("{")), F.try_parse_json(choice))
                .otherwise(F.try_parse_json(F.concat(F.lit('"'), choice, F.lit('"')))).alias("tool_choice"),
            )
        ).alias("openai_request"),
        *keep,
    )


def converted_lines(decoded: DataFrame, profile: C.Profile = C.AGENT) -> DataFrame:
    """hour_key, seq_id and ``value``: ``{"seq_id": ..., "openai_request": ..., "_source": ...}`` as one JSON line."""
    rows = converted_json(convert_requests(decoded, profile), "hour_key", F.struct(*source_facts()).alias("_source"))
    whole = F.struct("seq_id", F.parse_json("openai_request").alias("openai_request"), "_source")
    return rows.select("hour_key", "seq_id", F.to_json(whole).alias("value"))


def prompt_lines(decoded: DataFrame, profile: C.Profile = C.AGENT, **options) -> DataFrame:
    """hour_key, seq_id and ``value``: ``{"seq_id": ..., "prompt": ...}`` as one JSON line."""
    prompt = C.render_prompt(F.col("messages"), F.col("tools"), tools_shown=profile.tool_messages, **options)
    rows = convert_requests(decoded, profile).select("hour_key", "seq_id", prompt.alias("prompt"))
    return rows.select("hour_key", "seq_id", F.to_json(F.struct("seq_id", "prompt")).alias("value"))


def request_detail(with_reply: DataFrame, seq_ids: list[int] | None = None) -> DataFrame:
    """Everything about a request, nothing trimmed: facts, converted request, system text, reply.

    ``with_reply`` is the decoded log with its ``reply`` struct.
    """
    rows = with_reply if seq_ids is None else with_reply.where(F.col("seq_id").isin(seq_ids))
    return parsed_body(rows).select(
        "seq_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "hour_key", "method", "path", "model",
        "status", "duration_ms", "body_len", "resp_size", "error", *_shown(), "reply", F.col("response_text").alias("raw_text"),
    )
