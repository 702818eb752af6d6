"""Queries over the requests themselves: conversion, prompts, search, tokens, documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chat
from ..operators import cleaning, decoding, paging, scans, search, search_index, tokens, turns
from ..session import work_dir
from ..sources.log_table import landed
from . import jobs
from .capture_log import RUN, C, capture_log, capture_path, decoded_log
from .registry import query

# CTE ``t``: one row per turn of a request.
T = f"""{C}, t AS (
    SELECT seq_id, c, model, nth - 1 AS pos, x.turn AS turn, x.role AS role, x.text AS text,
        sum((x.role <> 'system')::INT) OVER (PARTITION BY seq_id ORDER BY nth) - 1 AS place,
        sum((x.role <> 'system')::INT) OVER (PARTITION BY seq_id) AS turns
    FROM (SELECT seq_id, c, model, unnest(asked) AS x, generate_subscripts(asked, 1) AS nth FROM c))"""


@query(f"""{T} SELECT seq_id, pos AS turn, role, full_text AS text, left(full_text, 120) AS head FROM (
        SELECT *, CASE WHEN c % 2 = 0 OR role = 'system' THEN text
            WHEN role = 'user' THEN text || CASE WHEN turn % 4 = 2 THEN ' ' ELSE '' END || CASE WHEN turn > 0 THEN ' ' ELSE '' END
            ELSE ' ' || text || ' ' || CASE WHEN turn % 4 = 3 THEN ' ' ELSE '' END END AS full_text FROM t)""")
def explode_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.explode_turns(decoded_log(spark, sf_dir))
    return rows.select("seq_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", "head")


@query(f"""{T} SELECT seq_id, CAST(place AS BIGINT) AS turn, role, turns > 4 AND place < turns - 3 AS earlier
    FROM t WHERE role <> 'system'""")
def tail_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.tail_turns(decoded_log(spark, sf_dir))
    return rows.select("seq_id", F.col("turn").cast("bigint").alias("turn"), "role", "earlier")


@query(f"""{C} SELECT seq_id, CAST(2 AS BIGINT) AS tool_count, CAST(p AS BIGINT) AS pos, name, description FROM c,
        (VALUES (0, 'lookup', 'Find things'), (1, 'fetch', '')) v(p, name, description) WHERE c.c % 4 = 0
    UNION ALL SELECT seq_id, 1, 0, 'sum', 'Add' FROM c WHERE c % 4 = 1""")
def tool_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.tool_catalog(decoded_log(spark, sf_dir))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


# ------------------------------------------------------------------ conversion

_INLINE = "coalesce(list_transform(list_filter(asked, lambda t: t.role = 'system'), lambda t: t.text), [])"
_TOP = """CASE c % 3 WHEN 1 THEN ['You are helper ' || (c % 5) || '.'] WHEN 2 THEN {billing} ||
    ['Be brief.', 'Topic ' || (c % 5) || '.'] ELSE CAST([] AS VARCHAR[]) END"""
_VIEWER_SYSTEM = _TOP.replace("{billing}", "['x-anthropic-billing-header: v1']") + f" || {_INLINE}"
_CONVERTER_SYSTEM = _TOP.replace("{billing}", "CAST([] AS VARCHAR[])") + f" || {_INLINE}"


@query(f"""{C} SELECT seq_id, nullif(array_to_string({_VIEWER_SYSTEM}, chr(10) || chr(10)), '') AS viewer,
        nullif(array_to_string({_CONVERTER_SYSTEM}, ''), '') AS converter FROM c""")
def merge_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("body_json")
    return turns.parsed_body(decoded_log(spark, sf_dir)).select(
        "seq_id", chat.merge_system(body, chat.VIEWER).alias("viewer"),
        chat.merge_system(body, chat.CONVERTER).alias("converter"),
    )


def _listed_messages(spark: SparkSession, sf_dir: str, profile: chat.Profile, name: str) -> DataFrame:
    def show(part: Column) -> Column:
        return F.concat_ws(
            ":", part["type"], part["text"], part["url"], part["id"], part["name"], part["input"],
            part["tool_use_id"], part["content"],
        )

    rows = turns.parsed_body(decoded_log(spark, sf_dir)).select(
        "seq_id", F.posexplode(chat.convert_messages(F.col("body_json"), profile)).alias("place", "m")
    )
    return rows.select(
        F.lit(name).alias("profile"), "seq_id", F.col("place").cast("bigint").alias("place"), "m.role", "m.content_text",
        F.array_join(F.transform("m.content_parts", show), "|").alias("parts"), "m.reasoning",
    )


_IMAGE = "CASE WHEN c % 4 = 1 THEN 'data:image/png;base64,' || turn || 'AA' ELSE 'http://img/' || c || '/' || turn END"


@query(f"""{T}, turn AS (SELECT *, CAST(place AS BIGINT) AS nth FROM t WHERE role <> 'system')
    SELECT 'viewer' AS profile, seq_id, nth AS place, role,
        CASE WHEN c % 2 = 0 OR (role = 'user' AND turn = 0) THEN text END AS content_text,
        CASE WHEN c % 2 = 0 OR (role = 'user' AND turn = 0) THEN NULL
            WHEN role = 'user' THEN 'text:' || text || '|tool_result:tu_' || (turn - 1) || ':"ok"'
            ELSE 'text:' || text || '|tool_use:tu_' || turn || ':lookup:{{"q":' || CAST(to_json(left(text, 8)) AS VARCHAR) || '}}'
        END AS parts,
        CASE WHEN c % 2 = 1 AND role = 'assistant' THEN left(text, 20) || CASE WHEN turn % 4 = 3 THEN '[redacted thinking]' ELSE '' END
        END AS reasoning FROM turn
    UNION ALL SELECT 'converter', seq_id, nth, role,
        CASE WHEN c % 2 = 0 OR role = 'assistant' OR turn % 4 <> 2 THEN text END,
        CASE WHEN c % 2 = 1 AND role = 'user' AND turn % 4 = 2 THEN 'text:' || text || '|image_url:' || {_IMAGE} END,
        CASE WHEN c % 2 = 1 AND role = 'assistant' THEN left(text, 20) END FROM turn""")
def convert_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed_messages(spark, sf_dir, chat.VIEWER, "viewer").union(
        _listed_messages(spark, sf_dir, chat.CONVERTER, "converter")
    )


_AGENT = f"""{T}, turn AS (SELECT *, CAST(place AS BIGINT) AS nth FROM t WHERE role <> 'system'),
    agent AS (
        SELECT seq_id, nth, 0 AS sub, 'tool' AS role, 'ok' AS content_text, NULL AS parts, NULL AS calls, 'tu_' || (turn - 1) AS tool_call_id
        FROM turn WHERE c % 2 = 1 AND role = 'user' AND turn > 0
        UNION ALL SELECT seq_id, nth, 1, role, CASE WHEN c % 2 = 0 OR role = 'assistant' OR turn % 4 <> 2 THEN text END,
            CASE WHEN c % 2 = 1 AND role = 'user' AND turn % 4 = 2 THEN 'text:' || text || '|image_url:' || {_IMAGE} END,
            CASE WHEN c % 2 = 1 AND role = 'assistant' THEN 'tu_' || turn || ':lookup:{{"q":' || CAST(to_json(left(text, 8)) AS VARCHAR) || '}}' END, NULL
        FROM turn)"""


@query(f"""{_AGENT} SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY nth, sub) - 1 AS place, role, content_text, parts, calls,
        tool_call_id FROM agent""")
def convert_tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat.tool_messages(chat.convert_messages(F.col("body_json"), chat.AGENT))
    rows = turns.parsed_body(decoded_log(spark, sf_dir)).select("seq_id", F.posexplode(messages).alias("place", "m"))
    part = lambda p: F.concat_ws(":", p["type"], p["text"], p["url"])
    call = lambda c: F.concat_ws(":", c["id"], c["name"], c["arguments"])
    return rows.select(
        "seq_id", F.col("place").cast("bigint").alias("place"), "m.role", "m.content_text",
        F.array_join(F.transform("m.content_parts", part), "|").alias("parts"),
        F.array_join(F.transform("m.tool_calls", call), "|").alias("calls"), "m.tool_call_id",
    )


# Written as JSON lines and read back.
@query(f"""{_AGENT}, s AS (SELECT *, array_to_string({_CONVERTER_SYSTEM}, '') AS system FROM c),
    n AS (SELECT seq_id, count(*) AS messages, count(tool_call_id) AS tool_messages, count(calls) AS calls FROM agent GROUP BY 1)
    SELECT s.seq_id, s.hour_key, model, CAST(coalesce(messages, 0) + (system <> '')::INT AS BIGINT) AS messages,
        coalesce(tool_messages, 0) AS tool_messages, coalesce(calls, 0) AS calls, CAST(len(asked) AS BIGINT) AS original_messages,
        CAST(coalesce(messages, 0) + (system <> '')::INT AS BIGINT) AS converted_messages
    FROM s LEFT JOIN n ON s.seq_id = n.seq_id WHERE path = '/v1/messages'""")
def converted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "converted")
    jobs.convert(spark, capture_path(spark, sf_dir), path)
    message = "ARRAY<STRUCT<role: STRING, tool_call_id: STRING, tool_calls: ARRAY<STRUCT<id: STRING>>>>"
    facts = "STRUCT<original_messages_count: BIGINT, converted_messages_count: BIGINT, seq_id: BIGINT>"
    rows = spark.read.schema(f"openai_request STRUCT<model: STRING, messages: {message}>, _source {facts}, seq_id BIGINT, hour_key STRING").json(path)
    messages = F.col("openai_request.messages")
    count = lambda test: F.size(F.filter(messages, test)).cast("bigint")
    return rows.select(
        "seq_id", "hour_key", "openai_request.model", F.size(messages).cast("bigint").alias("messages"),
        count(lambda m: m["role"] == "tool").alias("tool_messages"), count(lambda m: m["tool_calls"].isNotNull()).alias("calls"),
        F.col("_source.original_messages_count").alias("original_messages"),
        F.col("_source.converted_messages_count").alias("converted_messages"),
    )


@query(f"{T} SELECT seq_id, {_IMAGE} AS url FROM t WHERE c % 2 = 1 AND role = 'user' AND turn % 4 = 2")
def convert_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = turns.parsed_body(decoded_log(spark, sf_dir)).select(
        "seq_id", F.explode(chat.convert_messages(F.col("body_json"), chat.CONVERTER)).alias("m")
    )
    return messages.select("seq_id", F.explode("m.content_parts").alias("p")).where("p.type = 'image_url'").select(
        "seq_id", "p.url"
    )


_TOOL_ROWS = """(VALUES
    (0, 0, '{"type":"function","function":{"name":"lookup","description":"Find things","parameters":{"properties":{"query":{"type":"string"}},"type":"object"}}}'),
    (0, 1, '{"type":"function","function":{"name":"fetch","description":"","parameters":{"type":"object"}}}'),
    (1, 0, '{"function":{"description":"Add","name":"sum","parameters":{"type":"object"}},"type":"function"}')) v(kind, pos, tool)"""


@query(f"{C} SELECT seq_id, CAST(pos AS BIGINT) AS pos, tool FROM c JOIN {_TOOL_ROWS} ON c.c % 4 = kind")
def convert_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.parsed_body(decoded_log(spark, sf_dir)).select(
        "seq_id", F.posexplode(chat.convert_tools(F.col("body_json"))).alias("pos", "tool")
    ).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"""{C} SELECT seq_id, CASE c % 6 WHEN 0 THEN 'auto' WHEN 1 THEN 'required' WHEN 2 THEN 'none'
        WHEN 3 THEN '{{"type":"function","function":{{"name":"lookup"}}}}' ELSE CASE WHEN c % 4 < 2 THEN 'auto' END END
        AS tool_choice FROM c""")
def tool_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.parsed_body(decoded_log(spark, sf_dir)).select(
        "seq_id", chat.convert_tool_choice(F.col("body_json")).alias("tool_choice")
    )


@query(f"""{C} SELECT seq_id, nullif(c % 4 * 256, 0) AS max_tokens, CASE WHEN c % 10 <> 9 THEN (c % 10) / 10 END AS temperature,
        CASE WHEN c % 6 = 0 THEN CAST(0.9 AS DOUBLE) END AS top_p, CASE WHEN c % 8 = 0 THEN '["END"]' END AS stop FROM c""")
def request_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = chat.request_scalars(F.col("body_json"))
    return turns.parsed_body(decoded_log(spark, sf_dir)).select(
        "seq_id", *[column.alias(name) for name, column in columns.items()]
    )


@query(f"""{C}, s AS (SELECT *, array_to_string({_CONVERTER_SYSTEM}, '') AS system FROM c)
    SELECT seq_id, model AS original_model, CAST(len(asked) AS BIGINT) AS original_messages_count,
        CAST(CASE c % 3 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS BIGINT) AS original_system_blocks,
        CAST(CASE c % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS original_tools_count,
        length(system) AS converted_system_length,
        CAST(len(list_filter(asked, lambda t: t.role <> 'system')) + (system <> '')::INT AS BIGINT) AS converted_messages_count
    FROM s""")
def convert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.convert_stats(decoded_log(spark, sf_dir))


_PROMPT_TOOLS = f"""(SELECT kind, string_agg(chr(10) || tool, '' ORDER BY pos) AS tools FROM {_TOOL_ROWS} GROUP BY 1)"""


@query(f"""{C}, s AS (SELECT *, trim(array_to_string({_CONVERTER_SYSTEM}, ''), ' ' || chr(9) || chr(10) || chr(13)) AS system FROM c)
    SELECT seq_id, head || body || '▌assistant' || chr(10) || '▌thinking' || chr(10) AS prompt,
        head || body || '▌assistant' || chr(10) || '▌thinking' || chr(10) || chr(10) || '▌end_of_thought' || chr(10) || chr(10)
        AS quick_prompt
    FROM (SELECT seq_id,
        CASE WHEN tools IS NOT NULL THEN '▌system' || chr(10) || '# Tools' || chr(10) || chr(10)
            || 'You have access to the following functions:' || chr(10) || chr(10) || '<tools>' || tools || chr(10) || '</tools>'
            || chr(10) || chr(10) || '[tool call format instructions]...' || CASE WHEN system <> '' THEN chr(10) || chr(10) || system ELSE '' END
            || '▌' || chr(10)
        WHEN system <> '' THEN '▌system' || chr(10) || system || '▌' || chr(10) ELSE '' END AS head,
        coalesce(array_to_string(list_transform(list_filter(asked, lambda t: t.role <> 'system'),
            lambda t: '▌' || t.role || chr(10) || t.text || '▌' || chr(10)), ''), '') AS body
        FROM s LEFT JOIN {_PROMPT_TOOLS} ON c % 4 = kind)""")
def render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    converted = turns.convert_requests(decoded_log(spark, sf_dir), chat.CONVERTER)
    once = decoding.compute_once(converted, F.struct("messages", "tools"), "r", "seq_id")
    messages, tools = F.col("r.messages"), F.col("r.tools")
    return once.select(
        "seq_id", chat.render_prompt(messages, tools).alias("prompt"),
        chat.render_prompt(messages, tools, thinking=False).alias("quick_prompt"),
    )


# ------------------------------------------------------------------ search

def _hits(source: str, needle: str, scope: str) -> str:
    """Oracle: hits in an expression over ``c`` with the text around the first one."""
    return f"""SELECT seq_id, ts, model, '{scope}' AS scope,
        translate(substring(x, greatest(0, i - 81) + 1, i - 1 + {len(needle)} + 80 - greatest(0, i - 81)),
            chr(9) || chr(13) || chr(10), '   ') AS snippet, hour_key
    FROM (SELECT *, instr(lower(x), lower('{needle}')) AS i FROM (SELECT *, {source} AS x FROM c)) WHERE i > 0"""


_REPLY = "CASE WHEN replied THEN shown || ' ' || thinking_shown ELSE ' ' END"


def _found(spark: SparkSession, sf_dir: str, needle: str, scope: str) -> DataFrame:
    return search.search(decoded_log(spark, sf_dir), needle, scope)


@query(f"{C} SELECT seq_id, scope, snippet FROM ({_hits('body_text', 'inTh', 'body')})")
def search_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "inTh", "body").select("seq_id", "scope", "snippet")


@query(f"{C} SELECT seq_id, scope, snippet FROM ({_hits(_REPLY, 'ÈRE l', 'response')})")
def search_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "ÈRE l", "response").select("seq_id", "scope", "snippet")


@query(f"""{C}, hits AS ({_hits('body_text', 'tion', 'body')}
        UNION ALL SELECT * FROM ({_hits(_REPLY, 'tion', 'response')}) WHERE seq_id NOT IN (
            SELECT seq_id FROM ({_hits('body_text', 'tion', 'body')})))
    SELECT seq_id, model, scope, snippet, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY ts DESC, seq_id DESC LIMIT 30 OFFSET 0
    """)
def search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_page(_found(spark, sf_dir, "tion", "all"), page=1, limit=30).select(
        "seq_id", "model", "scope", "snippet", "total"
    )


@query(f"""{C}, hits AS ({_hits('body_text', 'Ction', 'body')}
        UNION ALL SELECT * FROM ({_hits(_REPLY, 'Ction', 'response')}) WHERE seq_id NOT IN (
            SELECT seq_id FROM ({_hits('body_text', 'Ction', 'body')})))
    SELECT seq_id, scope, snippet FROM hits""")
def search_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, path = decoded_log(spark, sf_dir), work_dir(spark, "search-index")
    search_index.write_index(log, path)
    hits = search_index.search_indexed(log, search_index.read_index(spark, path), "Ction")
    return hits.select("seq_id", "scope", "snippet")


# a page in the middle of all requests, whatever their number
@query(f"""{C}, p AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY ts DESC, seq_id DESC) AS place FROM c)
    SELECT seq_id, strftime(ts, '%H:%M:%S') AS time, strftime(ts, '%Y-%m-%d') AS date, model, total,
        CAST(ceil(total / 20) AS BIGINT) AS total_pages
    FROM p WHERE (place - 1) // 20 = total // 40""")
def request_page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = capture_log(spark, sf_dir)
    page = paging.request_page(log, page=log.count() // 40 + 1, limit=20)
    return page.select("seq_id", "time", "date", "model", "total", "total_pages")


@query(f"{C} SELECT seq_id, model, path, hour_key FROM c WHERE seq_id = (SELECT max(seq_id) FROM c)")
def lookup_in_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = capture_log(spark, sf_dir)
    bounds = landed(scans.id_bounds(log), "id-bounds")
    newest = bounds.agg(F.max("high")).first()[0]
    return scans.get_request(log, newest, bounds).select("seq_id", "model", "path", "hour_key")


_WINDOW = "2024-03-01_07"


@query(f"""{C}, hits AS ({_hits('body_text', 'on', 'body')}
        UNION ALL SELECT * FROM ({_hits(_REPLY, 'on', 'response')}) WHERE seq_id NOT IN (
            SELECT seq_id FROM ({_hits('body_text', 'on', 'body')})))
    SELECT kind, seq_id, scope, snippet FROM hits, (VALUES ('hour'), ('date'), ('last day')) k(kind)
    WHERE CASE kind WHEN 'hour' THEN hour_key = '{_WINDOW}' WHEN 'date' THEN hour_key[:10] = '{_WINDOW[:10]}'
        ELSE ts >= TIMESTAMP '2024-03-01 12:30:00' END""")
def search_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = decoded_log(spark, sf_dir)

    def within(kind: str, **time) -> DataFrame:
        return search.search_within(log, "on", **time).select(F.lit(kind).alias("kind"), "seq_id", "scope", "snippet")

    day, now = _WINDOW[:10], datetime(2024, 3, 2, 12, 30)
    return within("hour", hour_key=_WINDOW).union(within("date", date=day)).union(within("last day", as_of=now))


# ------------------------------------------------------------------ documents and tokens

@query("SELECT md5(text) AS text_md5, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedup_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.dedup_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


# A conversation (in runs of RUN turns) as token ids: per turn a prefix, the role,
# an id for each word, a thinking mark for the assistant, an end mark; some end in a bare prefix.
_ROLE_IDS = {"user": 846, "assistant": 74455}
_SYSTEM_ID = 8678
_BLOCK = 1 << 40


def token_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    def role_id(role: Column) -> Column:
        return F.when(role == "user", _ROLE_IDS["user"]).when(role == "assistant", _ROLE_IDS["assistant"]).otherwise(_SYSTEM_ID)

    def ids(t: Column) -> Column:
        words = F.transform(F.filter(F.split(t["text"], " "), lambda w: w != ""), lambda w: F.ascii(w) * 31 + F.length(w) * 7)
        head = F.concat(F.array(F.lit(tokens.TURN_PREFIX), role_id(t["role"])), words)
        think = F.when(t["role"] == "assistant", F.array(F.lit(tokens.THINK))).otherwise(F.array().cast("array<int>"))
        call = F.when(t["turn"] % 4 == 3, F.array(F.lit(tokens.TOOL_CALL))).otherwise(F.array().cast("array<int>"))
        return F.concat(head, think, call, F.array(F.lit(tokens.END_OF_TURN)))

    tail = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit(tokens.TURN_PREFIX))).otherwise(F.array().cast("array<int>"))
    return (
        spark.read.parquet(f"{sf_dir}/conversations.parquet")
        .groupBy("conv_id", F.expr(f"turn div {RUN}").alias("block"))
        # at most RUN turns per group
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .select(
            (F.col("block") * _BLOCK + F.col("conv_id")).alias("seq_id"),
            F.concat(F.flatten(F.transform("turns", ids)), tail).alias("token_ids"),
            F.concat(F.lit("m"), F.col("conv_id") % 7).alias("model"),
        )
    )


_TOKENS = f"""WITH r AS (
    SELECT conv_id, turn // {RUN} AS block, turn, [{tokens.TURN_PREFIX},
        CASE role WHEN 'user' THEN {_ROLE_IDS['user']} WHEN 'assistant' THEN {_ROLE_IDS['assistant']} ELSE {_SYSTEM_ID} END] || list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''),
            lambda w: CAST(unicode(w) * 31 + length(w) * 7 AS INTEGER)) || CASE WHEN role = 'assistant' THEN [{tokens.THINK}] ELSE [] END
        || CASE WHEN turn % 4 = 3 THEN [{tokens.TOOL_CALL}] ELSE [] END || [{tokens.END_OF_TURN}] AS ids FROM conversations
), k AS (
    SELECT CAST(block * {_BLOCK} + conv_id AS BIGINT) AS seq_id, 'm' || (conv_id % 7) AS model,
        flatten(list(ids ORDER BY turn)) || CASE WHEN conv_id % 3 = 0 THEN [{tokens.TURN_PREFIX}] ELSE [] END AS ids
    FROM r GROUP BY conv_id, block
), p AS (SELECT seq_id, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS place, len(ids) AS n FROM k),
s AS (SELECT *, lead(id) OVER (PARTITION BY seq_id ORDER BY place) AS label FROM p),
starts AS (SELECT *, place - lag(place, 1, 0) OVER w AS delta, row_number() OVER w - 1 AS section
    FROM s WHERE id = {tokens.TURN_PREFIX} AND label IS NOT NULL WINDOW w AS (PARTITION BY seq_id ORDER BY place))"""


@query(f"""{_TOKENS} SELECT seq_id, section, place AS position, delta, label AS label_token FROM starts
    UNION ALL SELECT seq_id, max(section) + 1, max(n), max(n) - max(place), NULL FROM starts GROUP BY seq_id""")
def token_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_sections(token_log(spark, sf_dir))


@query(f"""{_TOKENS} SELECT seq_id, count(*) AS num_tokens, count(*) FILTER (id = {tokens.END_OF_TURN}) AS end_of_turn,
        count(*) FILTER (id = {tokens.THINK}) AS think, count(*) FILTER (id = {tokens.TOOL_CALL}) AS tool_call FROM p GROUP BY 1""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(token_log(spark, sf_dir))


@query(f"""{_TOKENS} SELECT seq_id, '{{"token_ids":[' || array_to_string(ids, ',') || '],"num_tokens":' || len(ids) || ',"model":"'
        || model || '"}}' AS line FROM k""")
def token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(token_log(spark, sf_dir))
