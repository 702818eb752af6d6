"""The given ``conversations`` table seen as captured chat requests.

A conversation becomes one request per run of eight turns, so a conversation
of any length gives requests of bounded size. The last turn, if it is the
assistant's, is the reply. The shape of request and reply (streamed or plain,
blocks or strings, tools, images, ...) varies with the conversation id, so the
whole table covers every branch of the operators. Every fifth conversation is
captured twice.

``spark_rows`` and the SQL in ``C`` state the same rules once per dialect; the
SQL never goes through the encoded bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators.decoding import decode, with_reply
from ..schema import DECODED_SCHEMA, LOG_COLUMNS, LOG_SCHEMA
from ..session import work_dir
from ..sources.log_table import read_log, write_log

RUN = 8
BLOCK_STRIDE = 1 << 40
# Copies of a request: 1 whole, 2 whole again, before them 0 with a short reply, behind them 3 with an empty one.
_COPIES = "k = 1 OR (k = 0 AND {c} % 10 = 0) OR (k = 2 AND {c} % 5 = 0) OR (k = 3 AND {c} % 24 = 23)"

_LOOKUP = (
    '{"name":"lookup","description":"Find things","input_schema":'
    '{"properties":{"query":{"type":"string"}},"type":"object"}}'
)
_FETCH = '{"name":"fetch"}'
_SUM = '{"function":{"description":"Add","name":"sum","parameters":{"type":"object"}},"type":"function"}'


def _q(text: str) -> str:
    """SQL literal; the texts used here hold no quote and no backslash."""
    return f"'{text}'"


# Expressions over one captured request that both dialects understand.
_SYSTEM = f"""CASE c % 3
    WHEN 1 THEN concat('"You are helper ', c % 5, '."')
    WHEN 2 THEN concat({_q('[{"type":"text","text":"x-anthropic-billing-header: v1"},{"type":"text","text":"Be brief."},{"type":"text","text":"Topic ')}, c % 5, '."}}]')
END"""
_TOOLS = f"CASE c % 4 WHEN 0 THEN {_q(f'[{_LOOKUP},{_FETCH}]')} WHEN 1 THEN {_q(f'[{_SUM}]')} END"
_CHOICE = (
    """CASE c % 6 WHEN 0 THEN '{"type":"auto"}' WHEN 1 THEN '{"type":"any"}' WHEN 2 THEN '{"type":"none"}' """
    """WHEN 3 THEN '{"type":"tool","name":"lookup"}' WHEN 4 THEN '{"type":"other"}' END"""
)
_BODY = f"""concat(
    '{{"model":"m', c % 7, '","messages":', messages_json,
    coalesce(',"system":' || {_SYSTEM}, ''),
    concat(',"max_tokens":', c % 4 * 256),
    CASE WHEN c % 10 <> 9 THEN concat(',"temperature":0.', c % 10) ELSE '' END,
    CASE WHEN c % 6 = 0 THEN ',"top_p":0.9' ELSE '' END,
    coalesce(',"tools":' || {_TOOLS}, ''),
    coalesce(',"tool_choice":' || {_CHOICE}, ''),
    CASE WHEN c % 8 = 0 THEN ',"stop_sequences":["END"]' ELSE '' END,
    '}}')"""

# Pieces of a reply. j(x) is the JSON literal of x, filled in per dialect.
_ARGS2 = """concat('{"query":', {j_query}, ',"limit":5}')"""
_ARGS3 = """concat('{"url":"http://x/', c, '","deep":true,"tags":["a","b"],"note":null,"opts":{"k":1}}')"""


def _reply_parts(j) -> dict[str, str]:
    """Named SQL texts; ``j`` wraps an expression into its JSON literal."""
    start_chars = "CASE WHEN c % 7 = 2 THEN 10 ELSE 0 END"
    args2 = _ARGS2.replace("{j_query}", j("left(last_ask, 10)"))
    return {
        "start_text": f"left(reply, {start_chars})",
        "rest": f"substring(reply, {start_chars} + 1)",
        "args2": args2,
        "args3": _ARGS3,
        "plain": (
            f"""concat('{{"type":"message","content":[', CASE WHEN thought <> '' THEN concat("""
            f"""'{{"type":"thinking","thinking":', {j('thought')}, '}},') ELSE '' END, """
            f"""'{{"type":"text","text":', {j('reply')}, '}}', CASE WHEN c % 4 = 0 THEN concat("""
            f"""',{{"type":"tool_use","id":"toolu_', c, '","name":"lookup","input":', {args2}, '}}') ELSE '' END, """
            """'],"usage":{"input_tokens":', asked_len, ',"output_tokens":', length(reply), '},"stop_reason":"end_turn"}')"""
        ),
    }


def _events(j, struct, lst, transform_rest) -> list[str]:
    """The events of a streamed reply as SQL list expressions, in order.

    Each event is a struct (kind, idx, part, json); ``part`` is what it adds
    to the text or the thinking.
    """
    def one(kind, idx, part, text):
        return lst(struct(kind, idx, part, text))

    def when(cond, item):
        return f"CASE WHEN {cond} THEN {item} ELSE {lst()} END"

    def delta(idx, piece):
        return (
            f"""concat('{{"type":"content_block_delta","index":{idx},"delta":{{"type":"input_json_delta","partial_json":', """
            f"""{j(piece)}, '}}}}')"""
        )

    def tool_start(idx, ident, name):
        return (
            f"""concat('{{"type":"content_block_start","index":{idx},"content_block":{{"type":"tool_use","id":"{ident}', c, """
            f"""'","name":"{name}","input":{{}}}}}}')"""
        )

    start, d, none = "'content_block_start'", "'content_block_delta'", "CAST(NULL AS {s})"
    return [
        one("'message_start'", "NULL", none,
            """concat('{"type":"message_start","message":{"usage":{"input_tokens":', asked_len, ',"output_tokens":1}}}')"""),
        when("thought <> ''", one(start, "0", "''", """'{"type":"content_block_start","index":0,"content_block":{"type":"thinking","thinking":""}}'""")),
        when("thought <> ''", one(d, "0", "thought", f"""concat('{{"type":"content_block_delta","index":0,"delta":{{"type":"thinking_delta","thinking":', {j('thought')}, '}}}}')""")),
        one(start, "1", "start_text", f"""concat('{{"type":"content_block_start","index":1,"content_block":{{"type":"text","text":', {j('start_text')}, '}}}}')"""),
        transform_rest(f"""concat('{{"type":"content_block_delta","index":1,"delta":{{"type":"text_delta","text":', {j('piece')}, '}}}}')"""),
        one("'content_block_stop'", "1", none, """'{"type":"content_block_stop","index":1}'"""),
        when("c % 4 = 0", one(start, "2", none, tool_start(2, "toolu_a", "lookup"))),
        when("c % 8 = 0", one(start, "3", none, tool_start(3, "toolu_b", "fetch"))),
        when("c % 4 = 0", one(d, "2", none, delta(2, "left(args2, 9)"))),
        when("c % 8 = 0", one(d, "3", none, delta(3, "left(args3, 12)"))),
        when("c % 4 = 0", one(d, "2", none, delta(2, "substring(args2, 10)"))),
        when("c % 8 = 0", one(d, "3", none, delta(3, "substring(args3, 13)"))),
        when("c % 16 = 4", one(d, "9", none, delta(9, "'{}'"))),
        when("c % 6 = 1", one("'ping'", "NULL", none, """'{"type":"ping"}'""")),
        when("c % 6 = 1", one("'ping'", "NULL", none, """'{"type":"ping","second":1}'""")),
        when("c % 6 = 5", one("'broken'", "NULL", none, """'{"type":"content_block_delta"'""")),
        one("'message_delta'", "NULL", none,
            """concat('{"type":"message_delta","delta":{"stop_reason":"', CASE WHEN c % 4 = 0 THEN 'tool_use' ELSE 'end_turn' END, '"},"usage":{"output_tokens":', length(reply), '}}')"""),
        when("c % 7 = 5", one("'message_delta'", "NULL", none,
            """concat('{"type":"message_delta","delta":{"stop_reason":null},"usage":{"output_tokens":', length(reply) + 1, '}}')""")),
        when("c % 7 = 6", one("'message_delta'", "NULL", none, """'{"type":"message_delta","delta":{}}'""")),
        one("'message_stop'", "NULL", none, """'{"type":"message_stop"}'"""),
    ]


# An event's place in the stream text. The second ping shares the first one's frame.
_FRAME = """CASE
    WHEN e.json = '{"type":"ping","second":1}' THEN concat(chr(10), 'data: ', e.json)
    WHEN e.kind = 'broken' OR c % 7 = 3 THEN concat(chr(10), chr(10), 'data: ', e.json)
    ELSE concat(chr(10), chr(10), 'event: ', e.kind, chr(10), 'data: ', e.json) END"""
_STREAM_TEXT = "concat(substring({frames}, 3), chr(10), chr(10), 'data: [DONE]', chr(10), chr(10))"
_RESPONSE = """CASE WHEN NOT replied THEN NULL
    WHEN c % 9 = 6 THEN concat('upstream said: ', reply)
    WHEN c % 3 = 0 THEN plain_json
    WHEN c % 12 = 7 THEN replace(stream_text, chr(10), concat(chr(13), chr(10)))
    ELSE stream_text END"""


# --------------------------------------------------------------------------- Spark

def _spark_j(expression: str) -> str:
    text = f"to_json(array({expression}))"
    return f"substring({text}, 2, length({text}) - 2)"


def _spark_struct(kind, idx, part, text):
    part = part.replace("{s}", "STRING")
    return f"named_struct('kind', {kind}, 'idx', CAST({idx} AS BIGINT), 'part', {part}, 'json', {text})"


_SPARK_EVENT = "ARRAY<STRUCT<kind: STRING, idx: BIGINT, part: STRING, json: STRING>>"


def _spark_list(item: str | None = None) -> str:
    return f"CAST(array({item or ''}) AS {_SPARK_EVENT})"


def _spark_rest(json_text: str) -> str:
    return (
        f"CASE WHEN rest = '' THEN {_spark_list()} ELSE CAST(transform(transform(sequence(0, (length(rest) - 1) div 40), "
        f"i -> substring(rest, i * 40 + 1, 40)), piece -> "
        f"{_spark_struct(repr('content_block_delta'), '1', 'piece', json_text)}) AS {_SPARK_EVENT}) END"
    )


_SPARK_BLOCKS = """
    CASE WHEN t.role = 'assistant' THEN concat(
        '[{"type":"thinking","thinking":', J(left(t.text, 20)), '},{"type":"text","text":', J(t.text),
        '},{"type":"tool_use","id":"tu_', t.turn, '","name":"lookup","input":{"q":', J(left(t.text, 8)), '}}',
        CASE WHEN t.turn % 4 = 3 THEN ',{"type":"redacted_thinking","data":"x"}' ELSE '' END, ']')
    WHEN t.role = 'user' THEN concat(
        '[{"type":"text","text":', J(t.text), '}',
        CASE WHEN t.turn % 4 <> 2 THEN ''
            WHEN c % 4 = 1 THEN concat(',{"type":"image","source":{"type":"base64","media_type":"image/png","data":"', t.turn, 'AA"}}')
            ELSE concat(',{"type":"image","source":{"type":"url","url":"http://img/', c, '/', t.turn, '"}}') END,
        CASE WHEN t.turn > 0 THEN concat(',{"type":"tool_result","tool_use_id":"tu_', t.turn - 1, '","content":"ok"}') ELSE '' END,
        ']')
    ELSE concat('[{"type":"text","text":', J(t.text), '}]') END
"""


def _expand(template: str, j) -> str:
    """Replace ``J(x)`` by the dialect's JSON literal of x."""
    out = template
    while "J(" in out:
        at = out.index("J(")
        depth, end = 1, at + 2
        while depth:
            depth += {"(": 1, ")": -1}.get(out[end], 0)
            end += 1
        out = out[:at] + j(out[at + 2 : end - 1]) + out[end:]
    return out


_MESSAGE = (
    """concat('{"role":"', t.role, '","content":', CASE WHEN c % 2 = 0 THEN J(t.text) ELSE """
    + _SPARK_BLOCKS
    + """ END, '}')"""
)


def spark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per captured request, payloads as text."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    runs = (
        turns.groupBy("conv_id", F.expr(f"turn div {RUN}").alias("block"))
        # at most RUN turns per group
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    )
    parts = _reply_parts(_spark_j)
    events = _events(_spark_j, _spark_struct, _spark_list, _spark_rest)
    frames = f"array_join(transform(events, e -> {_FRAME}), '')"
    return (
        runs.selectExpr("conv_id AS c", "block", "turns", f"explode(filter(array(0, 1, 2, 3), k -> {_COPIES.replace('{c}', 'conv_id')})) AS copy")
        .selectExpr("*", "element_at(turns, -1) AS final")
        .selectExpr("*", "final.role = 'assistant' AS replied")
        .selectExpr("*", "CASE WHEN replied THEN slice(turns, 1, size(turns) - 1) ELSE turns END AS asked")
        .selectExpr(
            "*",
            "CASE WHEN NOT replied THEN NULL WHEN copy = 3 THEN '' WHEN copy = 0 THEN left(final.text, 5) ELSE final.text END AS reply",
            "coalesce(try_element_at(asked, -1).text, '') AS last_ask",
            "aggregate(asked, 0, (n, t) -> n + length(t.text)) AS asked_len",
            f"concat('[', array_join(transform(asked, t -> {_expand(_MESSAGE, _spark_j)}), ','), ']') AS messages_json",
        )
        .selectExpr(
            "*",
            "CASE WHEN replied AND c % 2 = 1 AND copy <> 3 THEN concat('Consider: ', left(last_ask, 60)) ELSE '' END AS thought",
            f"{parts['start_text']} AS start_text", f"{parts['rest']} AS rest",
            f"{parts['args2']} AS args2", f"{parts['args3']} AS args3",
        )
        .selectExpr(
            "*",
            f"CASE WHEN NOT replied OR c % 3 = 0 THEN NULL ELSE concat({', '.join(events)}) END AS events",
            f"{parts['plain']} AS plain_json",
        )
        .selectExpr("*", f"{_STREAM_TEXT.replace('{frames}', frames)} AS stream_text")
        .selectExpr(
            f"block * {BLOCK_STRIDE} + c * 4 + copy AS seq_id",
            "timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(CAST(c div 86400 AS INT), CAST(c % 24 AS INT), 0, "
            "(c div 24) % 3600 + copy * 0.5) AS ts",
            "concat('m', c % 7) AS model",
            "CASE WHEN c % 13 = 12 THEN '/V1/Messages' ELSE '/v1/messages' END AS path",
            "CAST(100 * size(turns) + c % 50 AS DOUBLE) AS duration_ms",
            f"{_BODY} AS body_text",
            f"{_RESPONSE} AS response_text",
            "c % 2 = 1 AS packed",
        )
    )


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows as they are stored: gzip bodies, half of the replies gzip, half plain."""
    packed = codec.encode_gzip(F.when(F.col("packed"), F.col("response_text")))
    rows = spark_rows(spark, sf_dir)
    return rows.select(
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("ts_epoch"), "ts", "seq_id",
        F.lit("POST").alias("method"), "path", "model", F.concat(F.lit("http://upstream"), "path").alias("upstream"),
        codec.encode_gzip(F.col("body_text")).alias("body"),
        F.octet_length("body_text").cast("bigint").alias("body_len"),
        F.when(F.col("packed"), packed).otherwise(F.encode("response_text", "utf-8")).alias("response"),
        F.lit(200).alias("status"), "duration_ms", F.lit(None).cast("string").alias("error"),
        F.date_format("ts", "yyyy-MM-dd_HH").alias("hour_key"),
    ).select(LOG_COLUMNS)


_landed: dict[tuple[str, str, str], str] = {}


def _land(spark: SparkSession, sf_dir: str, name: str, schema: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write a table once per application and read it from there."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _landed:
        path = work_dir(spark, name)
        write_log(build(), path, mode="overwrite")
        _landed[key] = path
    return read_log(spark, _landed[key], schema)


def capture_path(spark: SparkSession, sf_dir: str) -> str:
    """Where the captured log is stored."""
    capture_log(spark, sf_dir)
    return _landed[(spark.sparkContext.applicationId, sf_dir, "capture")]


def capture_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log on storage: an hour-partitioned table of encoded payloads."""
    return _land(spark, sf_dir, "capture", LOG_SCHEMA, lambda: captured(spark, sf_dir))


def decoded_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log decoded and rebuilt once; reports and search read this table."""

    def build() -> DataFrame:
        rows = with_reply(decode(capture_log(spark, sf_dir)), with_tools=False)
        return rows.select(
            *[c for c in rows.columns if c != "reply"],
            F.col("reply.text").alias("reply_text"), F.col("reply.thinking").alias("reply_thinking"),
        )

    return _land(spark, sf_dir, "decoded", DECODED_SCHEMA, build)


# --------------------------------------------------------------------------- oracle

def _duck_j(expression: str) -> str:
    return f"CAST(to_json({expression}) AS VARCHAR)"


def _duck_struct(kind, idx, part, text):
    part = part.replace("{s}", "VARCHAR")
    return f"{{'kind': {kind}, 'idx': CAST({idx} AS BIGINT), 'part': {part}, 'json': {text}}}"


_DUCK_EVENT = "STRUCT(kind VARCHAR, idx BIGINT, part VARCHAR, json VARCHAR)[]"


def _duck_list(item: str | None = None) -> str:
    return f"CAST([{item or ''}] AS {_DUCK_EVENT})"


def _duck_rest(json_text: str) -> str:
    return (
        f"CASE WHEN rest = '' THEN {_duck_list()} ELSE list_transform(list_transform(range(0, (length(rest) - 1) // 40 + 1), "
        f"lambda i: substring(rest, i * 40 + 1, 40)), lambda piece: "
        f"{_duck_struct(repr('content_block_delta'), '1', 'piece', json_text)}) END"
    )


_DUCK_PARTS = _reply_parts(_duck_j)
_DUCK_EVENTS = " || ".join(f"({e})" for e in _events(_duck_j, _duck_struct, _duck_list, _duck_rest))
_DUCK_FRAMES = f"array_to_string(list_transform(events, lambda e: {_FRAME}), '')"

# CTE ``c``: one row per captured request with its parts and its texts.
# ``shown`` is the reply a viewer shows, ``thinking_shown`` its thinking.
C = f"""
WITH c0 AS (
    SELECT conv_id AS c, turn // {RUN} AS block,
        list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn) AS turns
    FROM conversations GROUP BY ALL
),
c1 AS (
    SELECT *, unnest(list_filter([0, 1, 2, 3], lambda k: {_COPIES.replace('{c}', 'c')})) AS copy, turns[-1] AS final FROM c0
),
c2 AS (SELECT *, final.role = 'assistant' AS replied FROM c1),
c3 AS (SELECT *, CASE WHEN replied THEN turns[:-2] ELSE turns END AS asked FROM c2),
c4 AS (
    SELECT *,
        CASE WHEN NOT replied THEN NULL WHEN copy = 3 THEN '' WHEN copy = 0 THEN left(final.text, 5) ELSE final.text END AS reply,
        coalesce(asked[-1].text, '') AS last_ask,
        CAST(coalesce(list_sum(list_transform(asked, lambda t: length(t.text))), 0) AS BIGINT) AS asked_len,
        '[' || coalesce(array_to_string(list_transform(asked, lambda t: {_expand(_MESSAGE, _duck_j)}), ','), '') || ']' AS messages_json
    FROM c3
),
c5 AS (
    SELECT *,
        CASE WHEN replied AND c % 2 = 1 AND copy <> 3 THEN 'Consider: ' || left(last_ask, 60) ELSE '' END AS thought,
        {_DUCK_PARTS['start_text']} AS start_text, {_DUCK_PARTS['rest']} AS rest,
        {_DUCK_PARTS['args2']} AS args2, {_DUCK_PARTS['args3']} AS args3
    FROM c4
),
c6 AS (
    SELECT *, CASE WHEN NOT replied OR c % 3 = 0 THEN NULL ELSE {_DUCK_EVENTS} END AS events,
        {_DUCK_PARTS['plain']} AS plain_json
    FROM c5
),
c7 AS (
    SELECT *, CASE WHEN events IS NOT NULL THEN {_STREAM_TEXT.replace('{frames}', _DUCK_FRAMES)} END AS stream_text FROM c6
),
c8 AS (
    SELECT *,
        CAST(block * {BLOCK_STRIDE} + c * 4 + copy AS BIGINT) AS seq_id,
        TIMESTAMP '2024-03-01 00:00:00' + to_days(CAST(c // 86400 AS INT)) + to_hours(c % 24)
            + to_milliseconds((c // 24) % 3600 * 1000 + copy * 500) AS ts,
        'm' || (c % 7) AS model,
        CASE WHEN c % 13 = 12 THEN '/V1/Messages' ELSE '/v1/messages' END AS path,
        CAST(100 * len(turns) + c % 50 AS DOUBLE) AS duration_ms,
        {_BODY} AS body_text,
        {_RESPONSE} AS response_text
    FROM c7
),
c AS (
    SELECT *, strftime(ts, '%Y-%m-%d_%H') AS hour_key, events IS NOT NULL AS streamed,
        replied AND c % 9 <> 6 AS readable,
        CASE WHEN replied AND c % 9 = 6 THEN 'upstream said: ' || reply ELSE reply END AS shown,
        CASE WHEN replied AND c % 9 = 6 THEN '' ELSE thought END AS thinking_shown,
        CASE WHEN c % 4 = 0 AND streamed THEN 'tool_use' ELSE 'end_turn' END AS first_stop,
        CASE WHEN streamed AND c % 7 = 5 THEN NULL WHEN c % 4 = 0 AND streamed THEN 'tool_use' ELSE 'end_turn' END AS stop_reason,
        CAST(length(reply) + CASE WHEN streamed AND c % 7 = 5 THEN 1 ELSE 0 END AS BIGINT) AS out_tokens
    FROM c8
)
"""
