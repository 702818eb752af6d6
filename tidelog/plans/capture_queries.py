"""Queries over the log of captured chat requests: decoding, rebuilding, cleaning."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..functions import events as EV
from ..functions import replies as R
from ..functions import variants as V
from ..operators import archive, cleaning, decoding, paging, rules, turns
from ..schema import LOG_SCHEMA
from ..session import work_dir
from ..sources import dataset, log_table
from ..streaming import chunks
from ..streaming.batches import run_to_end
from . import jobs
from .capture_log import C, capture_log, decoded_log
from .event_log import E, event_log
from .event_queries import route_table
from .registry import query


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded_log(spark, sf_dir).where(EV.looks_streaming(F.col("response_text")))


def _rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed replies with their parsed events as ``ev``."""
    rows = _streamed(spark, sf_dir)
    return decoding.compute_once(rows, EV.events_of(F.col("response_text")), "ev", "seq_id")


def _tokens(usage: str, name: str):
    return F.try_variant_get(F.col(usage)[name], "$", "bigint").alias(name)


# ------------------------------------------------------------------ decoding

@query(f"{C} SELECT seq_id, md5(body_text) AS body_md5, md5(coalesce(response_text, '')) AS response_md5 FROM c")
def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decoding.decode(capture_log(spark, sf_dir), strict_body=True)
    return rows.select("seq_id", F.md5("body_text").alias("body_md5"), F.md5("response_text").alias("response_md5"))


# The bodies of the event log are plain bytes: the lenient rule reads them, the strict one does not.
@query(f"{E} SELECT seq_id, props AS lenient, '' AS strict FROM e")
def decode_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).select(
        "seq_id", codec.decode_lenient(F.col("body")).alias("lenient"), codec.decode_body(F.col("body")).alias("strict")
    )


@query(f"""{C} SELECT seq_id, CASE WHEN c % 2 = 0 OR NOT replied THEN coalesce(strlen(response_text), 0) END AS plain_size,
        coalesce(strlen(response_text), 0) AS decoded_size FROM c""")
def response_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = capture_log(spark, sf_dir)
    plain = ~F.coalesce(codec.is_gzip(F.col("response")), F.lit(False))
    stored = F.coalesce(F.octet_length("response"), F.lit(0))
    return log.select(
        "seq_id", F.when(plain, stored).cast("bigint").alias("plain_size"),
        F.octet_length(codec.decode_response(F.col("response"))).cast("bigint").alias("decoded_size"),
    )


@query(f"{C} SELECT seq_id, md5(response_text) AS response_md5 FROM c WHERE replied")
def assemble_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = 100
    data = F.col("response")
    count = F.ceil(F.octet_length(data) / F.lit(size)).cast("int")
    chunks = (
        capture_log(spark, sf_dir).where("response IS NOT NULL")
        .select("seq_id", "response", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_no"))
        .select("seq_id", "chunk_no", F.substring(data, F.col("chunk_no") * size + 1, F.lit(size)).alias("bytes"))
    )
    whole = decoding.assemble_chunks(chunks)
    return whole.select("seq_id", F.md5(codec.decode_response(F.col("bytes"))).alias("response_md5"))


# The same chunks as they arrive: spread over three batches, those of one reply in any order.
@query(f"{C} SELECT seq_id, md5(response_text) AS response_md5 FROM c WHERE replied")
def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, root, data = 400, work_dir(spark, "chunks"), F.col("response")
    count = F.ceil(F.octet_length(data) / F.lit(size)).cast("int")
    parts = capture_log(spark, sf_dir).where("response IS NOT NULL").select(
        "seq_id", data, (count - 1).alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("no")
    )
    parts = parts.select(
        "seq_id", F.col("no").cast("bigint").alias("chunk_no"), F.substring(data, F.col("no") * size + 1, F.lit(size)).alias("bytes"),
        (F.col("no") == F.col("n")).alias("last"),
    )
    parts.repartition(3, F.xxhash64("seq_id", "chunk_no")).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(chunks.CHUNKS).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    run_to_end(chunks.start_assembly(stream, f"{root}/out", f"{root}/checkpoint", available_now=True))
    whole = chunks.read_assembled(spark, f"{root}/out").where("complete")
    return whole.select("seq_id", F.md5(codec.decode_response(F.col("bytes"))).alias("response_md5"))


@query(f"{C} SELECT seq_id, model FROM c")
def model_of_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded_log(spark, sf_dir).select("seq_id", rules.model_of_body(F.col("body_text")).alias("model"))


# ------------------------------------------------------------------ event streams

@query(f"""{C}, s AS (SELECT streamed AS is_streaming, count(*) AS replies FROM c WHERE replied GROUP BY 1)
    SELECT is_streaming, replies, round(replies * 100.0 / (SELECT sum(replies) FROM s), 2) AS share FROM s""")
def stream_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    replied = decoded_log(spark, sf_dir).where("response_text <> ''")
    counts = replied.groupBy(EV.looks_streaming(F.col("response_text")).alias("is_streaming")).agg(
        F.count(F.lit(1)).alias("replies")
    )
    total = replied.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.round(F.col("replies") * 100.0 / total, 2).cast("double"))


_EVENT_ROWS = f"""{C}, ev AS (
    SELECT seq_id, c, unnest(events) AS e, generate_subscripts(events, 1) AS nth FROM c WHERE streamed
), readable_events AS (SELECT * FROM ev WHERE e.kind <> 'broken')"""


def _event_rows(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    rows = decoding.explode_events(decoded_log(spark, sf_dir), mode)
    event = F.col("event")
    return rows.select(
        "seq_id", F.col("pos").cast("bigint").alias("pos"), event["e"]["type"].alias("type"), event["e"]["index"].alias("idx"),
        F.coalesce(EV.text_part(event), EV.thinking_part(event)).alias("part"),
    )


@query(f"""{_EVENT_ROWS}, first_lines AS (
        SELECT * FROM readable_events WHERE e.json <> '{{"type":"ping","second":1}}' AND (c % 12 <> 7 OR nth = 1))
    SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY nth) - 1 AS pos, e.kind AS type, e.idx AS idx, e.part AS part
    FROM first_lines""")
def sse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_rows(spark, sf_dir, EV.FIRST_LINE)


@query(f"""{_EVENT_ROWS}
    SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY nth) - 1 AS pos, e.kind AS type, e.idx AS idx, e.part AS part
    FROM readable_events""")
def sse_events_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_rows(spark, sf_dir, EV.ALL_LINES)


@query(f"{C} SELECT seq_id, reply AS text, thought AS thinking FROM c WHERE streamed")
def rebuild_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = F.col("ev")
    return _rebuilt(spark, sf_dir).select(
        "seq_id", EV.rebuild_text(ev).alias("text"), EV.rebuild_thinking(ev).alias("thinking")
    )


@query(f"{C} SELECT seq_id, asked_len AS input_tokens, out_tokens AS output_tokens, CAST(1 AS BIGINT) AS viewer_keys "
       "FROM c WHERE streamed")
def rebuild_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = F.col("ev")
    usage = _rebuilt(spark, sf_dir).select(
        "seq_id", EV.rebuild_usage(ev).alias("usage"), EV.rebuild_usage(ev, with_start=False).alias("viewer")
    )
    return usage.select(
        "seq_id", _tokens("usage", "input_tokens"), _tokens("usage", "output_tokens"),
        F.size("viewer").cast("bigint").alias("viewer_keys"),
    )


@query(f"{C} SELECT seq_id, stop_reason FROM c WHERE streamed")
def rebuild_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rebuilt(spark, sf_dir).select("seq_id", EV.rebuild_stop_reason(F.col("ev")).alias("stop_reason"))


@query(f"""{C} SELECT seq_id, CAST(1 + (thought <> '')::INT + (c % 4 = 0)::INT + (c % 8 = 0)::INT AS BIGINT) AS blocks
    FROM c WHERE streamed""")
def block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rebuilt(spark, sf_dir).select("seq_id", EV.count_blocks(F.col("ev")).alias("blocks"))


_CALLS = f"""{C}, calls AS (
    SELECT seq_id, CAST(0 AS BIGINT) AS pos, 'toolu_a' || c AS id, 'lookup' AS name, args2 AS input_json
        FROM c WHERE streamed AND c % 4 = 0
    UNION ALL SELECT seq_id, 1, 'toolu_b' || c, 'fetch', args3 FROM c WHERE streamed AND c % 8 = 0
    UNION ALL SELECT seq_id, 1, '', '', '{{}}' FROM c WHERE streamed AND c % 16 = 4)"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _rebuilt(spark, sf_dir).select(
        "seq_id", F.posexplode(EV.rebuild_tool_calls(F.col("ev"))).alias("pos", "call")
    )
    return listed.select("seq_id", F.col("pos").cast("bigint").alias("pos"), "call.id", "call.name", "call.input_json")


@query(f"{_CALLS} SELECT * FROM calls")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir)


@query(f"""{_CALLS}
    SELECT seq_id, pos, 'query' AS key, 'string (' || length(input_json ->> 'query') || ')' AS type_label,
        CAST(NULL AS BIGINT) AS field_count FROM calls WHERE name = 'lookup'
    UNION ALL SELECT seq_id, pos, 'limit', 'number', NULL FROM calls WHERE name = 'lookup'
    UNION ALL SELECT seq_id, pos, 'url', 'string (' || length(input_json ->> 'url') || ')', NULL FROM calls WHERE name = 'fetch'
    UNION ALL SELECT seq_id, pos, 'deep', 'boolean', NULL FROM calls WHERE name = 'fetch'
    UNION ALL SELECT seq_id, pos, 'tags', 'array [2]', NULL FROM calls WHERE name = 'fetch'
    UNION ALL SELECT seq_id, pos, 'note', 'null', NULL FROM calls WHERE name = 'fetch'
    UNION ALL SELECT seq_id, pos, 'opts', 'object', 1 FROM calls WHERE name = 'fetch'""")
def tool_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.tool_fields(_calls(spark, sf_dir).select("seq_id", "pos", "input_json"))


# Streams of model m3 come without event names; its route asks for the repair.
@query(f"""{C}, ev AS (SELECT seq_id, c, unnest(events || [{{'kind': 'done', 'idx': NULL, 'part': NULL, 'json': ''}}]) AS e,
        generate_subscripts(events || [{{'kind': 'done', 'idx': NULL, 'part': NULL, 'json': ''}}], 1) AS nth FROM c WHERE streamed)
    SELECT seq_id, nth - 1 AS pos,
        CASE WHEN e.kind IN ('broken', 'done') THEN NULL
            WHEN c % 7 <> 3 AND e.json = '{{"type":"ping","second":1}}' THEN NULL ELSE e.kind END AS event_name,
        CASE WHEN e.kind NOT IN ('broken', 'done') THEN e.kind END AS type,
        CASE WHEN c % 7 = 3 AND e.kind = 'message_delta' AND e.json LIKE '%output_tokens%' THEN CAST(1 AS BIGINT) END AS input_tokens
    FROM ev""")
def repair_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, default = route_table(spark)
    routed = rules.resolve_route(_streamed(spark, sf_dir), table, default)
    text = F.col("response_text")
    fixed = F.when(F.col("patch_sse"), EV.repair_lines(text)).otherwise(text)
    rows = decoding.compute_once(routed, EV.named_events(fixed), "ev", "seq_id").select(
        "seq_id", F.posexplode("ev").alias("pos", "e")
    )
    data = F.col("e.data")
    return rows.select(
        "seq_id", F.col("pos").cast("bigint").alias("pos"), "e.event_name", V.text_of(data, "type").alias("type"),
        V.get(data, "usage.input_tokens", "bigint").alias("input_tokens"),
    )


@query(f"""{C} SELECT seq_id, shown AS view_text, thinking_shown AS view_thinking,
        CAST(CASE WHEN readable AND c % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS view_tools,
        CASE WHEN readable THEN 'end_turn' END AS view_stop,
        CASE WHEN readable AND (reply <> '' OR thought <> '') THEN reply END AS clean_text,
        CASE WHEN readable AND (reply <> '' OR thought <> '') THEN thought END AS clean_thinking
    FROM c WHERE replied AND NOT streamed""")
def plain_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("response_text")
    plain = decoded_log(spark, sf_dir).where((text != "") & ~EV.looks_streaming(text))
    rows = decoding.compute_once(
        plain, F.struct(R.plain_reply_view(text).alias("v"), R.plain_reply_clean(text).alias("c")), "r", "seq_id"
    )
    return rows.select(
        "seq_id", F.col("r.v.text").alias("view_text"), F.col("r.v.thinking").alias("view_thinking"),
        F.size("r.v.tool_calls").cast("bigint").alias("view_tools"), F.col("r.v.stop_reason").alias("view_stop"),
        F.col("r.c.text").alias("clean_text"), F.col("r.c.thinking").alias("clean_thinking"),
    )


# ------------------------------------------------------------------ dataset

# CTEs: records before dedup, then the first of each request per hour.
_RECORDS = f"""{C}, records AS (
    SELECT *, greatest(length(trim(reply)), length(trim(thought))) AS out_len,
        row_number() OVER (PARTITION BY hour_key, model, messages_json ORDER BY seq_id) AS nth,
        row_number() OVER (PARTITION BY model, messages_json ORDER BY seq_id) AS nth_global
    FROM c WHERE path = '/v1/messages' AND readable AND len(asked) > 0
        AND greatest(length(trim(reply)), length(trim(thought))) >= 2)"""
_RECORD = """hour_key, seq_id, model, CAST(len(asked) AS BIGINT) AS turns, reply AS text, thought AS thinking,
    streamed AS is_streaming, asked_len AS input_tokens, out_tokens AS output_tokens, stop_reason, duration_ms"""


def _flat(records: DataFrame) -> DataFrame:
    return records.select(
        "hour_key", "metadata.seq_id", V.text_of(F.col("request.model"), "").alias("model"),
        F.size(V.items(F.col("request.messages"))).cast("bigint").alias("turns"),
        "response.text", "response.thinking", "response.is_streaming",
        _tokens("response.usage", "input_tokens"), _tokens("response.usage", "output_tokens"),
        "response.stop_reason", "metadata.duration_ms",
    )


@query(f"{_RECORDS} SELECT {_RECORD} FROM records WHERE nth = 1")
def clean_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(cleaning.clean_dataset(capture_log(spark, sf_dir)))


@query(f"{_RECORDS} SELECT {_RECORD} FROM records WHERE nth = 1 AND out_len >= 200")
def clean_min_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(cleaning.clean_dataset(capture_log(spark, sf_dir), min_output_len=200))


@query(f"""{_RECORDS} SELECT 'hour' AS scope, seq_id FROM records WHERE nth = 1
    UNION ALL SELECT 'global', seq_id FROM records WHERE nth_global = 1""")
def dedup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one pass: the payloads are decoded once, both scopes come from the hash and two narrow columns
    records = cleaning.clean_records(capture_log(spark, sf_dir)).select("hour_key", "seq_id", "dedup_key")
    first = records.groupBy("hour_key", "dedup_key").agg(F.min("seq_id").alias("seq_id"))
    over_all = F.row_number().over(Window.partitionBy("dedup_key").orderBy("seq_id")) == 1
    scopes = F.when(F.col("_all"), F.array(F.lit("hour"), F.lit("global"))).otherwise(F.array(F.lit("hour")))
    return first.withColumn("_all", over_all).select(F.explode(scopes).alias("scope"), "seq_id")


@query(f"""{_RECORDS} SELECT hour_key, count(*) AS records_total, count(*) FILTER (nth > 1) AS records_deduped,
        count(*) FILTER (nth = 1 AND out_len < 200) AS short_output, count(*) FILTER (nth = 1 AND out_len >= 200) AS records_kept
    FROM records GROUP BY 1""")
def clean_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_stats(capture_log(spark, sf_dir), 200)


@query(f"{_RECORDS} SELECT hour_key, count(*) AS records_kept FROM records WHERE nth = 1 GROUP BY 1")
def archivable_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.archivable_hours(capture_log(spark, sf_dir))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "dataset")
    dataset.write_dataset(cleaning.clean_dataset(capture_log(spark, sf_dir)), path)
    return dataset.read_dataset(spark, path)


@query(f"{_RECORDS} SELECT {_RECORD} FROM records WHERE nth = 1")
def dataset_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_written(spark, sf_dir))


@query(f"""{_RECORDS} SELECT hour_key, seq_id, model, CAST(len(asked) AS BIGINT) AS turns, length(reply) AS text_len,
        length(thought) AS thinking_len, streamed AS is_streaming, stop_reason, asked_len AS input_tokens,
        out_tokens AS output_tokens, duration_ms, row_number() OVER (PARTITION BY hour_key ORDER BY seq_id) - 1 AS rec_no
    FROM records WHERE nth = 1""")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.dataset_summary(_written(spark, sf_dir))


@query(f"""{_RECORDS} SELECT hour_key, count(*) AS records, count(*) AS archived_records, true AS verified
    FROM records WHERE nth = 1 GROUP BY 1""")
def archive_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_dir(spark, "archive")
    report = archive.archive_hours(spark, capture_log(spark, sf_dir), f"{root}/archives", f"{root}/cleaned", keep_source=True)
    return report.drop("unreadable", "checksum")


# An archived hour gets late rows: they are added, nothing is replaced, and the log is empty afterwards.
# Of a request's copies over the whole hour one stays: the first that was stored. An hour without records stays in the log.
@query(f"""{_RECORDS}, runs AS (
        SELECT *, row_number() OVER (PARTITION BY hour_key, model, messages_json ORDER BY seq_id % 3 = 0, seq_id) AS nth_run FROM records),
    k AS (SELECT hour_key, bool_or(seq_id % 3 = 0) AS has_late, bool_or(seq_id % 3 <> 0) AS has_early FROM records GROUP BY 1)
    SELECT 'archive' AS part, hour_key, seq_id FROM runs WHERE nth_run = 1
    UNION ALL SELECT 'log', c.hour_key, c.seq_id FROM c LEFT JOIN k ON c.hour_key = k.hour_key
    WHERE NOT coalesce(has_late, false) AND (c.seq_id % 3 = 0 OR NOT coalesce(has_early, false))""")
def archive_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_dir(spark, "late-archive")
    rows = capture_log(spark, sf_dir)
    late = F.col("seq_id") % 3 == 0
    for part in (rows.where(~late), rows.where(late)):
        log_table.write_log(part, f"{root}/log")
        now = datetime(2030, 1, 1)
        jobs.archive_pending(spark, f"{root}/log", f"{root}/archives", now, everything=True)
    archived = archive.read_lines(spark, f"{root}/archives").select(F.lit("archive").alias("part"), "hour_key", "seq_id")
    left = log_table.read_or_empty(spark, f"{root}/log", LOG_SCHEMA).select(F.lit("log").alias("part"), "hour_key", "seq_id")
    return archived.union(left)


@query(f"""{C} SELECT seq_id, concat_ws(',', 'model', 'messages', CASE WHEN c % 3 <> 0 THEN 'system' END, 'max_tokens',
        CASE WHEN c % 10 <> 9 THEN 'temperature' END, CASE WHEN c % 6 = 0 THEN 'top_p' END,
        CASE WHEN c % 4 < 2 THEN 'tools' END, CASE WHEN c % 6 <> 5 THEN 'tool_choice' END) AS keys,
        CASE c % 6 WHEN 0 THEN 'auto' WHEN 1 THEN 'any' WHEN 2 THEN 'none' WHEN 3 THEN 'tool' WHEN 4 THEN 'other' END AS choice
    FROM c""")
def request_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = turns.parsed_body(decoded_log(spark, sf_dir))
    kept = decoding.compute_once(parsed, cleaning.request_fields(F.col("body_json")), "r", "seq_id")
    keys = [F.when(F.col(f"r.{key}").isNotNull(), F.lit(key)) for key in cleaning.REQUEST_KEYS]
    return kept.select("seq_id", F.concat_ws(",", *keys).alias("keys"), V.text_of(F.col("r.tool_choice"), "type").alias("choice"))


# ------------------------------------------------------------------ pages and details

@query(f"""{C} SELECT seq_id, strftime(ts, '%H:%M:%S') AS time, CAST(len(list_filter(asked, lambda t: t.role <> 'system')) AS BIGINT)
        AS msg_count, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 50) AS BIGINT) AS total_pages
    FROM c ORDER BY ts DESC, seq_id DESC LIMIT 50""")
def request_page_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = paging.request_page(capture_log(spark, sf_dir), page=1, limit=50)
    return page.select("seq_id", "time", "msg_count", "total", "total_pages")


@query(f"""{C} SELECT seq_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, hour_key, 'POST' AS method, path, model, 200 AS status,
        duration_ms, strlen(body_text) AS body_len, CAST(NULL AS VARCHAR) AS error,
        CAST(len(list_filter(asked, lambda t: t.role <> 'system')) AS BIGINT) AS messages,
        CAST(CASE c % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS BIGINT) AS tools,
        CASE WHEN NOT replied THEN '' WHEN path = '/v1/messages' THEN shown ELSE response_text END AS text,
        CASE WHEN replied AND path = '/v1/messages' THEN thinking_shown ELSE '' END AS thinking,
        CASE WHEN readable AND path = '/v1/messages' THEN stop_reason END AS stop_reason,
        md5(coalesce(response_text, '')) AS raw_md5
    FROM c""")
def request_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decoding.with_shown_reply(decoded_log(spark, sf_dir))
    return turns.request_detail(rows).select(
        "seq_id", "ts", "hour_key", "method", "path", "model", "status", "duration_ms", "body_len", "error",
        F.size("messages").cast("bigint").alias("messages"), F.size("tools").cast("bigint").alias("tools"),
        "reply.text", "reply.thinking", "reply.stop_reason", F.md5("raw_text").alias("raw_md5"),
    )
