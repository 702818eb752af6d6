"""Table schemas."""

from __future__ import annotations

# One row per captured request. ``ts`` is the request start, UTC wall clock.
LOG_SCHEMA = """
    ts_epoch DOUBLE, ts TIMESTAMP_NTZ, seq_id BIGINT, method STRING, path STRING, model STRING,
    upstream STRING, body BINARY, body_len BIGINT, response BINARY, status INT,
    duration_ms DOUBLE, error STRING, hour_key STRING
"""

LOG_COLUMNS = [part.split()[0] for part in LOG_SCHEMA.split(",")]
LOG_TYPES = dict(part.split() for part in LOG_SCHEMA.split(","))

# The log with its payloads decoded and its replies rebuilt.
DECODED_SCHEMA = """
    ts_epoch DOUBLE, ts TIMESTAMP_NTZ, seq_id BIGINT, method STRING, path STRING, model STRING,
    upstream STRING, body_len BIGINT, status INT, duration_ms DOUBLE, error STRING,
    body_text STRING, resp_size BIGINT, response_text STRING, reply_text STRING, reply_thinking STRING,
    hour_key STRING
"""

# Request keys a dataset record keeps.
REQUEST_KEYS = [
    "model", "messages", "system", "max_tokens", "temperature", "top_p", "top_k",
    "tools", "tool_choice", "thinking", "betas",
]

REQUEST_TYPE = "STRUCT<" + ", ".join(f"{key}: VARIANT" for key in REQUEST_KEYS) + ">"
TOOL_CALL_TYPE = "STRUCT<id: STRING, name: STRING, input_json: STRING>"
RESPONSE_TYPE = (
    "STRUCT<text: STRING, thinking: STRING, is_streaming: BOOLEAN, "
    "usage: MAP<STRING, VARIANT>, stop_reason: STRING>"
)
METADATA_TYPE = "STRUCT<seq_id: BIGINT, model: STRING, status: INT, duration_ms: DOUBLE>"

# One line of a dataset file; hour_key is the partition folder.
DATASET_SCHEMA = f"request {REQUEST_TYPE}, response {RESPONSE_TYPE}, metadata {METADATA_TYPE}"

# Path part that marks a chat request (fixed value).
MESSAGES_PATH = "/v1/messages"
