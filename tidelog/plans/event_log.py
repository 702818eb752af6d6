"""The given ``events`` table seen as a request log, in Spark and in oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import LOG_COLUMNS

_STATUS = "CASE WHEN event_type = 'error' THEN 500 WHEN value < 1 THEN NULL ELSE 200 END"


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def from_events(events: DataFrame) -> DataFrame:
    """Row by row, so predicates and column pruning reach the scan."""
    return (
        events.selectExpr("*", f"CAST({_STATUS} AS INT) AS status")
        .selectExpr(
            "unix_micros(CAST(ts AS TIMESTAMP)) / 1000000D AS ts_epoch",
            "ts",
            "event_id + 1 AS seq_id",
            "CASE WHEN event_type = 'signup' THEN 'GET' ELSE 'POST' END AS method",
            "CASE event_type WHEN 'view' THEN '/v1/models' WHEN 'click' THEN '/v1/messages/count_tokens' "
            "ELSE '/v1/messages' END AS path",
            "concat('m', user_id % 7) AS model",
            "CAST(NULL AS STRING) AS upstream",
            "CAST(props AS BINARY) AS body",
            "CAST(length(props) AS BIGINT) AS body_len",
            "CASE WHEN status = 200 THEN CAST(props AS BINARY) END AS response",
            "status",
            "value * 100 AS duration_ms",
            "CASE WHEN status IS NULL THEN 'timeout' WHEN status = 200 AND event_id % 50 = 0 THEN 'broken_pipe' END "
            "AS error",
            "date_format(ts, 'yyyy-MM-dd_HH') AS hour_key",
        )
        .select(LOG_COLUMNS)
    )


# CTE ``e``: the same log, straight from the table.
E = f"""
WITH e0 AS (SELECT *, {_STATUS} AS status FROM events),
e AS (
    SELECT ts, event_id + 1 AS seq_id,
        CASE WHEN event_type = 'signup' THEN 'GET' ELSE 'POST' END AS method,
        CASE event_type WHEN 'view' THEN '/v1/models' WHEN 'click' THEN '/v1/messages/count_tokens'
            ELSE '/v1/messages' END AS path,
        'm' || (user_id % 7) AS model,
        CAST(length(props) AS BIGINT) AS body_len,
        CASE WHEN status = 200 THEN CAST(strlen(props) AS BIGINT) ELSE 0 END AS resp_size,
        status, value * 100 AS duration_ms,
        CASE WHEN status IS NULL THEN 'timeout' WHEN status = 200 AND event_id % 50 = 0 THEN 'broken_pipe' END AS error,
        strftime(ts, '%Y-%m-%d_%H') AS hour_key, props
    FROM e0
)
"""
