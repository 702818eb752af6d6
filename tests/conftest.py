from __future__ import annotations

import gzip
import json
import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidelog.schema import LOG_SCHEMA
from tidelog.session import configure


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


START = datetime(2024, 5, 1, 10, 0, 0)


def sse(*events: dict | str) -> str:
    """Stream text; a string is taken as a raw frame."""
    frames = [e if isinstance(e, str) else f"event: {e['type']}\ndata: {json.dumps(e, ensure_ascii=False)}" for e in events]
    return "\n\n".join(frames) + "\n\n"


def start_text(text: str = "", index: int = 0) -> dict:
    return {"type": "content_block_start", "index": index, "content_block": {"type": "text", "text": text}}


def delta(text: str, index: int = 0) -> dict:
    return {"type": "content_block_delta", "index": index, "delta": {"type": "text_delta", "text": text}}


def stop(reason: str | None = "end_turn", **usage: int) -> dict:
    return {"type": "message_delta", "delta": {"stop_reason": reason}, "usage": usage}


def reply(text: str, thinking: str = "", **extra) -> str:
    blocks = ([{"type": "thinking", "thinking": thinking}] if thinking else []) + [{"type": "text", "text": text}]
    return json.dumps({"content": blocks, "usage": {"output_tokens": len(text)}, "stop_reason": "end_turn", **extra})


def request(*texts: str, model: str = "m1", **extra) -> dict:
    messages = [{"role": "user" if i % 2 == 0 else "assistant", "content": t} for i, t in enumerate(texts)]
    return {"model": model, "messages": messages, **extra}


@pytest.fixture()
def log(spark):
    """Build a log from dicts; every field has a default that passes all rules."""

    def build(*rows: dict):
        out = []
        for n, row in enumerate(rows, start=1):
            body = row.get("body", request("hello there"))
            if isinstance(body, dict | list):
                body = gzip.compress(json.dumps(body).encode())
            response = row.get("response", reply("a good answer"))
            if isinstance(response, str):
                response = response.encode()
            ts = row.get("ts", START + timedelta(seconds=n))
            out.append(
                (
                    ts.timestamp(), ts, row.get("seq_id", n), row.get("method", "POST"), row.get("path", "/v1/messages"),
                    row.get("model", "m1"), None, body, len(body or b""), response, row.get("status", 200),
                    row.get("duration_ms", 10.0), row.get("error"), row.get("hour_key", ts.strftime("%Y-%m-%d_%H")),
                )
            )
        return spark.createDataFrame(out, LOG_SCHEMA)

    return build


@pytest.fixture()
def value(spark):
    """Evaluate an expression over one row of named strings."""

    def run(make, **columns):
        names = ", ".join(f"{name} STRING" for name in columns)
        df = spark.createDataFrame([tuple(columns.values())], names)
        return df.select(make(*[F.col(name) for name in columns]).alias("v")).first().v

    return run
