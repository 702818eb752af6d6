import gzip
import json
from datetime import timedelta

import pytest

from tests.conftest import START, delta, reply, request, sse, stop
from tidelog.operators import cleaning, rules


def kept(df, **options):
    return [r.seq_id for r in cleaning.clean_dataset(df, **options).orderBy("seq_id").collect()]


REJECTED = {
    "no status": {"status": None, "error": "timeout"},
    "server error": {"status": 500},
    "client gone": {"error": "broken_pipe"},
    "get": {"method": "GET"},
    "other path": {"path": "/v1/models"},
    "path in other case": {"path": "/V1/MESSAGES"},
    "no body": {"body": None},
    "bad gzip": {"body": b"\x1f\x8bnope"},
    "plain body": {"body": json.dumps(request("x")).encode()},
    "no json": {"body": gzip.compress(b"{not json")},
    "json list": {"body": [1]},
    "no messages": {"body": {"model": "m"}},
    "empty messages": {"body": {"model": "m", "messages": []}},
    "null messages": {"body": {"model": "m", "messages": None}},
    "no response": {"response": None},
    "empty response": {"response": b""},
    "one character": {"response": reply("a", "b")},
    "spaces only": {"response": reply(" 　 a \n")},
    "plain text": {"response": "sorry"},
    "json list reply": {"response": "[1]"},
    "tool call only": {"response": json.dumps({"content": [{"type": "tool_use", "id": "i", "name": "n", "input": {}}]})},
}

ACCEPTED = {
    "plain": {},
    "lower case method": {"method": "post"},
    "longer path": {"path": "/v1/messages/count_tokens"},
    "empty error": {"error": ""},
    "thinking only": {"response": reply("", "long thought")},
    "stream": {"response": sse(delta("ab"), stop())},
    "gzip reply": {"response": gzip.compress(reply("fine").encode())},
    "two characters": {"response": reply("ab")},
    "bad bytes": {"response": reply("ok then").encode().replace(b"then", b"th\xffn")},
}


def test_every_row_rule(log):
    rows = [{**r, "body": r.get("body", request(name))} for name, r in {**REJECTED, **ACCEPTED}.items()]
    got = kept(log(*rows))
    names = list(REJECTED) + list(ACCEPTED)
    assert [names[i - 1] for i in got] == list(ACCEPTED)


@pytest.mark.parametrize(
    "row, reason",
    [
        ({}, None), ({"status": None}, "status"), ({"status": 500, "error": "x"}, "status"), ({"error": "x"}, "error"),
        ({"error": ""}, None), ({"method": "GET", "path": "/x"}, "method"), ({"method": "post"}, None),
        ({"path": "/x"}, "path"), ({"path": "/V1/messages"}, "path"),
    ],
)
def test_skip_reason(log, row, reason):
    df = log(row)
    assert df.select(rules.skip_reason().alias("r")).first().r == reason
    assert (df.where(rules.kept_row()).count() == 1) is (reason is None)


def test_record(log):
    body = {**request("q", model="inner"), "system": "s", "temperature": None, "stop_sequences": ["x"], "max_tokens": 5}
    text = sse({"type": "message_start", "message": {"usage": {"input_tokens": 3}}}, delta("Hé "), delta("llo"), stop("end_turn", output_tokens=2))
    row = cleaning.clean_dataset(log({"body": body, "response": text, "model": "outer", "duration_ms": 12.5})).first()
    sent = {k: json.loads(v.toJson()) for k, v in row.request.asDict().items() if v is not None}
    # a null is kept, unknown keys are not
    assert sent == {"model": "inner", "messages": body["messages"], "system": "s", "temperature": None, "max_tokens": 5}
    assert (row.response.text, row.response.thinking, row.response.is_streaming) == ("Hé llo", "", True)
    assert {k: v.toPython() for k, v in row.response.usage.items()} == {"input_tokens": 3, "output_tokens": 2}
    assert row.response.stop_reason == "end_turn"
    assert row.metadata.asDict() == {"seq_id": 1, "model": "outer", "status": 200, "duration_ms": 12.5}


def test_first_copy_wins_whatever_the_key_order(log):
    a = gzip.compress(b'{"model":"m","messages":[{"role":"user","content":"x"}]}')
    b = gzip.compress(b'{"messages":[{"content":"x","role":"user"}],"model":"m","max_tokens":9}')
    other_model = gzip.compress(b'{"model":"n","messages":[{"role":"user","content":"x"}]}')
    df = log({"body": a, "seq_id": 7}, {"body": b, "seq_id": 3}, {"body": other_model, "seq_id": 5})
    assert kept(df) == [3, 5]


def test_scope_of_dedup(log):
    later = START + timedelta(hours=2)
    df = log({"body": request("x")}, {"body": request("x"), "ts": later}, {"body": request("x"), "ts": later})
    assert kept(df) == [1, 2]
    assert kept(df, scope="global") == [1]
    with pytest.raises(ValueError):
        cleaning.dedup(df, "week")


def test_short_first_copy_hides_a_longer_one(log):
    rows = log(
        {"body": request("x"), "response": reply("short")}, {"body": request("x"), "response": reply("y" * 50)},
        {"body": request("z"), "response": reply("y" * 50)},
    )
    assert kept(rows, min_output_len=20) == [3]
    assert kept(rows) == [1, 3]
    stats = cleaning.clean_stats(rows, 20).first()
    assert (stats.records_total, stats.records_deduped, stats.short_output, stats.records_kept) == (3, 1, 1, 1)


def test_tool_calls_on_request(log):
    row = {"response": json.dumps({"content": [{"type": "tool_use", "id": "i", "name": "n", "input": {"k": 1}}]})}
    got = cleaning.clean_dataset(log(row), keep_tool_calls=True).first()
    assert [c.asDict() for c in got.response.tool_calls] == [{"id": "i", "name": "n", "input_json": '{"k":1}'}]


def test_compat_sniff_drops_a_reply_about_events(log):
    df = log({"response": reply("the message_start event")})
    assert kept(df) == [1]
    assert kept(df, compat_sniff=True) == []


def test_hours_without_records_are_not_archivable(log):
    df = log({}, {"ts": START + timedelta(hours=1), "response": reply("")})
    assert [r.hour_key for r in cleaning.archivable_hours(df).collect()] == ["2024-05-01_10"]


def test_hot_key_is_cut_before_the_shuffle(log):
    plan = cleaning.dedup(cleaning.clean_records(log({})))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_dedup_texts(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "doc_id BIGINT, text STRING")
    got = cleaning.dedup_texts(df, "doc_id", "text").orderBy("doc_id").select("doc_id", "copies").collect()
    assert [tuple(r) for r in got] == [(1, 2), (2, 1)]


def test_numbers_that_are_equal_dedup_together(log):
    """1 and 1.0 have one Variant text; this is a documented difference."""
    one = gzip.compress(b'{"model":"m","messages":[{"role":"user","content":"x","n":1}]}')
    same = gzip.compress(b'{"model":"m","messages":[{"role":"user","content":"x","n":1.0}]}')
    assert kept(log({"body": one}, {"body": same})) == [1]
