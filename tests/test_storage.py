import gzip
import json
import os
from datetime import timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import START, reply, request
from tidelog import session
from tidelog.functions import codec
from tidelog.operators import archive, cleaning, reports, scans
from tidelog.schema import LOG_SCHEMA
from tidelog.sources import dataset, log_table, routes
from tidelog.plans import jobs
from tidelog.streaming import hourly, ingest, late
from tidelog.streaming.batches import run_to_end

HOUR = timedelta(hours=1)


def hour_folders(path):
    return sorted(name for name in os.listdir(path) if name.startswith("hour_key="))


# ------------------------------------------------------------------ log and dataset

def test_log_table(spark, log, tmp_path):
    path = str(tmp_path / "log")
    log_table.write_log(log({"seq_id": 3}, {"seq_id": 1}, {"ts": START + HOUR, "response": None}), path)
    log_table.write_log(log({"seq_id": 9, "ts": START + HOUR}), path)
    back = log_table.read_log(spark, path)
    assert back.count() == 4 and dict(back.dtypes)["hour_key"] == "string"
    pruned = back.where("hour_key = '2024-05-01_11'")
    assert "PartitionFilters: [isnotnull(hour_key" in pruned._jdf.queryExecution().executedPlan().toString()
    log_table.drop_hours(spark, path, ["2024-05-01_11", "2024-05-01_12"])
    assert hour_folders(path) == ["hour_key=2024-05-01_10"]


def test_encode_entries(spark):
    rows = spark.createDataFrame([("text", ""), ("", "e"), (None, None)], "body STRING, error STRING")
    stored = log_table.encode_entries(rows).collect()
    assert [r.error for r in stored] == [None, "e", None]
    assert gzip.decompress(stored[0].body) == b"text" and stored[1].body is None and stored[2].body is None


def test_keep_unarchived(log, spark):
    df = log({}, {"ts": START + HOUR, "status": 500})
    archived = spark.createDataFrame([("2024-05-01_11",)], "hour_key STRING")
    assert [r.seq_id for r in log_table.keep_unarchived(df, archived).collect()] == [1]


def test_dataset_file(spark, log, tmp_path):
    path = str(tmp_path / "dataset")
    body = {**request("é 😀"), "system": [{"type": "text", "text": "s"}], "temperature": None}
    records = cleaning.clean_dataset(log({"body": body, "response": reply("Grüße", stop_reason=None)}, {"ts": START + HOUR}))
    dataset.write_dataset(records, path)
    lines = [json.loads(r.value) for r in spark.read.text(f"{path}/hour_key=2024-05-01_10").collect()]
    assert set(lines[0]["request"]) == {"model", "messages", "system", "temperature"}
    assert lines[0]["response"]["text"] == "Grüße" and lines[0]["response"]["stop_reason"] is None
    spark.createDataFrame([("not json",), ("",)], "value STRING").write.mode("append").text(f"{path}/hour_key=2024-05-01_10")
    back = dataset.read_dataset(spark, path)
    summary = dataset.dataset_summary(back).orderBy("hour_key").collect()
    assert [(r.hour_key, r.rec_no, r.turns, r.text_len, r.stop_reason) for r in summary] == [
        ("2024-05-01_10", 0, 1, 5, None), ("2024-05-01_11", 0, 1, 13, "end_turn")
    ]
    assert dataset.record_at(back, "2024-05-01_11", 0).first().metadata.seq_id == 2
    assert dataset.record_at(back, "2024-05-01_11", 1).count() == 0


def test_routes_file(spark, tmp_path):
    path = tmp_path / "routes.json"
    path.write_text(json.dumps({"a": "http://a", "b": {"url": "http://b", "patch_sse": True, "cookie_file": "c"}, "__default_upstream__": "http://d"}, indent=1))
    table, default = routes.split_default(routes.load_routes(spark, str(path)))
    assert default == "http://d"
    assert sorted(tuple(r) for r in table.collect()) == [("a", "http://a", False), ("b", "http://b", True)]
    path.write_text('{"a": "http://a"}')
    assert routes.split_default(routes.load_routes(spark, str(path)))[1] == routes.FALLBACK_URL
    path.write_text('{"a": {"cookie_file": "c"}}')
    with pytest.raises(PySparkException):
        routes.load_routes(spark, str(path)).collect()


# ------------------------------------------------------------------ archive

def stored(spark, path):
    return log_table.read_log(spark, path)


def test_archive_and_purge(spark, log, tmp_path):
    path, out, staging = (str(tmp_path / n) for n in ("log", "archives", "cleaned"))
    log_table.write_log(log({}, {"status": 500}, {"ts": START + HOUR}, {"ts": START + 2 * HOUR, "response": None}), path)
    report = archive.archive_hours(spark, stored(spark, path), out, staging)
    assert sorted((r.hour_key[-2:], r.records, r.verified) for r in report.collect()) == [("10", 1, True), ("11", 1, True)]
    # rejected rows of an archived hour go too; an hour without records stays
    assert hour_folders(path) == ["hour_key=2024-05-01_12"]
    line = archive.read_lines(spark, out).orderBy("hour_key").first()
    assert json.loads(line.value)["response"]["text"] == "a good answer"
    assert not os.path.exists(staging)


def test_failed_check_keeps_the_source(spark, log, tmp_path, monkeypatch):
    path, out, staging = (str(tmp_path / n) for n in ("log", "archives", "cleaned"))
    log_table.write_log(log({}, {"ts": START + HOUR}), path)
    real = archive.verify
    monkeypatch.setattr(archive, "verify", lambda a, b: real(a, b.where("hour_key <> '2024-05-01_11'")))
    archive.archive_hours(spark, stored(spark, path), out, staging)
    assert hour_folders(path) == ["hour_key=2024-05-01_11"]
    assert hour_folders(out) == ["hour_key=2024-05-01_10"]


def test_keep_source(spark, log, tmp_path):
    path, out, staging = (str(tmp_path / n) for n in ("log", "archives", "cleaned"))
    log_table.write_log(log({}), path)
    archive.archive_hours(spark, stored(spark, path), out, staging, keep_source=True)
    assert hour_folders(path) == hour_folders(out) == ["hour_key=2024-05-01_10"]
    # again: the same records are there already
    archive.archive_hours(spark, stored(spark, path), out, f"{staging}2", keep_source=True)
    assert archive.read_lines(spark, out).count() == 1


def test_late_rows_are_added_to_an_archive(spark, log, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "archives")
    log_table.write_log(log(*({"body": request(f"q{n}")} for n in range(3))), path)
    archive.archive_hours(spark, stored(spark, path), out, str(tmp_path / "s1"))
    log_table.write_log(log({"seq_id": 9, "body": request("late")}), path)
    report = archive.archive_hours(spark, stored(spark, path), out, str(tmp_path / "s2")).collect()
    assert [(r.records, r.verified) for r in report] == [(1, True)]
    assert sorted(r.seq_id for r in archive.read_lines(spark, out).collect()) == [1, 2, 3, 9]
    assert hour_folders(path) == []


def test_rows_that_land_during_a_run_stay(spark, log, tmp_path, monkeypatch):
    path, out = str(tmp_path / "log"), str(tmp_path / "archives")
    log_table.write_log(log({}), path)
    real = archive.verify

    def verify(a, b):
        log_table.write_log(log({"seq_id": 7, "body": request("meanwhile")}), path)
        return real(a, b)

    monkeypatch.setattr(archive, "verify", verify)
    archive.archive_hours(spark, stored(spark, path), out, str(tmp_path / "s1"))
    assert [r.seq_id for r in stored(spark, path).collect()] == [7]
    assert [r.seq_id for r in archive.read_lines(spark, out).collect()] == [1]


def test_a_failed_check_leaves_earlier_records(spark, log, tmp_path, monkeypatch):
    path, out = str(tmp_path / "log"), str(tmp_path / "archives")
    log_table.write_log(log({}), path)
    archive.archive_hours(spark, stored(spark, path), out, str(tmp_path / "s1"))
    log_table.write_log(log({"seq_id": 9, "body": request("late")}), path)
    real = archive.verify
    monkeypatch.setattr(archive, "verify", lambda a, b: real(a, b.where("false")))
    archive.archive_hours(spark, stored(spark, path), out, str(tmp_path / "s2"))
    assert [r.seq_id for r in archive.read_lines(spark, out).collect()] == [1]
    assert [r.seq_id for r in stored(spark, path).collect()] == [9]


def test_unreadable_bodies_are_kept_apart(spark, log, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "archives")
    log_table.write_log(log({}, {"body": gzip.compress(b'{"messages": [NaN]}')}, {"body": b"no json"}, {"body": None}), path)
    report = archive.archive_hours(spark, stored(spark, path), out, str(tmp_path / "s1")).first()
    assert (report.records, report.unreadable, report.verified) == (1, 2, True)
    rejects = log_table.read_log(spark, f"{out}-rejects").orderBy("seq_id").collect()
    assert [r.seq_id for r in rejects] == [2, 3] and bytes(rejects[1].body) == b"no json"
    assert hour_folders(path) == []


# ------------------------------------------------------------------ landing

def test_landing_in_a_zone_with_clock_changes(spark):
    epochs = [1714557600.25, 1730611800.0, 1730615400.0, 1710054000.0]  # 2024: May 1, twice 01:30 on Nov 3, Mar 10
    rows = spark.createDataFrame([(n, e, '{"a": 1}', "") for n, e in enumerate(epochs)], "seq_id bigint, ts_epoch double, body string, error string")
    got = log_table.land_entries(rows, "America/New_York").orderBy("seq_id").collect()
    assert [r.hour_key for r in got] == ["2024-05-01_06", "2024-11-03_01", "2024-11-03_01", "2024-03-10_03"]
    assert str(got[0].ts) == "2024-05-01 10:00:00.250000" and got[0].error is None and got[0].status is None
    assert gzip.decompress(bytes(got[0].body)) == b'{"a": 1}'
    closes = spark.createDataFrame([("2024-11-03_01",), ("2024-03-10_01",), ("2024-05-01_06",)], "hour_key string")
    ends = [str(r[0]) for r in closes.select(late.closes_at(timedelta(0), "America/New_York")).collect()]
    assert ends == ["2024-11-03 07:00:00", "2024-03-10 07:00:00", "2024-05-01 11:00:00"]


def test_hours_are_found_by_key_alone(spark, log):
    rows = log({"hour_key": "2024-05-01_18"}, {"hour_key": "2024-05-01_03"}).withColumn("ts", F.when(F.col("seq_id") == 1, F.col("ts")))
    assert [r.seq_id for r in scans.scan_window(rows, "2024-05-01_18").collect()] == [1]
    assert scans.list_requests(rows, date="2024-05-01").count() == 2
    assert scans.time_filter(rows, as_of=START + timedelta(minutes=5)).count() == 2


# ------------------------------------------------------------------ streaming

ARRIVALS = f"{LOG_SCHEMA}, arrival_no BIGINT"


def land(df, folder, start):
    df.withColumn("arrival_no", F.col("seq_id") * 0 + start + F.monotonically_increasing_id()).coalesce(1).write.mode("append").parquet(folder)


def test_ingest_over_restarts(spark, log, tmp_path):
    landing, root, check = (str(tmp_path / n) for n in ("landing", "root", "checkpoint"))
    stream = lambda: spark.readStream.schema(ARRIVALS).parquet(landing)
    land(log({"error": "first"}, {"seq_id": 1, "error": "second"}, {"seq_id": 2_000_000}), landing, 0)
    run_to_end(ingest.start_ingest(stream(), root, check, available_now=True))
    # a later run: one id again, in another hour, and two new ones
    land(log({"seq_id": 1, "error": "replay", "ts": START + HOUR}, {"seq_id": 5}, {"seq_id": 6, "ts": START + HOUR}), landing, 100)
    run_to_end(ingest.start_ingest(stream(), root, check, available_now=True))
    rows = ingest.read_ingested(spark, root).orderBy("seq_id").collect()
    assert [(r.seq_id, r.error) for r in rows] == [(1, "first"), (5, None), (6, None), (2_000_000, None)]
    assert rows[2].hour_key == "2024-05-01_11"


def test_a_batch_run_again_changes_nothing(spark, log, tmp_path):
    sink = ingest.LogSink(str(tmp_path))
    first = log({}, {}).withColumn("arrival_no", F.col("seq_id"))
    second = log({}, {"seq_id": 3}).withColumn("arrival_no", F.col("seq_id"))
    for batch, number in ((first, 0), (second, 1), (second, 1), (first.where("false"), 2)):
        sink(batch, number)
    assert sorted(r.seq_id for r in ingest.read_ingested(spark, str(tmp_path)).collect()) == [1, 2, 3]


def test_many_batches_and_their_compaction(spark, log, tmp_path):
    root = str(tmp_path)
    sink = ingest.LogSink(root)
    for number in range(8):
        late_by = 3 * 3_600_000.0 if number % 5 == 4 else 10.0
        rows = log({"seq_id": number, "duration_ms": late_by}, {"seq_id": max(0, number - 3), "error": "again"})
        sink(rows.withColumn("arrival_no", F.monotonically_increasing_id()), number)
    sink(log({"seq_id": 7}).withColumn("arrival_no", F.lit(0)), 7)  # run again
    kept, quarantined = ingest.read_ingested(spark, root).collect(), ingest.read_ingested(spark, root, "late").collect()
    assert sorted(r.seq_id for r in kept + quarantined) == list(range(8))
    assert sorted(r.seq_id for r in quarantined) == [4] and not any(r.error for r in kept)
    # open hours are left alone; a closed one is rewritten, and the folders of its batches go
    assert jobs.compact(spark, root, START) == 0
    assert jobs.compact(spark, root, START + 5 * HOUR) == 7
    assert [n for n in os.listdir(f"{root}/entries") if n.startswith("batch=") and n != "batch=4"] == ["batch=-1"]
    assert sorted(r.seq_id for r in ingest.read_ingested(spark, root).collect()) == [0, 1, 2, 3, 5, 6, 7]
    assert jobs.compact(spark, root, START + 5 * HOUR) == 0
    found = ingest.lookup(spark, root, 7)
    assert [r.seq_id for r in found.collect()] == [7] and ingest.lookup(spark, root, 999).count() == 0
    assert "PartitionFilters: [isnotnull(hour_key" in plan_of(found)
    known = ingest.known_ids(spark, f"{root}/keys", [0, 5])
    assert known.count() == 8 and ingest.known_ids(spark, f"{root}/keys", [3]).count() == 0


def test_late_rows_reach_the_archive(spark, log, tmp_path):
    root, out = str(tmp_path / "root"), str(tmp_path / "archives")
    sink = ingest.LogSink(root)
    rows = log({"body": request("in time")}, {"body": request("late"), "duration_ms": 3 * 3_600_000.0})
    sink(rows.withColumn("arrival_no", F.col("seq_id")), 0)
    now = START + 50 * HOUR
    jobs.archive_pending(spark, f"{root}/entries", out, now)
    assert [r.seq_id for r in archive.read_lines(spark, out).collect()] == [1]
    jobs.archive_late(spark, root, out, now)
    assert sorted(r.seq_id for r in archive.read_lines(spark, out).collect()) == [1, 2]
    assert ingest.read_ingested(spark, root).count() == ingest.read_ingested(spark, root, "late").count() == 0


def test_text_bodies_are_encoded(spark, log, tmp_path):
    rows = log({}).withColumn("body", F.lit('{"a":1}')).withColumn("arrival_no", F.lit(0))
    ingest.LogSink(str(tmp_path))(rows, 0)
    assert gzip.decompress(bytes(ingest.read_ingested(spark, str(tmp_path)).first().body)) == b'{"a":1}'


def test_hourly_counts_take_late_rows(spark, log, tmp_path):
    landing, out, check = (str(tmp_path / n) for n in ("landing", "out", "checkpoint"))
    stream = lambda: spark.readStream.schema(LOG_SCHEMA).parquet(landing)
    log({"body": b"ab"}, {"body": b"abc", "ts": START + 50 * HOUR}).write.mode("append").parquet(landing)
    run_to_end(hourly.start_hourly(stream(), out, check, available_now=True))
    groups = hourly.start_summary(stream(), f"{out}-groups", f"{check}-groups", available_now=True)
    run_to_end(groups)
    log({"body": b"a", "ts": START + timedelta(minutes=5)}).write.mode("append").parquet(landing)
    run_to_end(hourly.start_hourly(stream(), out, check, available_now=True))
    rows = hourly.read_hourly(spark, out).orderBy("hour_start").collect()
    assert [(r.hour_start.hour, r["count"], r.body_total) for r in rows] == [(10, 2, 3), (12, 1, 3)]
    run_to_end(hourly.start_summary(stream(), f"{out}-groups", f"{check}-groups", available_now=True))
    kept = hourly.read_summary(spark, f"{out}-groups")
    assert reports.summary_of(kept).first() == reports.summary(spark.read.schema(LOG_SCHEMA).parquet(landing)).first()
    assert kept.count() == 2


def test_late_rows(spark, log, tmp_path):
    end = START + HOUR - timedelta(seconds=1)
    df = log({"ts": end, "duration_ms": 1000.0}, {"ts": end, "duration_ms": 1000.001}, {"ts": end, "duration_ms": 1801_000.5})
    assert [r.seq_id for r in late.late_rows(df, timedelta(0)).orderBy("seq_id").collect()] == [2, 3]
    assert [r.seq_id for r in late.late_rows(df).collect()] == [3]
    assert log({"duration_ms": None}).where(~late.is_late()).count() == 1
    windows = df.select("hour_key").distinct()
    closed = lambda minute: late.closed_hours(windows, F.lit(f"2024-05-01 11:{minute}:00").cast("timestamp_ntz")).count()
    assert (closed("29"), closed("30")) == (0, 1)


# ------------------------------------------------------------------ working folder

def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    base = session.shared_dir(spark)
    assert session.work_dir(spark, "x") != session.work_dir(spark, "x")
    assert session.work_dir(spark, "x").startswith(base)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or base == configured.rstrip("/")


# ------------------------------------------------------------------ archive runs cost what is new

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_an_archived_request_are_left_out(spark, log, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "archives")
    log_table.write_log(log({"body": request("same")}, {"body": request("other")}), path)
    archive.archive_hours(spark, stored(spark, path), out, str(tmp_path / "s1"))
    late = log({"seq_id": 3, "body": request("same")}, {"seq_id": 4, "body": request("same"), "ts": START + HOUR}, {"seq_id": 5, "body": request("new")})
    log_table.write_log(late, path)
    report = archive.archive_hours(spark, stored(spark, path), out, str(tmp_path / "s2")).collect()
    # the copy in another hour stays
    assert sorted(r.seq_id for r in archive.read_lines(spark, out).collect()) == [1, 2, 4, 5]
    assert sorted((r.hour_key[-2:], r.records, r.verified) for r in report) == [("10", 1, True), ("11", 1, True)]
    assert hour_folders(path) == []
    log_table.write_log(log({"seq_id": 9, "body": request("same"), "ts": START + HOUR}), path)
    archive.archive_hours(spark, stored(spark, path), out, str(tmp_path / "s3"), scope="global")
    # nothing to add, and nothing left behind
    assert archive.read_lines(spark, out).count() == 4 and hour_folders(path) == []


def test_a_short_first_copy_hides_later_runs_too(spark, log, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "archives")
    log_table.write_log(log({"body": request("q"), "response": reply("short")}), path)
    archive.archive_hours(spark, stored(spark, path), out, str(tmp_path / "s1"), keep_source=True, min_output_len=20)
    log_table.write_log(log({"seq_id": 2, "body": request("q"), "response": reply("an answer that is long enough")}), path)
    archive.archive_hours(spark, stored(spark, path), out, str(tmp_path / "s2"), min_output_len=20)
    assert archive.read_lines(spark, out).count() == 0


def test_a_run_opens_its_own_hours_only(spark, log, tmp_path, monkeypatch):
    path, out = str(tmp_path / "log"), str(tmp_path / "archives")
    log_table.write_log(log({}, {"ts": START + HOUR}, {"ts": START + 2 * HOUR}), path)
    now = START + 50 * HOUR
    jobs.archive_pending(spark, path, out, now, limit=1)
    first = archive.read_lines(spark, out).inputFiles()
    seen = []
    real = archive.read_or_empty

    def spy(session, where, schema):
        frame = real(session, where, schema)
        if where == out and frame.inputFiles():
            chosen = frame.where(F.col("hour_key").isin(["2024-05-01_11"]))
            seen.append({r.f for r in chosen.select(F.input_file_name().alias("f")).distinct().collect()})
        return frame

    real_verify = archive.verify

    def verify(want, got):
        assert "PartitionFilters: [hour_key" in plan_of(got) or "PartitionFilters: [isnotnull(hour_key" in plan_of(got)
        return real_verify(want, got)

    monkeypatch.setattr(archive, "read_or_empty", spy)
    monkeypatch.setattr(archive, "verify", verify)
    report = jobs.archive_pending(spark, path, out, now, limit=1).collect()
    assert [r.hour_key[-2:] for r in report] == ["11"] and seen
    assert not {os.path.basename(f) for f in first} & {os.path.basename(f) for files in seen for f in files}
    runs = archive.read_report(spark, out).collect()
    assert sorted((r.hour_key[-2:], r.records, r.verified) for r in runs) == [("10", 1, True), ("11", 1, True)]
    assert all(r.checksum is not None for r in runs)
