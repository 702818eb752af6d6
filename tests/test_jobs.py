import os
from datetime import datetime, timedelta

from tests.conftest import START, request
from tidelog.operators import archive, cleaning
from tidelog.plans import jobs
from tidelog.sources import dataset, log_table

HOUR = timedelta(hours=1)
LATER = START + timedelta(days=30)


def folders(path):
    return sorted(name[-2:] for name in os.listdir(path) if name.startswith("hour_key="))


def stored(log, tmp_path):
    path = str(tmp_path / "log")
    log_table.write_log(log({}, {"body": request("x")}, {"status": 500}, {"ts": START + HOUR}, {"ts": START + 2 * HOUR, "status": 500}), path)
    return path


def test_clean_one_hour_keeps_the_others(spark, log, tmp_path):
    path, out = stored(log, tmp_path), str(tmp_path / "dataset")
    stats = jobs.clean(spark, path, out).collect()
    assert [(s.hour_key[-2:], s.records_kept) for s in stats] == [("10", 2), ("11", 1)]
    jobs.clean(spark, path, out, hour_key="2024-05-01_11", min_output_len=5)
    assert folders(out) == ["10", "11"]
    assert dataset.read_dataset(spark, out).count() == 3


def test_clean_first_hour_of_a_day(spark, log, tmp_path):
    path, out = stored(log, tmp_path), str(tmp_path / "dataset")
    assert [s.hour_key[-2:] for s in jobs.clean(spark, path, out, day="2024-05-01").collect()] == ["10"]
    assert folders(out) == ["10"]
    assert jobs.clean(spark, path, out, day="2024-06-01").count() == 0


def test_archive_runs_add_up(spark, log, tmp_path):
    path, out = stored(log, tmp_path), str(tmp_path / "archives")
    plan = jobs.archive_pending(spark, path, out, LATER, dry_run=True)
    assert [r.hour_key[-2:] for r in plan.collect()] == ["10", "11", "12"]
    assert folders(path) == ["10", "11", "12"]
    jobs.archive_pending(spark, path, out, LATER, limit=1)
    assert (folders(path), folders(out)) == (["11", "12"], ["10"])
    jobs.archive_pending(spark, path, out, LATER, keep_source=True)
    assert (folders(path), folders(out)) == (["11", "12"], ["10", "11"])
    # archived already; the hour without records is looked at again and left alone
    assert jobs.archive_pending(spark, path, out, LATER).count() == 0
    assert archive.read_lines(spark, out).count() == 3


def test_open_hours_wait(spark, log, tmp_path):
    path, out = stored(log, tmp_path), str(tmp_path / "archives")
    open_at = datetime(2024, 5, 1, 12, 15)
    assert [r.hour_key[-2:] for r in jobs.archive_pending(spark, path, out, open_at, dry_run=True).collect()] == ["10"]


def test_retention(spark, log, tmp_path):
    path, out = stored(log, tmp_path), str(tmp_path / "archives")
    jobs.archive_pending(spark, path, out, LATER, retain_days=60)
    assert folders(out) == ["10", "11"]
    jobs.retain(spark, out, LATER.date(), 0)
    assert folders(out) == ["10", "11"]
    jobs.retain(spark, out, LATER.date(), 7)
    assert folders(out) == []


def test_a_stale_hour_goes(spark, log, tmp_path):
    path, out = stored(log, tmp_path), str(tmp_path / "dataset")
    jobs.clean(spark, path, out)
    assert folders(out) == ["10", "11"]
    stats = jobs.clean(spark, path, out, hour_key="2024-05-01_10", min_output_len=500)
    assert stats.first().records_kept == 0 and folders(out) == ["11"]


def test_clean_job_is_the_plain_pipeline(spark, log, tmp_path):
    path = str(tmp_path / "log")
    bodies = [request("a"), request("b"), request("a"), request("a"), request("c")]
    hours = [0, 0, 0, 1, 1]
    replies = ["short", "a longer answer", "a longer answer", "a longer answer", "x"]
    from tests.conftest import reply
    log_table.write_log(log(*({"body": b, "ts": START + h * HOUR, "response": reply(r)} for b, h, r in zip(bodies, hours, replies))), path)
    rows = log_table.read_log(spark, path)
    for scope in ("hour", "global"):
        for least in (2, 6):
            out = str(tmp_path / f"{scope}{least}")
            jobs.clean(spark, path, out, min_output_len=least, scope=scope)
            want = cleaning.clean_dataset(rows, least, scope)
            assert sorted(r.seq_id for r in want.collect()) == sorted(r.metadata.seq_id for r in dataset.read_dataset(spark, out).collect())
