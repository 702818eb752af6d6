import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import START, reply, request, sse, delta
from tidelog.functions import hours as H
from tidelog.operators import archive, decoding, merge, paging, reports, rules, scans, search, search_index
from tidelog.operators import tokens as tk
from tidelog.operators.numbering import number_rows
from tidelog.sources import log_table


def _hours_read(df):
    """Hours that the scan's partition filters name."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = " ".join(line.split("PartitionFilters: ")[1].split("], ")[0] for line in plan.splitlines() if "PartitionFilters: " in line)
    return len(set(re.findall(r"\d{4}-\d\d-\d\d_\d\d", filters)))


def ids(df):
    return [r.seq_id for r in df.collect()]


# ------------------------------------------------------------------ scans and pages

def test_scans(log):
    day = timedelta(days=1)
    df = log({"seq_id": 5}, {"seq_id": 2}, {"ts": START + timedelta(hours=1)}, {"ts": START + day}, {"ts": START - day})
    assert ids(scans.scan_window(df, "2024-05-01_10")) == [2, 5]
    assert ids(scans.list_requests(df, date="2024-05-01")) == [5, 2, 3]
    assert ids(scans.list_requests(df, date="2024-05-01", hour="11")) == [3]
    assert len(ids(scans.list_requests(df, hour="11"))) == 5  # an hour alone is ignored
    assert ids(scans.get_request(df, 4)) == [4] and ids(scans.get_request(df, 99)) == []
    assert ids(scans.latest(df)) == [4]
    assert scans.first_hour_of_day(df, "2024-05-01").first().hour_key == "2024-05-01_10"
    assert scans.first_hour_of_day(df, "2023-01-01").first().hour_key is None
    assert [r.date for r in scans.list_dates(df).collect()] == ["2024-05-02", "2024-05-01", "2024-04-30"]
    recent = scans.time_filter(df, as_of=START + timedelta(hours=2))
    assert sorted(ids(recent)) == [2, 3, 4, 5]
    with pytest.raises(ValueError):
        scans.time_filter(df)


def test_underscore_is_no_wildcard(log):
    assert ids(scans.list_requests(log({"hour_key": "2024-05-01x10"}), date="2024-05-01")) == []


def test_pages_do_not_overlap_on_equal_times(log):
    df = log(*[{"ts": START} for _ in range(7)])
    pages = [ids(paging.newest_first(df, n, 3)) for n in (1, 2, 3, 4)]
    assert pages == [[7, 6, 5], [4, 3, 2], [1], []]


def test_request_page(log):
    talk = {"model": "m", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"content": "x"}]}
    df = log({"body": talk}, {"body": None}, {"body": b"junk", "status": 500}, {"model": "other"})
    rows = paging.request_page(df, limit=2, model="m1").collect()
    assert [(r.seq_id, r.msg_count, r.total, r.total_pages) for r in rows] == [(3, 0, 3, 2), (2, 0, 3, 2)]
    assert paging.request_page(df, page=2, limit=2, model="m1").first().msg_count == 2
    assert paging.request_page(df, status=500).first().seq_id == 3


def test_pages_by_rank(log):
    rng = random.Random(4)
    hour = timedelta(hours=1)
    rows = [{"ts": START + rng.randrange(9) * hour + timedelta(seconds=rng.randrange(4) * 600)} for _ in range(60)]
    df = log(*rows)
    want = ids(df.orderBy(F.desc("ts"), F.desc("seq_id")))
    for limit in (1, 7, 60, 100):
        pages = [paging.newest_by_rank(df, page, limit) for page in range(1, 60 // limit + 3)]
        assert [i for page, _ in pages for i in ids(page)] == want and {total for _, total in pages} == {60}
    assert ids(paging.newest_by_rank(df.limit(0), 1, 5)[0]) == []
    with pytest.raises(ValueError):
        paging.newest_by_rank(df, 0, 5)


def test_pages_by_rank_where_hours_overlap(log):
    hour = timedelta(hours=1)
    late = {"ts": START + 3 * hour, "hour_key": "2024-05-01_10"}  # an hour whose rows reach into another
    df = log({}, late, {"ts": START + hour}, {"ts": START + 3 * hour}, {"ts": START + 5 * hour}, {}, {"ts": START + 4 * hour})
    df = df.withColumn("ts", F.when(F.col("seq_id") != 6, F.col("ts")))
    df = df.withColumn("hour_key", F.when(F.col("seq_id") != 5, F.col("hour_key")))
    want = ids(df.orderBy(F.desc("ts"), F.desc("seq_id")))
    assert want == [5, 7, 4, 2, 3, 1, 6]
    assert [i for n in range(1, 9) for i in ids(paging.newest_by_rank(df, n, 1)[0])] == want


def test_a_deep_page_and_a_lookup_open_few_hours(log, spark, tmp_path):
    path = str(tmp_path / "log")
    log_table.write_log(log(*[{"ts": START + timedelta(minutes=20 * n)} for n in range(60)]), path)
    df = log_table.read_log(spark, path)
    page, total = paging.newest_by_rank(df, 6, 6)
    assert total == 60 and ids(page) == [30, 29, 28, 27, 26, 25]
    assert _hours_read(page) == 2
    bounds = scans.id_bounds(df)
    for wanted, hours in ((31, 1), (99, 0)):
        found = scans.get_request(df, wanted, bounds)
        assert ids(found) == ([wanted] if hours else []) and _hours_read(found) == hours


# ------------------------------------------------------------------ reports and rules

def test_summary_counts_timeouts_as_pending(log):
    df = log({}, {"status": 500}, {"status": None, "error": "timeout", "response": None}, {"status": 0})
    s = reports.summary(df).first()
    assert (s.total, s.success, s.errors, s.pending, s.with_error) == (4, 1, 2, 1, 1)
    assert [r.c for r in df.orderBy("seq_id").select(rules.status_class().alias("c")).collect()] == ["ok", "err", "pending", "pending"]


def test_empty_log(log):
    empty = log({}).where("false")
    s = reports.summary(empty).first()
    assert (s.total, s.body_total, s.resp_total) == (0, 0, 0)
    assert reports.max_seq(empty) == 0
    assert reports.window_sizes(empty).count() <= 1


def test_window_sizes_total(log):
    df = log({"response": b"abc"}, {"response": None}, {"ts": START + timedelta(hours=1), "response": b"12345"})
    rows = reports.window_sizes(df).collect()
    assert [(r.hour_key, r.is_total, r.entries, r.resp_total) for r in rows] == [
        ("2024-05-01_11", False, 1, 5), ("2024-05-01_10", False, 2, 3), (None, True, 3, 8)
    ]


def test_activity_share(log):
    rows = [{"ts": START + timedelta(hours=h)} for h in (0, 1, 1, 1, 2)]
    got = [(r.hour_key[-2:], r.share) for r in reports.activity_share(log(*rows), window=2, shown=2).collect()]
    assert got == [("11", 100.0), ("12", 33.3)]


def test_high_water_mark_covers_archives(log):
    assert reports.max_seq(log({"seq_id": 4}), log({"seq_id": 9})) == 9


def test_labels(value):
    assert value(H.label_of, k="2024-05-01_10") == "2024-05-01 10:00"
    assert value(H.label_of, k="odd") == "odd" and value(H.hour_of, k="odd") == ""


def test_routes(log, spark):
    routes = spark.createDataFrame([("m1", "http://a/", True), ("", "http://never", False)], "model STRING, url STRING, patch_sse BOOLEAN")
    df = log({"model": "m1"}, {"model": "x"}, {"model": ""})
    got = rules.resolve_route(df, routes, "http://d//").orderBy("seq_id").collect()
    assert [(r.url, r.patch_sse, r.target) for r in got] == [
        ("http://a/", True, "http://a/v1/messages"), ("http://d//", False, "http://d/v1/messages"),
        ("http://d//", False, "http://d/v1/messages"),
    ]


def test_numbering_matches_brute_force(spark):
    keys = [(g, k) for g in "ab" for k in sorted({(i * i * 7919) % 1000 - 200 for i in range(60)})]
    df = spark.createDataFrame(keys, "g STRING, k BIGINT")
    got = {(r.g, r.k): r.n for r in number_rows(df, "k", "n", within=["g"], start=5, width=8).collect()}
    for g in "ab":
        ordered = sorted(k for h, k in keys if h == g)
        assert [got[g, k] for k in ordered] == list(range(5, 5 + len(ordered)))
    whole = [r.n for r in number_rows(df.where("g = 'a'"), "k", "n", width=8).orderBy("k").collect()]
    assert whole == list(range(1, len(whole) + 1))


def test_first_arrival_wins(spark):
    rows = spark.createDataFrame([(1, 5, "late"), (1, 2, "early"), (2, 1, "known"), (3, 9, "x")], "seq_id BIGINT, arrival_no BIGINT, what STRING")
    known = spark.createDataFrame([(2,)], "seq_id BIGINT")
    got = {r.seq_id: r.what for r in merge.new_rows(merge.first_arrivals(rows), known).collect()}
    assert got == {1: "early", 3: "x"}


# ------------------------------------------------------------------ search

def decoded(log, *rows):
    full = decoding.with_reply(decoding.decode(log(*rows)))
    return full.withColumn("reply_text", F.col("reply.text")).withColumn("reply_thinking", F.col("reply.thinking"))


def test_search_scopes(log):
    df = decoded(
        log,
        {"body": request("Needle here"), "response": reply("needle too")},
        {"body": request("no"), "response": sse(delta("a nee"), delta("dle\tsplit"))},
        {"body": request("no"), "response": reply("x", "deep NEEDLE")},
        {"body": request("needle"), "status": 500}, {"body": request("needle"), "method": "post"},
        {"body": request("needle"), "path": "/V1/MESSAGES", "error": "broken_pipe"},
    )
    hits = search.search(df, " nEEdle ").orderBy("seq_id").collect()
    assert [(h.seq_id, h.scope) for h in hits] == [(1, "body"), (2, "response"), (3, "response"), (6, "body")]
    assert hits[1].snippet == "a needle split "
    assert ids(search.search(df, "needle", "response").orderBy("seq_id")) == [1, 2, 3]
    assert ids(search.search(df, "needle", "body").orderBy("seq_id")) == [1, 6]
    page = search.search_page(search.search(df, "needle"), page=2, limit=3).collect()
    assert [(r.seq_id, r.total) for r in page] == [(1, 4)]
    assert search.search(df, "  ").count() == 0
    with pytest.raises(ValueError):
        search.search(df, "x", "tools")


def test_search_by_index_is_search(log, spark, tmp_path):
    rng = random.Random(7)
    words = ["alpha", "Beta", "GAMMA ray", "\u00c8RE l", "na\u00efve", "x", "\U0001f600 smile", "ab", "\u039f\u0394\u039f\u03a3"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [{"body": request(some(4)), "response": reply(some(3), some(2)), "ts": START + timedelta(minutes=9 * n)} for n in range(40)]
    rows += [{"body": request("only here: zyx"), "seq_id": 90_000}, {"body": None, "response": None}, {"body": request("zyx"), "status": 500}]
    df = decoded(log, *rows).drop("reply", "body", "response")
    log_path, path = str(tmp_path / "decoded"), str(tmp_path / "index")
    df.write.partitionBy("hour_key").parquet(log_path)
    df = spark.read.parquet(log_path)
    search_index.write_index(df, path)
    index = search_index.read_index(spark, path)
    for needle in ("zyx", "BETA", "gamma r", "\u00e8re L", "na\u00efve", "\U0001f600 s", "a x", "\u03bf\u03b4\u03bf", "absent", "ab", " ", "pha bet"):
        for scope in ("all", "body", "response") if needle == "BETA" else ("all",):
            want = sorted(map(tuple, search.search(df, needle, scope).collect()))
            assert sorted(map(tuple, search_index.search_indexed(df, index, needle, scope).collect())) == want, (needle, scope)
    rare = search_index.search_indexed(df, index, "zyx")
    assert ids(rare) == [90_000] and _hours_read(rare) == 1
    assert search_index.search_indexed(df, search_index.read_index(spark, str(tmp_path / "none")), "zyx").count() == 0
    lists = index.count()
    search_index.write_index(df, path)
    assert lists == search_index.read_index(spark, path).count()
    with pytest.raises(ValueError):
        search_index.search_indexed(df, index, "zyx", "tools")


def test_snippet_is_cut_around_the_hit(log):
    df = decoded(log, {"body": None, "response": reply("a" * 200 + "\nhit\r" + "b" * 200)})
    assert search.search(df, "HIT", "response").first().snippet == "a" * 79 + " hit " + "b" * 79
    long = decoded(log, {"body": None, "response": reply("q" * 400)})
    assert "q" * 280 in search.search(long, "q" * 280, "response").first().snippet


def test_detail_of_other_paths(log):
    rows = decoding.with_shown_reply(decoding.decode(log({"path": "/x", "response": "r" * 1200}, {"response": None}, {})))
    got = [(len(r.reply.text), r.reply.is_streaming) for r in rows.orderBy("seq_id").collect()]
    assert got == [(1200, False), (0, False), (len("a good answer"), False)]


def test_chunks(spark):
    parts = [(s, n, bytes([n % 256]) * (n % 3)) for s in (1, 2) for n in range(50)]
    df = spark.createDataFrame(parts[::-1], "seq_id BIGINT, chunk_no INT, bytes BINARY")
    want = b"".join(p[2] for p in parts if p[0] == 1)
    assert {bytes(r.bytes) for r in decoding.assemble_chunks(df, segment=7).collect()} == {want}


# ------------------------------------------------------------------ tokens

P = tk.TURN_PREFIX


@pytest.mark.parametrize(
    "tokens, sections",
    [
        ([P, 1, 5, P, 2, 9, 9], [(0, 0, 1), (3, 3, 2), (7, 4, None)]),
        ([P, 1, P], [(0, 0, 1), (3, 3, None)]),  # a prefix at the end starts nothing
        ([7, 7], [(2, 2, None)]),
        ([P], [(1, 1, None)]),
        ([], [(0, 0, None)]),
        ([5, P, 6], [(1, 1, 6), (3, 2, None)]),
    ],
)
def test_sections(spark, tokens, sections):
    df = spark.createDataFrame([(1, tokens, "m")], "seq_id BIGINT, token_ids ARRAY<INT>, model STRING")
    got = tk.token_sections(df).orderBy("section").collect()
    assert [(r.position, r.delta, r.label_token) for r in got] == sections
    assert tk.token_counts(df).first().num_tokens == len(tokens)


# ------------------------------------------------------------------ archive targets

def test_archive_targets(spark):
    windows = spark.createDataFrame([(f"2024-05-01_{h:02}",) for h in range(4)], "hour_key STRING")
    done = windows.where("hour_key < '2024-05-01_02'")

    def targets(**how):
        return [r.hour_key[-2:] for r in archive.archive_targets(windows, done, **how).collect()]

    assert targets() == ["02", "03"]
    assert targets(limit=1) == ["02"]
    assert targets(everything=True) == ["00", "01", "02", "03"]
    assert targets(before="2024-05-01_01") == ["00"]
    assert targets(day="2024-05-01", hour="03") == ["03"]
    for half in ({"day": "2024-05-01"}, {"hour": "01"}):
        with pytest.raises(ValueError):
            targets(**half)


def test_retention(spark):
    archives = spark.createDataFrame([("2024-05-01_23",), ("2024-05-02_00",)], "hour_key STRING")
    assert [r.hour_key for r in archive.expired(archives, date(2024, 5, 9), 7).collect()] == ["2024-05-01_23"]
    assert archive.expired(archives, date(2030, 1, 1), 0).count() == 0


def test_checksum_sees_equal_pairs(spark):
    once = spark.createDataFrame([("h", 1, "a"), ("h", 2, "b")], "hour_key STRING, seq_id BIGINT, value STRING")
    other = spark.createDataFrame([("h", 1, "a"), ("h", 1, "a")], "hour_key STRING, seq_id BIGINT, value STRING")
    assert archive.verify(once, once).first().verified is True
    assert archive.verify(once, other).first().verified is False
    assert archive.verify(once, once.where("false")).first().verified is False


def test_hour_key_is_utc(spark):
    df = spark.createDataFrame([(1714557600.0,)], "ts_epoch DOUBLE").select(H.hour_key(F.timestamp_seconds("ts_epoch")).alias("k"))
    assert df.first().k == "2024-05-01_10"
    assert H.span_of("2024-05-01", "10")[0] == datetime(2024, 5, 1, 10)
