"""Queries over the log of ``events``."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions import hours as H
from ..operators import archive, merge, paging, reports, rules, scans
from ..operators.numbering import number_rows
from ..schema import LOG_SCHEMA
from ..session import work_dir
from ..sources import log_table, routes
from ..streaming import hourly, ingest, late
from ..streaming.batches import read_batches, run_to_end
from .event_log import E, event_log, from_events
from .registry import query

HOUR = "2024-01-05_10"
DAY = "2024-01-05"
AS_OF = datetime(2024, 1, 20, 12, 0, 0)

# What the catalog of archives holds in these queries: every hour of the first ten days.
ARCHIVED_UP_TO = "2024-01-11"

_FACTS = "seq_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, model, method, path, status, duration_ms, body_len"


def _facts(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "seq_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "model", "method", "path", "status",
        "duration_ms", "body_len", *more,
    )


def _archives(log: DataFrame) -> DataFrame:
    return log.select("hour_key").distinct().where(F.col("hour_key") < ARCHIVED_UP_TO)


# ------------------------------------------------------------------ scans

@query(f"{E} SELECT {_FACTS}, props AS body, CASE WHEN status = 200 THEN props END AS response, error, hour_key "
       f"FROM e WHERE hour_key = '{HOUR}'")
def scan_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scans.scan_window(event_log(spark, sf_dir), HOUR)
    return _facts(rows, F.decode("body", "utf-8").alias("body"), F.decode("response", "utf-8").alias("response"),
                  "error", "hour_key")


@query(f"{E} SELECT {_FACTS}, error, hour_key FROM e WHERE seq_id = 778")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(scans.get_request(event_log(spark, sf_dir), 778), "error", "hour_key")


@query(f"{E} SELECT {_FACTS}, resp_size FROM e WHERE hour_key LIKE '{DAY}%'")
def list_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(scans.list_requests(event_log(spark, sf_dir), date=DAY), "resp_size")


@query(f"""{E}
    SELECT 'hour' AS kind, seq_id FROM e WHERE hour_key = '{HOUR}'
    UNION ALL SELECT 'date', seq_id FROM e WHERE hour_key LIKE '{DAY}%'
    UNION ALL SELECT 'last day', seq_id FROM e WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY""")
def time_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)

    def tagged(kind: str, **how) -> DataFrame:
        return scans.time_filter(log, **how).select(F.lit(kind).alias("kind"), "seq_id")

    return tagged("hour", hour_key=HOUR).union(tagged("date", date=DAY)).union(tagged("last day", as_of=AS_OF))


@query(f"{E} SELECT DISTINCT hour_key FROM e")
def list_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.list_windows(event_log(spark, sf_dir))


@query(f"{E} SELECT DISTINCT hour_key[:10] AS date FROM e")
def list_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.list_dates(event_log(spark, sf_dir))


@query(f"{E} SELECT min(hour_key) AS hour_key FROM e WHERE hour_key LIKE '{DAY}%'")
def first_hour_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.first_hour_of_day(event_log(spark, sf_dir), DAY)


@query(f"{E} SELECT {_FACTS} FROM e ORDER BY e.ts DESC, seq_id DESC LIMIT 1")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(scans.latest(event_log(spark, sf_dir)))


@query("SELECT event_id + 1 AS seq_id, strftime(ts, '%Y-%m-%d_%H') AS hour_key FROM events")
def hour_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    started = F.timestamp_seconds("ts_epoch")
    return log.select("seq_id", H.hour_key(started).alias("hour_key"))


ZONES = {"-08:00": -480, "+05:30": 330}


# Captures know an epoch and the wall clock of their zone; bodies are landed in stored form.
@query(" UNION ALL ".join(
    f"""SELECT '{zone}' AS zone, event_id + 1 AS seq_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, props AS body,
        strftime(ts + to_minutes({minutes}), '%Y-%m-%d_%H') AS hour_key FROM events""" for zone, minutes in ZONES.items()
))
def land_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = event_log(spark, sf_dir).select("ts_epoch", "seq_id", "method", "path", F.decode("body", "utf-8").alias("body"))

    def landed(zone: str) -> DataFrame:
        rows = log_table.land_entries(captures, zone)
        return rows.select(
            F.lit(zone).alias("zone"), "seq_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
            codec.decode_body(F.col("body")).alias("body"), "hour_key",
        )

    west, east = map(landed, ZONES)
    return west.union(east)


# ------------------------------------------------------------------ rules

@query(f"""{E} SELECT CASE WHEN status IS DISTINCT FROM 200 THEN 'status' WHEN error IS NOT NULL THEN 'error'
        WHEN method <> 'POST' THEN 'method' WHEN path NOT LIKE '%/v1/messages%' THEN 'path' ELSE 'keep' END AS skip_reason,
        count(*) AS count FROM e GROUP BY 1""")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.skip_reasons(event_log(spark, sf_dir))


@query(f"""{E} SELECT CASE WHEN status = 200 THEN 'ok' WHEN coalesce(status, 0) = 0 THEN 'pending' ELSE 'err' END
        AS status_class, count(*) AS count FROM e GROUP BY 1""")
def status_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).groupBy(rules.status_class().alias("status_class")).agg(
        F.count(F.lit(1)).alias("count")
    )


ROUTES = (
    '{"_comment": "models and their upstreams", "m0": "http://zero:8000/", "m1": {"url": "http://one:8000/api"}, '
    '"m2": "http://two:8000", "m3": {"url": "http://three:8000/", "patch_sse": true}, "m4": "http://four", '
    '"__default_upstream__": "http://fallback:9000/"}'
)


def route_table(spark: SparkSession) -> tuple[DataFrame, str]:
    return routes.split_default(routes.routes_from_json(spark.range(1).select(F.lit(ROUTES).alias("value"))))


@query(f"""{E} SELECT seq_id, model, coalesce(r.url, 'http://fallback:9000/') AS url, coalesce(r.patch, false) AS patch_sse,
        rtrim(coalesce(r.url, 'http://fallback:9000/'), '/') || path AS target
    FROM e LEFT JOIN (VALUES ('m0', 'http://zero:8000/', false), ('m1', 'http://one:8000/api', false),
        ('m2', 'http://two:8000', false), ('m3', 'http://three:8000/', true), ('m4', 'http://four', false))
        r(name, url, patch) ON model = r.name""")
def resolve_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, default = route_table(spark)
    routed = rules.resolve_route(event_log(spark, sf_dir), table, default)
    return routed.select("seq_id", "model", "url", "patch_sse", "target")


# ------------------------------------------------------------------ reports

@query(f"""{E} SELECT count(*) AS total, count(*) FILTER (status = 200) AS success, count(*) FILTER (status <> 200) AS errors,
        count(*) FILTER (status IS NULL) AS pending, count(error) AS with_error,
        CAST(sum(body_len) AS BIGINT) AS body_total, CAST(sum(resp_size) AS BIGINT) AS resp_total FROM e""")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summary(event_log(spark, sf_dir))


@query(f"{E} SELECT model, count(*) AS count FROM e GROUP BY 1")
def by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_model(event_log(spark, sf_dir))


@query(f"{E} SELECT model, count(*) AS count FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")
def top_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_models(event_log(spark, sf_dir), 4)


@query(f"""{E} SELECT hour_key, hour_key[:10] AS date, hour_key[12:] AS hour, hour_key[:10] || ' ' || hour_key[12:] || ':00' AS label,
        count(*) AS count FROM e GROUP BY 1""")
def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hours(event_log(spark, sf_dir))


@query(f"{E} SELECT hour_key, count(*) AS count FROM e GROUP BY 1 ORDER BY 1 DESC LIMIT 30")
def recent_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recent_hours(event_log(spark, sf_dir))


@query(f"""{E}, h AS (SELECT hour_key, count(*) AS count FROM e GROUP BY 1 ORDER BY 1 DESC LIMIT 30)
    SELECT hour_key, count, round(count / greatest((SELECT max(count) FROM h), 1) * 100, 1) AS share
    FROM h ORDER BY 1 DESC LIMIT 15""")
def activity_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.activity_share(event_log(spark, sf_dir))


@query(f"""{E}, h AS (SELECT hour_key, count(*) AS n FROM e GROUP BY 1)
    SELECT hour_key[:10] AS date, string_agg(hour_key || '=' || n, ',' ORDER BY hour_key DESC) AS hours FROM h GROUP BY 1""")
def hours_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = reports.hours_by_date(event_log(spark, sf_dir))
    text = F.transform("hours", lambda h: F.concat(h["hour_key"], F.lit("="), h["count"].cast("string")))
    return listed.select("date", F.array_join(text, ",").alias("hours"))


@query(f"""{E} SELECT hour_key, grouping(hour_key) = 1 AS is_total, count(*) AS entries, CAST(sum(body_len) AS BIGINT) AS body_total,
        CAST(sum(resp_size) AS BIGINT) AS resp_total FROM e GROUP BY ROLLUP (hour_key)""")
def window_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.window_sizes(event_log(spark, sf_dir))


# New rows get ids behind those of the log: here the rows of ``events`` again, in order of arrival.
@query("""SELECT event_id AS arrival_no, (SELECT max(event_id) + 1 FROM events) + row_number() OVER (ORDER BY event_id)
        AS seq_id FROM events""")
def allocate_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    arrivals = log.select((F.col("seq_id") - 1).alias("arrival_no"))
    return number_rows(arrivals, "arrival_no", "seq_id", start=reports.max_seq(log) + 1)


@query(f"""{E}, p AS (SELECT *, count(*) OVER () AS total FROM e WHERE hour_key LIKE '{DAY}%' AND model = 'm2' AND status = 200)
    SELECT seq_id, strftime(ts, '%H:%M:%S') AS time, strftime(ts, '%Y-%m-%d') AS date, model, method, path, status,
        duration_ms, body_len, resp_size, CAST(0 AS BIGINT) AS msg_count, total, CAST(ceil(total / 10) AS BIGINT) AS total_pages
    FROM p ORDER BY ts DESC, seq_id DESC LIMIT 10 OFFSET 10""")
def request_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = scans.time_filter(event_log(spark, sf_dir), date=DAY)
    return paging.request_page(day, page=2, limit=10, model="m2", status=200)


# ------------------------------------------------------------------ archive

@query(f"{E} SELECT DISTINCT hour_key FROM e WHERE hour_key < '2024-01-08_14'")
def archive_targets_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = event_log(spark, sf_dir).select("hour_key").distinct()
    return archive.archive_targets(windows, windows, before="2024-01-08_14")


@query(f"{E} SELECT DISTINCT hour_key FROM e WHERE hour_key >= '{ARCHIVED_UP_TO}'")
def archive_targets_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return archive.archive_targets(log.select("hour_key").distinct(), _archives(log))


@query(f"{E} SELECT seq_id, hour_key FROM e WHERE hour_key >= '{ARCHIVED_UP_TO}'")
def purge_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return log_table.keep_unarchived(log, _archives(log)).select("seq_id", "hour_key")


@query(f"{E} SELECT DISTINCT hour_key FROM e WHERE CAST(hour_key[:10] AS DATE) < DATE '2024-01-20' - 14 "
       f"AND hour_key < '{ARCHIVED_UP_TO}'")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.expired(_archives(event_log(spark, sf_dir)), date(2024, 1, 20), 14)


# ------------------------------------------------------------------ ingest and streams

# A client that goes away finishes its request twice: every 50th row arrives
# again, later and marked. The first arrival must win.
def _twice(log: DataFrame) -> DataFrame:
    copies = F.when(F.col("seq_id") % 50 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        log.withColumn("copy", F.explode(copies))
        .withColumn("error", F.when(F.col("copy") == 1, F.lit("second finish")).otherwise(F.col("error")))
        .withColumn("arrival_no", F.col("seq_id") * 2 + F.col("copy") * 1001)
        .drop("copy")
    )


# Rows of the archived days are known already.
@query(f"{E} SELECT seq_id, error, hour_key FROM e WHERE hour_key >= '{ARCHIVED_UP_TO}'")
def ingest_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    known = log.where(F.col("hour_key") < ARCHIVED_UP_TO)
    arrivals = merge.with_bucket(merge.first_arrivals(_twice(log)))
    touched = merge.with_bucket(known).join(arrivals.select("seq_bucket").distinct(), "seq_bucket", "left_semi")
    return merge.new_rows(arrivals, touched).select("seq_id", "error", "hour_key")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return from_events(stream)


@query(f"{E} SELECT seq_id, error, hour_key, body_len FROM e")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_dir(spark, "ingest")
    run_to_end(ingest.start_ingest(_twice(_event_stream(spark, sf_dir)), root, f"{root}/checkpoint", available_now=True))
    return ingest.read_ingested(spark, root).select("seq_id", "error", "hour_key", "body_len")


@query(f"""{E} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour_start, count(*) AS count,
        CAST(sum(body_len) AS BIGINT) AS body_total FROM e GROUP BY 1""")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_dir(spark, "hourly")
    run_to_end(hourly.start_hourly(_event_stream(spark, sf_dir), f"{root}/counts", f"{root}/checkpoint", available_now=True))
    return hourly.read_hourly(spark, f"{root}/counts").select(
        F.date_format("hour_start", "yyyy-MM-dd HH:mm").alias("hour_start"), "count", "body_total"
    )


# The reports from the groups that a stream keeps.
@query(f"""{E} SELECT 'total' AS report, '' AS key, count(*) AS count, count(*) FILTER (status = 200) AS success,
        count(*) FILTER (status <> 200) AS errors, count(*) FILTER (status IS NULL) AS pending, count(error) AS with_error,
        CAST(sum(body_len) AS BIGINT) AS body_total, CAST(sum(resp_size) AS BIGINT) AS resp_total FROM e
    UNION ALL SELECT 'model', model, count(*), NULL, NULL, NULL, NULL, NULL, NULL FROM e GROUP BY 2
    UNION ALL SELECT 'hour', hour_key, count(*), NULL, NULL, NULL, NULL, CAST(sum(body_len) AS BIGINT), CAST(sum(resp_size) AS BIGINT)
        FROM e GROUP BY 2""")
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_dir(spark, "summary")
    run_to_end(hourly.start_summary(_event_stream(spark, sf_dir), f"{root}/groups", f"{root}/checkpoint", available_now=True))
    groups = hourly.read_summary(spark, f"{root}/groups")
    total = reports.summary_of(groups).select(
        F.lit("total").alias("report"), F.lit("").alias("key"), F.col("total").alias("count"), "success", "errors", "pending",
        "with_error", "body_total", "resp_total",
    )
    models = reports.by_model_of(groups).select(F.lit("model").alias("report"), F.col("model").alias("key"), "count")
    hours = reports.window_sizes_of(groups).where("NOT is_total").select(
        F.lit("hour").alias("report"), F.col("hour_key").alias("key"), F.col("entries").alias("count"), "body_total", "resp_total"
    )
    return total.unionByName(models, allowMissingColumns=True).unionByName(hours, allowMissingColumns=True)


@query(f"""{E} SELECT seq_id, hour_key, ts + to_microseconds(CAST(round(duration_ms * 1000) AS BIGINT))
        > date_trunc('hour', ts) + INTERVAL 1 HOUR AS late FROM e""")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_dir(spark, "late")
    run_to_end(
        late.start_routing(
            _event_stream(spark, sf_dir), f"{root}/rows", f"{root}/checkpoint", allowed=timedelta(0), available_now=True
        )
    )
    return read_batches(spark, f"{root}/rows", f"{LOG_SCHEMA}, late BOOLEAN").select("seq_id", "hour_key", "late")
