"""Whole jobs over a stored log, for a scheduler to call."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hours as H
from ..operators import archive, cleaning, decoding, rules, scans, turns
from ..schema import LOG_SCHEMA
from ..session import configure, work_dir
from ..sources import dataset, log_table
from ..streaming import ingest, late
from ..streaming.batches import read_batches, write_batch

HOURS = "hour_key STRING"


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """A stored log: plain, or in the folders of batches that ``start_ingest`` writes."""
    return read_batches(spark, path, LOG_SCHEMA)


def compact(spark: SparkSession, root: str, now: datetime, allowed: timedelta = late.ALLOWED, zone: str = "UTC") -> int:
    """Rewrite the closed hours of an ingested log, each in few files, and drop the files they were read from.

    An ordinary job between the stream and the archive run of a scheduler: it takes closed hours only, which
    the stream no longer writes to, and nobody else should read these while it runs. Returns the files dropped.
    """
    configure(spark)
    path = f"{root}/entries"
    log = read_batches(spark, path, LOG_SCHEMA)
    staging = work_dir(spark, "compact")
    closed = late.closed_hours(scans.list_windows(log), H.ntz(now), allowed, zone)
    log_table.hour_files(log).join(closed, "hour_key", "left_semi").write.parquet(staging)
    files = spark.read.schema("hour_key STRING, file STRING").parquet(staging)
    several = files.groupBy("hour_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hours = [row.hour_key for row in several.toLocalIterator()]
    if not hours:
        return 0
    lowest = log_table.read_or_empty(spark, path, f"{LOG_SCHEMA}, batch BIGINT").agg(F.min("batch")).first()[0]
    write_batch(log_table.by_hour(log.where(F.col("hour_key").isin(hours))), path, min(lowest, 0) - 1, "hour_key")
    dropped = [row.file for row in files.where(F.col("hour_key").isin(hours)).toLocalIterator()]
    log_table.delete_files(spark, dropped)
    log_table.drop_folder(spark, staging)
    return len(dropped)


def clean(
    spark: SparkSession, log_path: str, dataset_path: str, hour_key: str | None = None, day: str | None = None,
    min_output_len: int = cleaning.HARD_MINIMUM, **options,
) -> DataFrame:
    """Write the dataset of one hour, of the first hour of a day, or of all hours.

    The log is decoded once, into a staging table; the copies to leave out are found on its narrow
    columns. Every hour that was read is replaced, also one that has no records any more. Returns the
    stored statistics per hour; a day without rows gives none.
    """
    configure(spark)
    log = _stored(spark, log_path)
    if day is not None:
        hour_key = scans.first_hour_of_day(log, day).first().hour_key
        log = log if hour_key else log.where("false")
    if hour_key is not None:
        log = log.where(scans.in_hour(hour_key))
    staging = work_dir(spark, "clean")
    scope = options.pop("scope", "hour")
    records = cleaning.clean_records(log, **options)
    records.write.parquet(f"{staging}/records")
    records = spark.read.schema(records.schema).parquet(f"{staging}/records")
    dataset.write_dataset(cleaning.without_copies(records, scope, min_output_len), dataset_path)
    stats = cleaning.stats_of(records, min_output_len)
    stats.write.parquet(f"{staging}-stats")
    stats = spark.read.schema(stats.schema).parquet(f"{staging}-stats").orderBy("hour_key")
    empty = scans.list_windows(log).join(stats.where("records_kept > 0"), "hour_key", "left_anti")
    log_table.drop_hours(spark, dataset_path, (row.hour_key for row in empty.toLocalIterator()))
    log_table.drop_folder(spark, staging)
    return stats


def _write_lines(lines: DataFrame, path: str) -> None:
    log_table.by_hour(lines).select("value", "hour_key").write.mode("overwrite").partitionBy("hour_key").option(
        "partitionOverwriteMode", "dynamic"
    ).option("compression", "gzip").text(path)


def convert(spark: SparkSession, log_path: str, path: str, hour_key: str | None = None, prompts: bool = False, **options) -> None:
    """Write the converted requests, with their sizes before and after, or the prompts: one JSON line each, by hour."""
    configure(spark)
    log = _stored(spark, log_path).where(rules.kept_row())
    log = log if hour_key is None else log.where(scans.in_hour(hour_key))
    lines = turns.prompt_lines if prompts else turns.converted_lines
    _write_lines(lines(decoding.decode(log), **options), path)


def archive_pending(
    spark: SparkSession, log_path: str, archive_path: str, now: datetime, allowed: timedelta = late.ALLOWED,
    day: str | None = None, hour: str | None = None, before: str | None = None, everything: bool = False,
    limit: int | None = None, dry_run: bool = False, keep_source: bool = False, retain_days: int = 0, zone: str = "UTC",
    **options,
) -> DataFrame:
    """One run of the periodic archive job.

    Takes the hours asked for that are closed at ``now``. A dry run returns
    them; a run returns the report per archived hour. What is archived already is known from the reports of
    earlier runs. Archives older than ``retain_days`` days are removed afterwards, 0 keeps all.
    """
    configure(spark)
    log = _stored(spark, log_path)
    archives = archive.archived_hours(spark, archive_path)
    windows = late.closed_hours(scans.list_windows(log), H.ntz(now), allowed, zone)
    targets = archive.archive_targets(windows, archives, day, hour, before, everything, limit)
    if dry_run:
        return targets
    # the targets are few narrow rows, one an hour, landed so that their number is known
    chosen = work_dir(spark, "targets")
    targets.write.parquet(chosen)
    hours = spark.read.schema(HOURS).parquet(chosen)
    report = archive.archive_hours(spark, log, archive_path, work_dir(spark, "cleaned"), keep_source, hours, **options)
    log_table.drop_folder(spark, chosen)
    if retain_days > 0:
        retain(spark, archive_path, now.date(), retain_days)
    return report


def archive_late(
    spark: SparkSession, root: str, archive_path: str, now: datetime, keep_source: bool = False, **options
) -> DataFrame:
    """Add the rows of the quarantine that ``start_ingest`` keeps under ``root`` to the archives of their hours."""
    configure(spark)
    late_rows = ingest.read_ingested(spark, root, "late").where(F.col("ts") <= H.ntz(now))
    return archive.archive_hours(spark, late_rows, archive_path, work_dir(spark, "late"), keep_source, **options)


def retain(spark: SparkSession, archive_path: str, as_of: date, days: int) -> None:
    """Remove archives older than ``days`` days."""
    archives = log_table.read_or_empty(spark, archive_path, HOURS).select("hour_key").distinct()
    old = archive.expired(archives, as_of, days)
    log_table.drop_hours(spark, archive_path, (row.hour_key for row in old.toLocalIterator()))
