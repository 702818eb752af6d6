"""Archiving hours: choose, add to the archive, verify, then drop what was read."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hours as H
from ..schema import LOG_COLUMNS, LOG_SCHEMA
from ..sources.dataset import as_lines
from ..sources.log_table import by_hour, delete_files, drop_folder, hour_files, read_log, read_or_empty
from .cleaning import HARD_MINIMUM, clean_records, copies_of


def targets_before(windows: DataFrame, before: str) -> DataFrame:
    """Hours that sort before a key."""
    return windows.where(F.col("hour_key") < before).orderBy("hour_key")


def targets_pending(windows: DataFrame, archives: DataFrame, limit: int | None = None) -> DataFrame:
    """Hours without an archive, oldest first; ``limit=1`` takes the oldest only."""
    left = windows.join(archives.select("hour_key"), "hour_key", "left_anti").orderBy("hour_key")
    return left if limit is None else left.limit(limit)


def archive_targets(
    windows: DataFrame, archives: DataFrame, day: str | None = None, hour: str | None = None,
    before: str | None = None, everything: bool = False, limit: int | None = None,
) -> DataFrame:
    """The hours a run would process. The frame itself is the dry run.

    An explicit hour wins, then ``before``, then all pending or, on request, all hours.
    """
    if (day is None) != (hour is None):
        raise ValueError("give both day and hour, or neither")
    if day:
        return windows.where(F.col("hour_key") == f"{day}_{hour}")
    if before:
        chosen = targets_before(windows, before)
    elif everything:
        chosen = windows.orderBy("hour_key")
    else:
        chosen = targets_pending(windows, archives)
    return chosen if limit is None else chosen.limit(limit)


def expired(archives: DataFrame, as_of: date, days: int) -> DataFrame:
    """Archives older than ``days`` days; 0 keeps all."""
    if days <= 0:
        return archives.where(F.lit(False))
    day = F.to_date(H.date_of(F.col("hour_key")))
    return archives.where(day < F.date_sub(F.lit(as_of.isoformat()).cast("date"), days))


def _checksum() -> Column:
    # a sum, not an xor: equal lines must not cancel out
    return F.sum(F.xxhash64("seq_id", "value").cast("decimal(38,0)"))


def checksums(lines: DataFrame) -> DataFrame:
    return lines.groupBy("hour_key").agg(F.count(F.lit(1)).alias("records"), _checksum().alias("checksum"))


LINES = "seq_id BIGINT, value STRING, hour_key STRING"
KEYS = "seq_id BIGINT, dedup_key STRING, hour_key STRING"
REPORT = "hour_key STRING, records BIGINT, archived_records BIGINT, checksum DECIMAL(38,0), verified BOOLEAN, unreadable BIGINT"
REPORT_COLUMNS = [part.split()[0] for part in REPORT.split(", ")]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, LINES)


def verify(source: DataFrame, archived: DataFrame) -> DataFrame:
    """Per hour of the source: does the re-read archive have the same records?

    The archive may hold more records of the hour, from earlier runs; they are not looked at.
    """
    want = checksums(source)
    ids = source.select("hour_key", "seq_id").distinct()
    got = checksums(archived.join(ids, ["hour_key", "seq_id"], "left_semi")).select(
        "hour_key", F.col("records").alias("archived_records"), F.col("checksum").alias("archived_checksum")
    )
    same = (F.col("records") == F.col("archived_records")) & (F.col("checksum") == F.col("archived_checksum"))
    return want.join(got, "hour_key", "left").select(
        "hour_key", "records", F.coalesce("archived_records", F.lit(0)).alias("archived_records"), "checksum",
        F.coalesce(same, F.lit(False)).alias("verified"),
    )


def report_path(archive_path: str) -> str:
    return f"{archive_path}-runs"


def read_report(spark: SparkSession, archive_path: str) -> DataFrame:
    """What every run has stored, one row an hour and run: an ordinary table beside the archive."""
    return read_or_empty(spark, report_path(archive_path), REPORT)


def archived_hours(spark: SparkSession, archive_path: str) -> DataFrame:
    """Hours with a verified archive, from the reports alone."""
    return read_report(spark, archive_path).where("verified").select("hour_key").distinct()


def _of(rows: DataFrame, hours: list[str]) -> DataFrame:
    """Rows of a run's hours. The keys are in the plan, so that folders of other hours are not opened."""
    return rows.where(F.col("hour_key").isin(hours))


def _add(rows: DataFrame, path: str, schema: str, hours: list[str], **options: str) -> None:
    """Add rows to a table by hour, but for ids that an earlier run has stored there."""
    there = _of(read_or_empty(rows.sparkSession, path, schema), hours).select("hour_key", "seq_id")
    fresh = rows.join(there, ["hour_key", "seq_id"], "left_anti")
    by_hour(fresh).write.mode("append").partitionBy("hour_key").options(**options).parquet(path)


def archive_hours(
    spark: SparkSession, log: DataFrame, archive_path: str, staging_path: str, keep_source: bool = False,
    hours: DataFrame | None = None, rejects_path: str | None = None, scope: str = "hour",
    min_output_len: int = HARD_MINIMUM, **options,
) -> DataFrame:
    """Clean ``hours`` (all by default) of ``log``, add them to the archive, check, drop the source.

    ``log`` is a scan of a stored log, with filters at most. A run costs what its hours hold: every table
    is read at these hours only, whose keys (a few characters an hour) are collected for that.

    Nothing is replaced and nothing unseen is deleted:

    * the frame's files are listed before anything is read, and only these files are deleted; rows that
      land meanwhile are in other files;
    * bodies are decoded once, into the staging folder;
    * an hour that has an archive already gets further files beside the old ones; records stored by an
      earlier run, also by one that broke off, are not stored again;
    * a request whose copy an earlier run has stored is left out: ``<archive>-keys`` holds the dedup key and
      the id of every first copy by hour, of those too that were too short to be kept;
    * rows whose body cannot be read go to the reject table (``<archive>-rejects``) before their hour goes;
    * an hour that fails the check keeps its source. Its archive keeps what was there before.

    The report has one row an hour: records, archived_records, checksum, verified, unreadable. It is added to
    ``<archive>-runs``. Staged records are removed.
    """
    rejects_path, keys_path = rejects_path or f"{archive_path}-rejects", f"{archive_path}-keys"
    if hours is not None:
        log = _of(log, [row.hour_key for row in hours.select("hour_key").distinct().collect()])
    hour_files(log).write.parquet(f"{staging_path}/files")
    files = spark.read.schema("hour_key STRING, file STRING").parquet(f"{staging_path}/files")
    chosen = [row.hour_key for row in files.select("hour_key").distinct().collect()]
    cleaned = clean_records(log, with_unreadable=True, **options)
    narrow = ("hour_key", "seq_id", "dedup_key", "out_len", "unreadable")
    as_lines(cleaned, "dedup_key", "out_len", "unreadable").write.partitionBy("hour_key").option("compression", "zstd").parquet(f"{staging_path}/records")
    staged = spark.read.schema(f"{LINES}, dedup_key STRING, out_len INT, unreadable BOOLEAN").parquet(f"{staging_path}/records")
    good, bad = staged.where("NOT unreadable"), staged.where("unreadable").select("hour_key", "seq_id")
    stored_keys = read_or_empty(spark, keys_path, KEYS)
    known = _of(stored_keys, chosen) if scope == "hour" else stored_keys
    copies_of(good.select(*narrow), scope, known).write.parquet(f"{staging_path}/copies")
    copies = spark.read.schema("hour_key STRING, seq_id BIGINT").parquet(f"{staging_path}/copies")
    first = good.join(copies, ["hour_key", "seq_id"], "left_anti")
    kept = first.where(F.col("out_len") >= min_output_len).select("hour_key", "seq_id", "value")
    archived = lambda: _of(read_lines(spark, archive_path), chosen)  # noqa: E731  listed anew
    hour_files(archived()).write.parquet(f"{staging_path}/before")
    before = spark.read.schema("hour_key STRING, file STRING").parquet(f"{staging_path}/before")
    _add(kept, archive_path, LINES, chosen, compression="zstd", **{"parquet.compression.codec.zstd.level": "19"})
    if not bad.isEmpty():
        # the stored bytes, as they are; only then are the hours' payloads read again
        _add(log.join(bad, ["hour_key", "seq_id"], "left_semi").select(LOG_COLUMNS), rejects_path, LOG_SCHEMA, chosen, compression="zstd")
    _add(first.select("hour_key", "seq_id", "dedup_key"), keys_path, KEYS, chosen, compression="zstd")
    counted = bad.groupBy("hour_key").agg(F.count(F.lit(1)).alias("unreadable"))
    checked = verify(kept, archived())
    # hours of which everything is stored already
    nothing = F.lit(0).cast("bigint")
    repeated = copies.select("hour_key").distinct().join(before, "hour_key", "left_semi").join(checked, "hour_key", "left_anti").select(
        "hour_key", nothing.alias("records"), nothing.alias("archived_records"),
        F.lit(None).cast("decimal(38,0)").alias("checksum"), F.lit(True).alias("verified"),
    )
    report = checked.unionByName(repeated).join(counted, "hour_key", "left")
    report = report.select(*[F.col(c) for c in report.columns[:-1]], F.coalesce("unreadable", F.lit(0)).cast("bigint").alias("unreadable"))
    report.write.parquet(f"{staging_path}-report")
    report = spark.read.parquet(f"{staging_path}-report")
    report.select(*REPORT_COLUMNS).coalesce(1).write.mode("append").parquet(report_path(archive_path))
    failed = hour_files(archived()).join(report.where("NOT verified"), "hour_key", "left_semi")
    # file names are streamed to the driver, never held as a whole
    delete_files(spark, (row.file for row in failed.join(before, ["hour_key", "file"], "left_anti").toLocalIterator()))
    if not keep_source:
        done = files.join(report.where("verified"), "hour_key", "left_semi")
        delete_files(spark, (row.file for row in done.toLocalIterator()))
    drop_folder(spark, staging_path)
    return report
