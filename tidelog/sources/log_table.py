"""The log on storage: Parquet, one folder per hour, sorted by seq_id inside."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions import hours as H
from ..schema import LOG_COLUMNS, LOG_SCHEMA, LOG_TYPES
from ..session import work_dir


def by_hour(df: DataFrame) -> DataFrame:
    """Layout for writing: AQE splits a hot hour over tasks and merges small ones."""
    return df.hint("rebalance", "hour_key").sortWithinPartitions("hour_key", "seq_id")


# Payloads grow several times when decoded, so scans should be able to cut files finely.
ROW_GROUP_BYTES = 16 << 20
# ids a row group's Bloom filter is sized for
BLOOM_IDS = 20_000


def write_log(df: DataFrame, path: str, mode: str = "append") -> None:
    writer = by_hour(df).write.mode(mode).partitionBy("hour_key").option("compression", "zstd")
    # ids of an hour arrive in many files: the filter tells which hold one, statistics do not
    writer = writer.option("parquet.bloom.filter.enabled#seq_id", "true").option("parquet.bloom.filter.expected.ndv#seq_id", BLOOM_IDS)
    writer.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)


def replace_hours(df: DataFrame, **options: str) -> DataFrameWriter:
    """Writer that replaces the hours found in ``df`` and leaves the others alone."""
    return (
        by_hour(df).write.mode("overwrite").partitionBy("hour_key").option("partitionOverwriteMode", "dynamic")
        .options(**options)
    )


def read_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """A given schema saves reading footers and keeps folder names strings."""
    return spark.read.schema(schema).parquet(path)


def land_entries(rows: DataFrame, zone: str = "UTC") -> DataFrame:
    """Captured rows as log rows: ``ts`` (UTC) and ``hour_key`` (the wall clock of the
    capture's zone) from the epoch, text bodies encoded. Columns a capture lacks are NULL."""
    started = H.moment(F.col("ts_epoch"))
    rows = rows.withColumns({"ts": started.cast("timestamp_ntz"), "hour_key": H.local_hour_key(started, zone)})
    whole = rows.select([F.col(c) if c in rows.columns else F.lit(None).cast(LOG_TYPES[c]).alias(c) for c in LOG_COLUMNS])
    return encode_entries(whole) if dict(rows.dtypes).get("body") == "string" else whole


def read_or_empty(spark: SparkSession, path: str, schema: str, base: str | None = None) -> DataFrame:
    """A Parquet table that may not exist yet. ``base``: the table that a ``path`` to some of its folders is of."""
    reader = spark.read.schema(schema)
    try:
        return (reader.option("basePath", base) if base else reader).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def encode_entries(rows: DataFrame) -> DataFrame:
    """Rows with a text ``body`` in stored form: gzip body, NULL for an empty one or no error."""
    return rows.withColumn("body", codec.encode_gzip(F.col("body"))).withColumn(
        "error", F.nullif(F.col("error"), F.lit(""))
    )


def keep_unarchived(log: DataFrame, archived: DataFrame) -> DataFrame:
    """What is left of the log after the archived hours are dropped, rejected rows included."""
    return log.join(archived.select("hour_key"), "hour_key", "left_anti")


def hour_files(rows: DataFrame) -> DataFrame:
    """(hour_key, file): the files a frame over a stored table reads. Only their hour column is read.

    A frame lists its files once, when it is made: files that arrive later are not in it.
    """
    return rows.select("hour_key", F.input_file_name().alias("file")).distinct()


def delete_files(spark: SparkSession, files: Iterable[str]) -> None:
    """Delete exactly these files (as ``input_file_name`` gives them), and hour folders left empty."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in files:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        storage = path.getFileSystem(conf)
        storage.delete(path, False)
        # not recursive: a folder that has got new rows meanwhile stays
        folder = path.getParent()
        while "=" in folder.getName() and not [f for f in storage.listStatus(folder) if not f.getPath().getName().startswith("_")]:
            if folder.getName().startswith("hour_key="):
                storage.delete(folder, False)
            else:  # the folder of a batch, but for its marker of success
                storage.delete(folder, True)
            folder = folder.getParent()


def landed(df: DataFrame, purpose: str) -> DataFrame:
    """Written to the working folder and read back, so that it is computed once."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_hours(spark: SparkSession, path: str, hour_keys: Iterable[str]) -> None:
    """Remove whole hours of a table on storage."""
    for key in hour_keys:
        drop_folder(spark, f"{path}/hour_key={key}")
