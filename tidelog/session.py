"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings the operators rely on. All are SQL settings, so they can be
# set on a session somebody else created.
SETTINGS = {
    # hour keys are wall-clock hours of one fixed zone
    "spark.sql.session.timeZone": "UTC",
    # a JSON object with a repeated key keeps the last value
    "spark.sql.variant.allowDuplicateKeys": "true",
    # merging usage maps: the last value of a key wins
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # small data still spreads over tasks; big data keeps the advisory size
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # payloads of one request can be large and grow when decoded: small Arrow batches
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16MB",
    "spark.sql.parquet.compression.codec": "zstd",
    # a page far into a listing is sorted on the cluster, not in the driver
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_local_base: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_base:
        _local_base[app] = tempfile.mkdtemp(prefix="tidelog-")
    return _local_base[app]


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A folder nobody has written to yet."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/tidelog/{app}/{purpose}-{uuid.uuid4().hex}"
