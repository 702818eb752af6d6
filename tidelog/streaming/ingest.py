"""Continuous ingest into the hour-partitioned log.

Each micro-batch keeps the first arrival of every seq_id and drops ids that an
earlier batch stored. Ids are remembered with their hour in a narrow side table
laid out by id range, so a batch opens the ranges it touches, not the log. Ids
are handed out in ascending order: a range gets rows for a while and is then
complete, so its folder never holds more than a few hundred small files.

``dropDuplicatesWithinWatermark`` would keep any of two arrivals in one batch and
forget ids after its delay; here the first one stays, and a replay is noticed at
any age.

Rows that finish after their hour was closed go to a quarantine beside the log,
from where ``jobs.archive_late`` adds them to the archive of their hour.

A batch writes a folder of its own and replaces it when it is run again. Folders
of closed hours are rewritten by ``jobs.compact`` or go with the archive run.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import BUCKET, first_arrivals, new_rows, with_bucket
from ..schema import LOG_SCHEMA
from ..sources.log_table import by_hour, encode_entries, read_or_empty
from .batches import read_batches, write_batch
from .late import ALLOWED, is_late

TRIGGER = "2 seconds"
KEYS = "seq_id BIGINT, hour_key STRING"


def known_ids(spark: SparkSession, path: str, buckets: list[int], before: int | None = None) -> DataFrame:
    """Keys of these id ranges, from their folders alone; ``before`` leaves out batches from this one on."""
    wanted = ",".join(str(b) for b in sorted(buckets))
    rows = read_or_empty(spark, f"{path}/seq_bucket={{{wanted}}}", f"{KEYS}, seq_bucket BIGINT, batch BIGINT", base=path)
    return rows if before is None else rows.where(F.col("batch") < before)


class LogSink:
    """foreachBatch sink: ``<root>/entries``, ``<root>/late`` and ``<root>/keys``."""

    def __init__(self, root: str, allowed: timedelta = ALLOWED, zone: str = "UTC"):
        self.entries, self.late, self.keys = f"{root}/entries", f"{root}/late", f"{root}/keys"
        self.allowed, self.zone = allowed, zone

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if dict(batch.dtypes)["body"] == "string":
            batch = encode_entries(batch)
        # read several times below; a lost block is computed again from the source
        arrivals = with_bucket(first_arrivals(batch)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self._store(arrivals, batch_id)
        finally:
            arrivals.unpersist()

    def _store(self, arrivals: DataFrame, batch_id: int) -> None:
        # at most one bucket a row of the batch; they prune the folders of the key table
        buckets = [row.seq_bucket for row in arrivals.select("seq_bucket").distinct().collect()]
        if not buckets:
            return
        # keys are written last: a batch run again must not take its own for known
        fresh = new_rows(arrivals, known_ids(arrivals.sparkSession, self.keys, buckets, before=batch_id))
        late = is_late(self.allowed, self.zone)
        rows = fresh.drop("seq_bucket", "arrival_no")
        write_batch(by_hour(rows.where(~late)), self.entries, batch_id, "hour_key")
        write_batch(by_hour(rows.where(late)), self.late, batch_id, "hour_key")
        keys = fresh.select("seq_id", "hour_key", "seq_bucket", F.lit(batch_id).cast("bigint").alias("batch")).hint("rebalance", "seq_bucket")
        keys.write.mode("overwrite").partitionBy("seq_bucket", "batch").option("partitionOverwriteMode", "dynamic").parquet(self.keys)


def start_ingest(
    arrivals: DataFrame, root: str, checkpoint: str, available_now: bool = False, allowed: timedelta = ALLOWED,
    zone: str = "UTC",
) -> StreamingQuery:
    """``arrivals``: streaming log rows plus ``arrival_no``, their order of arrival. Text bodies are encoded."""
    writer = arrivals.writeStream.foreachBatch(LogSink(root, allowed, zone)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TRIGGER)
    return writer.start()


def read_ingested(spark: SparkSession, root: str, table: str = "entries") -> DataFrame:
    return read_batches(spark, f"{root}/{table}", LOG_SCHEMA)


def lookup(spark: SparkSession, root: str, seq_id: int) -> DataFrame:
    """Point lookup: the key table names the hour, so one folder of the log is read."""
    keys = known_ids(spark, f"{root}/keys", [seq_id // BUCKET])
    found = keys.where(F.col("seq_id") == seq_id).select("hour_key").first()
    rows = read_ingested(spark, root).unionByName(read_ingested(spark, root, "late"))
    return rows.where((F.col("hour_key") == (found.hour_key if found else "")) & (F.col("seq_id") == seq_id))
