"""Replies put together while their chunks arrive, in any order and over any number of batches.

State is kept per request: chunks that wait for an earlier one, and the bytes of the part that is not
emitted yet. A reply is complete when its last chunk and all before it are there. One whose chunks stop
coming is given up ``WAIT`` after its first one: what lies before the first gap is emitted, marked.
A reply passes through one Python process, as does every other reply of its key's partition.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .batches import read_batches, write_batch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# the longest wait for an upstream
WAIT = timedelta(minutes=20)
CHUNKS = "seq_id BIGINT, chunk_no BIGINT, bytes BINARY, last BOOLEAN"
PARTS = "seq_id BIGINT, part_no BIGINT, bytes BINARY, ended BOOLEAN, complete BOOLEAN"
COLUMNS = ["seq_id", "part_no", "bytes", "ended", "complete"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Assembler(StatefulProcessor):
    """Emits whole replies (``lines`` False) or their lines, each with its line break, as soon as they are whole."""

    def __init__(self, lines: bool, wait_ms: int):
        self.lines, self.wait_ms = lines, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "chunk_no BIGINT", "bytes BINARY")
        # chunks before this one are used; of the others so many wait; number of the last one (-1: not known);
        # parts emitted; bytes of the open line
        self.progress = handle.getValueState("progress", "used BIGINT, held BIGINT, last_no BIGINT, parts BIGINT, rest BINARY")

    def _take(self, number: int) -> bytes | None:
        if not self.waiting.containsKey((number,)):
            return None
        return bytes(self.waiting.getValue((number,))[0])

    def _in_order(self, used: int) -> tuple[list[bytes], int]:
        """Chunks that follow without a gap."""
        found = []
        while (data := self._take(used)) is not None:
            found.append(data)
            used += 1
        return found, used

    def _clear(self) -> None:
        self.waiting.clear()
        self.progress.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.progress.exists():
            used, held, last_no, parts, rest = self.progress.get()
        else:
            used, held, last_no, parts, rest = 0, 0, -1, 0, b""
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        for batch in rows:
            for number, data, last in zip(batch["chunk_no"], batch["bytes"], batch["last"], strict=True):
                number = int(number)
                # a chunk sent twice counts once
                if number >= used and not self.waiting.containsKey((number,)):
                    self.waiting.updateValue((number,), (bytes(data or b""),))
                    held += 1
                last_no = number if last else last_no
        out, ended = [], 0 <= last_no == used + held - 1
        if self.lines:
            pieces, after = self._in_order(used)
            for number in range(used, after):
                self.waiting.removeKey((number,))
            used, held = after, held - len(pieces)
            *whole, rest = b"".join([bytes(rest), *pieces]).split(b"\n")
            whole = [line + b"\n" for line in whole] + ([rest] if ended and rest else [])
            out = [(key[0], parts + n, line, ended and n == len(whole) - 1, True) for n, line in enumerate(whole)]
        elif ended:
            out = [(key[0], 0, b"".join(self._in_order(0)[0]), True, True)]
        if ended:
            self._clear()
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
        else:
            self.progress.update((used, held, last_no, parts + len(out), bytes(rest)))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.progress.exists():
            used, _, _, parts, rest = self.progress.get()
            data = b"".join([bytes(rest), *self._in_order(used)[0]])
            self._clear()
            yield pd.DataFrame([(key[0], parts, data, True, False)], columns=COLUMNS)

    def close(self) -> None:
        pass


def assembled(chunks: DataFrame, lines: bool = False, wait: timedelta = WAIT) -> DataFrame:
    """Streaming ``CHUNKS`` -> streaming ``PARTS``. ``last`` marks the chunk that ends a reply."""
    spark = chunks.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return chunks.groupBy("seq_id").transformWithStateInPandas(
        Assembler(lines, int(wait.total_seconds() * 1000)), outputStructType=PARTS, outputMode="Append", timeMode="ProcessingTime"
    )


def start_assembly(chunks: DataFrame, root: str, checkpoint: str, lines: bool = False, available_now: bool = False, wait: timedelta = WAIT) -> StreamingQuery:
    """Write the parts below ``root``; a batch that is run again replaces its folder."""
    writer = assembled(chunks, lines, wait).writeStream.outputMode("append").foreachBatch(lambda rows, batch: write_batch(rows, root, batch))
    writer = writer.option("checkpointLocation", checkpoint)
    if not available_now:
        return writer.trigger(processingTime="2 seconds").start()
    # timers ask for one more batch without data for ever; a run to the end must not wait for them
    conf, name = chunks.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def read_assembled(spark: SparkSession, root: str) -> DataFrame:
    return read_batches(spark, root, PARTS).where(F.col("seq_id").isNotNull())
