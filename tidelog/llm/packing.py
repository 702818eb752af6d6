"""Packing of tokenised documents into sequences by the sum of squares of open bins per gap.

A document is its token ids and one end id. Longer than a sequence, it is cut into whole sequences,
the first piece taking the rest. A piece goes where the sum over all gaps g of (open bins with gap
g)^2 becomes smallest: into a bin of some gap, or into a new one. A decision needs the counts per
gap only, so a task keeps one number a gap and streams its pieces.

Pieces are dealt at random into groups of about ``GROUP``, packed side by side. Bins that end up
full are sequences; the pieces of all others are dealt again, in fewer groups, until one group is
left, or most pieces of a round lie in open bins: then these are sequences too. The last group takes
its pieces longest first and packs what stays open anew as long as that saves a sequence. So what is
lost does not grow with the number of groups.

NULL and empty texts are one piece, the end id alone. Repeated rows are packed each, an empty table
gives none. Of other columns those asked for are kept; ``piece``, ``start``, ``length``, ``ids``,
``sequence_id`` and ``offset`` are names of results. Ids are those that the ``tokenizers`` library gives
for the vocabulary file, which the tests hold them to.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytepair
from .common import land, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
CAPACITY = 2048
END = 0
GROUP = 32_768
# Pieces of at most one FILLER-th of a sequence are placed last, longest first: they close what the others leave open.
FILLER = 16


def cut(
    docs: DataFrame, keep: list[str], text: str = "text", capacity: int = CAPACITY, end: int = END,
    vocabulary: str = VOCABULARY, with_ids: bool = True,
) -> DataFrame:
    """One row a piece: the columns ``keep``, piece, start, length, ids_crc32 and, if wanted, ids.

    ``ids`` is BINARY: 32-bit little-endian token ids; ids_crc32 is their CRC-32. The vocabulary file
    (below 2 MB) is read once and sent to the tasks.
    """
    with open(vocabulary, "rb") as file:
        data = file.read()
    rows = docs.select(*keep, text_of(text).alias("_text"))
    added = [T.StructField("piece", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]]
    schema = T.StructType([*rows.schema.fields[:-1], *added, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    last = np.array([end], "<u4").tobytes()
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bytepair.encoder_of(data).encode
        for batch in batches:
            row, piece, start, length, check, pieces = [], [], [], [], [], []
            for n, text in enumerate(batch.column(batch.num_columns - 1)):
                ids = encode(text.as_py()) + last
                first = len(ids) % width or width
                bounds = [0, *range(first, len(ids) + 1, width)]
                for number, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    part = ids[a:b]
                    row.append(n)
                    piece.append(number)
                    start.append(a // 4)
                    length.append((b - a) // 4)
                    check.append(zlib.crc32(part))
                    if with_ids:
                        pieces.append(part)
            kept = [column.take(pa.array(row, pa.int32())) for column in batch.columns[:-1]]
            more = [pa.array(piece, pa.int32()), *[pa.array(v, pa.int64()) for v in (start, length, check)]]
            more += [pa.array(pieces, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays([*kept, *more], names=schema.names)

    return rows.mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the order given, and what is left free in each bin.

    Of equal sums an open bin goes before a new one, then the smallest gap, then the bin that got it last.
    """
    counts = np.zeros(capacity + 1, np.int64)
    bins: dict[int, list[int]] = {}
    free: list[int] = []
    chosen, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for n, size in enumerate(lengths.tolist()):
        # gaps size .. capacity - 1; a gap of g becomes one of g - size, a gap of size is closed
        there = counts[size:capacity]
        change = 2 * (counts[: capacity - size] - there) + 2
        new = 1
        if size < capacity:
            change[0] = 1 - 2 * there[0]
            new = 2 * int(counts[capacity - size]) + 1
            change[there == 0] = new + 1
        best = int(change.argmin()) if size < capacity else -1
        if best >= 0 and change[best] <= new:
            gap = size + best
            number = bins[gap].pop()
            counts[gap] -= 1
        else:
            gap, number = capacity, len(free)
            free.append(capacity)
        chosen[n], offsets[n] = number, capacity - gap
        free[number] = left = gap - size
        if left:
            counts[left] += 1
            bins.setdefault(left, []).append(number)
    return chosen, offsets, np.array(free, np.int64)


def _repacked(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``sum_of_squares``; the open bins are packed anew, longest first, while that saves one."""
    chosen, offsets, free = sum_of_squares(lengths, capacity)
    while True:
        loose = np.flatnonzero(free[chosen] > 0)
        loose = loose[np.argsort(-lengths[loose], kind="stable")]
        again, places, left = sum_of_squares(lengths[loose], capacity)
        if len(left) >= np.count_nonzero(free):
            return chosen, offsets, free
        keep = np.flatnonzero(free == 0)
        number = np.full(len(free), -1)
        number[keep] = np.arange(len(keep))
        chosen = number[chosen]
        chosen[loose], offsets[loose] = again + len(keep), places
        free = np.concatenate([free[keep], left])


def _packer(level: int, final: bool, capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        # hashes of unique ids: a random order that is the same in every attempt
        fillers = rows["length"] <= (capacity if final else capacity // FILLER)
        rows = rows.assign(_turn=-rows["length"].where(fillers, capacity)).sort_values(["_turn", "_order"], ignore_index=True)
        chosen, offsets, free = (_repacked if final else sum_of_squares)(rows["length"].to_numpy(), capacity)
        numbers = (level << 44 | int(rows["_group"].iloc[0]) << 20) + chosen
        opened = (free[chosen] > 0) & (not final)
        return pd.DataFrame({"_row": rows["_row"], "length": rows["length"], "sequence_id": numbers, "offset": offsets, "_open": opened})

    return pack


def place(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    A task holds three numbers for each piece of one group.
    """
    rows = land(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    whole = rows.where(F.col("length") == capacity).select(
        "_row", (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    left = rows.where(F.col("length") < capacity).select("_row", "length")
    schema = "_row BIGINT, length BIGINT, sequence_id BIGINT, offset BIGINT, _open BOOLEAN"
    settled, level, size = [whole], 0, left.count()
    while size:
        groups = -(-size // group)
        final = groups == 1

        order = F.xxhash64(F.lit(level), "_row")
        dealt = left.select("_row", "length", order.alias("_order"), F.pmod(F.xxhash64(F.lit(level), F.lit(0), "_row"), F.lit(groups)).alias("_group"))
        packed = land(dealt.groupBy("_group").applyInPandas(_packer(level, final, capacity), schema), "packed")
        opened = packed.where("_open").count()
        # where most bins stay open, as with pieces above half a sequence, dealing them again would not help
        done = opened > size // 2
        settled.append((packed if done else packed.where("NOT _open")).select("_row", "sequence_id", "offset"))
        left, level, size = packed.where("_open").select("_row", "length"), level + 1, 0 if done else opened
    places = settled[0]
    for more in settled[1:]:
        places = places.union(more)
    return rows.join(places, "_row").drop("_row")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences; ``placed`` has the ids of its pieces."""
    whole = F.expr("listagg(ids, x'') WITHIN GROUP (ORDER BY offset)")
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))
