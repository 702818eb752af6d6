"""Consecutive numbers over a big table.

A row_number over a whole table (or a hot hour) sorts it in one task. Here the
integer key is cut into buckets of fixed width, the buckets into wider ones and
so on. Rows are numbered inside their bucket, and a bucket's offset is the
running sum of the counts before it, inside the next wider bucket. With
``WIDTH`` 65,536 and three levels above the rows no window holds more than
65,536 rows, whatever 64-bit keys there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 65_536
LEVELS = 3


def _wider(key: Column, width: int) -> Column:
    return F.floor(key / F.lit(width)).cast("bigint") if width & (width - 1) else F.shiftright(key, width.bit_length() - 1)


def _offsets(counts: DataFrame, within: list[str], level: int, width: int) -> DataFrame:
    """Add ``_offset`` to (within, _bucket, _rows): the rows of all buckets before."""
    if level == LEVELS:
        before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    counts = counts.withColumn("_wide", _wider(F.col("_bucket"), width))
    totals = counts.groupBy(*within, F.col("_wide")).agg(F.sum("_rows").alias("_rows")).withColumnRenamed("_wide", "_bucket")
    starts = _offsets(totals, within, level + 1, width).withColumnsRenamed({"_bucket": "_wide", "_offset": "_start"})
    before = Window.partitionBy(*within, "_wide").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("_inside", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    return inside.join(starts, [*within, "_wide"]).select(*within, "_bucket", (F.col("_start") + F.col("_inside")).alias("_offset"))


def number_rows(
    df: DataFrame, key: str, name: str, within: list[str] | None = None, start: int = 1, width: int = WIDTH
) -> DataFrame:
    """Add BIGINT ``name``: the rank of ``key`` (unique) within each group, from ``start``."""
    within = within or []
    keyed = df.withColumn("_bucket", _wider(F.col(key).cast("bigint"), width))
    counts = keyed.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    place = F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy(key))
    return (
        keyed.withColumn("_place", place)
        .join(_offsets(counts, within, 1, width), [*within, "_bucket"])
        .withColumn(name, (F.col("_offset") + F.col("_place") - 1 + F.lit(start)).cast("bigint"))
        .drop("_bucket", "_place", "_offset")
    )
