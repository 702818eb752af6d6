"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import work_dir

# Functions that run in tasks travel by value: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICES = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def land(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """The whole text; NULL counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def unit(*parts: Column) -> Column:
    """A number in [0, 1) that looks random and depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def running_before(df: DataFrame, within: list[str], place: str, value: str, name: str, slices: int = SLICES) -> DataFrame:
    """Add ``name``: the sum of ``value`` over rows of the group whose ``place`` in [0, 1) is smaller.

    Two levels: sums of ``slices`` slices of the places, then the rows of one slice.
    No window holds a whole group. Places must be distinct within a group for one answer.
    """
    cut = df.withColumn("_slice", F.floor(F.col(place) * slices).cast("int"))
    totals = cut.groupBy(*within, "_slice").agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*within).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_slices_before", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*within, "_slice").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(totals, [*within, "_slice"])
        .withColumn(name, F.col("_slices_before") + F.col("_inside"))
        .drop("_slice", "_inside", "_slices_before")
    )


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join with one row a key on the right, where a BIGINT key may hold a large part of the left.

    Spark's skew join splits a hot key only between two plain exchanges. A right side that was
    just grouped by the key has none, so its key is computed anew, which Spark takes for another
    column and exchanges by.
    """
    return left.join(right.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("bigint"))), key, how)
