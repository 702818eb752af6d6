"""Keyword search by an index of trigrams.

The index is a table by hour: for each three characters (lower case, of the body or the reply) the ids of
the rows that hold them. A needle's rows hold all its trigrams, so the lists' intersection names
candidates, and only those are read and searched. The result is that of ``search``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.log_table import landed, read_or_empty
from . import search as plain
from .rules import searchable
from .scans import in_hours

GRAM = 3
# a list holds the ids of one range, however many rows of an hour hold a trigram
RANGE = 1 << 14
INDEX_SCHEMA = "part STRING, gram STRING, ids ARRAY<BIGINT>, hour_key STRING"
PARTS = {"all": ("body", "reply"), "body": ("body",), "response": ("reply",)}


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case; none for fewer than three characters."""
    chars = F.array(F.split(F.lower(F.coalesce(text, F.lit(""))), ""))
    at = lambda c: F.transform(c, lambda x, i: F.concat(x, *[F.coalesce(F.get(c, i + n), F.lit("")) for n in range(1, GRAM)]))
    return F.array_distinct(F.filter(F.flatten(F.transform(chars, at)), lambda g: F.length(g) == GRAM))


def postings(decoded: DataFrame) -> DataFrame:
    """(part, gram, ids, hour_key) of a decoded log's searchable rows."""
    parts = F.array(
        F.struct(F.lit("body").alias("part"), grams(F.col("body_text")).alias("grams")),
        F.struct(F.lit("reply").alias("part"), grams(plain.reply_of()).alias("grams")),
    )
    rows = decoded.where(searchable()).select("hour_key", "seq_id", F.explode(parts).alias("p"))
    rows = rows.select("hour_key", "seq_id", "p.part", F.explode("p.grams").alias("gram"))
    lists = rows.groupBy("hour_key", "part", "gram", F.floor(F.col("seq_id") / RANGE).alias("range"))
    return lists.agg(F.sort_array(F.collect_set("seq_id")).alias("ids")).select("part", "gram", "ids", "hour_key")


def write_index(decoded: DataFrame, path: str) -> None:
    """Replaces the hours found in ``decoded``; an hour that is closed is indexed once."""
    ordered = postings(decoded).hint("rebalance", "hour_key").sortWithinPartitions("hour_key", "gram")
    ordered.write.mode("overwrite").partitionBy("hour_key").option("partitionOverwriteMode", "dynamic").option(
        "parquet.bloom.filter.enabled#gram", "true"
    ).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, INDEX_SCHEMA)


def candidates(index: DataFrame, needle: list[str], scope: str = "all") -> DataFrame:
    """(hour_key, seq_id) of the rows that hold all trigrams ``needle`` in one part."""
    lists = index.where(F.col("gram").isin(needle) & F.col("part").isin(list(PARTS[scope])))
    held = lists.select("hour_key", "part", F.explode("ids").alias("seq_id")).groupBy("hour_key", "part", "seq_id").count()
    return held.where(F.col("count") == len(needle)).select("hour_key", "seq_id").distinct()


def search_indexed(decoded: DataFrame, index: DataFrame, query: str, scope: str = "all") -> DataFrame:
    """``search`` over the candidates alone. Time filters go on both tables beforehand.

    The hours and the span of ids of the candidates stand in the plan, so other hours and row groups are not
    read. A needle of fewer than three characters has no trigram: every row is searched. Rows
    that are not indexed yet are not found.
    """
    if scope not in PARTS:
        raise ValueError(f"unknown scope {scope!r}")
    spark = decoded.sparkSession
    needle = spark.range(1).select(grams(F.lit(query.strip())).alias("g")).first().g
    if not needle:
        return plain.search(decoded, query, scope)
    found = landed(candidates(index, needle, scope), "candidates")
    hours = found.groupBy("hour_key").agg(F.min("seq_id").alias("low"), F.max("seq_id").alias("high")).collect()
    if not hours:
        return plain.search(decoded.where(F.lit(False)), query, scope)
    span = F.col("seq_id").between(min(h.low for h in hours), max(h.high for h in hours))
    named = found.toDF("_hour", "_seq")
    same = F.col("hour_key").eqNullSafe(F.col("_hour")) & (F.col("seq_id") == F.col("_seq"))
    rows = decoded.where(in_hours(h.hour_key for h in hours) & span).join(named, same, "left_semi")
    return plain.search(rows, query, scope)
