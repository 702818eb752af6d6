"""Token counts: the exact histogram of encoded lengths and what its suffix sums answer.

Texts are encoded with a public byte-pair vocabulary (a rank file). One row per distinct
length leaves the shuffle; every answer for every context limit comes from suffix sums
over those rows. NULL and empty texts have length 0; repeated rows count each time; an
empty table gives an empty histogram. Other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytepair
from .common import land, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPAN = 1024


def encoded_length(text: Column, vocabulary: str = VOCABULARY, pattern: str = bytepair.PATTERN) -> Column:
    """Number of tokens of a text. The vocabulary file (below 2 MB) is read once and sent to the tasks."""
    with open(vocabulary, "rb") as file:
        data = file.read()

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = bytepair.encoder_of(data, pattern)
        for texts in batches:
            yield pd.Series([encoder.count(t) for t in texts], dtype="int64")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, "bigint")(F.coalesce(text, F.lit("")))


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(encoded_len, n_docs): one row per distinct length, landed, so that the texts are encoded once."""
    lengths = docs.select(encoded_length(text_of(text), vocabulary).alias("encoded_len"))
    return land(lengths.groupBy("encoded_len").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")


def suffix_sums(histogram: DataFrame, span: int = SPAN) -> DataFrame:
    """For every distinct length taken as a context limit, what fits and what is cut.

    docs_at_least, tokens_at_least: documents of at least this length and their tokens.
    docs_total, tokens_total: of the whole table.
    truncated_total: tokens left if every document is cut at this limit.
    share_within: share of documents that fit, so the first row with share_within >= q
    is the q-quantile of the lengths.
    """
    spans = histogram.withColumn("_span", F.floor(F.col("encoded_len") / span)).withColumn(
        "_tokens", F.col("encoded_len") * F.col("n_docs")
    )
    # Two levels: running sums over spans of lengths, then within a span of at most `span` rows.
    totals = spans.groupBy("_span").agg(F.sum("n_docs").alias("_docs"), F.sum("_tokens").alias("_sum"))
    after = Window.orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    totals = totals.select(
        "_span",
        F.coalesce(F.sum("_docs").over(after), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_sum").over(after), F.lit(0)).alias("_tokens_after"),
        F.sum("_docs").over(whole).alias("docs_total"),
        F.sum("_sum").over(whole).alias("tokens_total"),
    )
    inside = Window.partitionBy("_span").orderBy(F.desc("encoded_len"))
    rows = spans.join(totals, "_span").select(
        "encoded_len",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("_docs_after")).alias("docs_at_least"),
        (F.sum("_tokens").over(inside) + F.col("_tokens_after")).alias("tokens_at_least"),
        "docs_total",
        "tokens_total",
    )
    below = F.col("tokens_total") - F.col("tokens_at_least")
    longer = F.col("docs_at_least") - F.col("n_docs")
    return rows.withColumn(
        "truncated_total", below + F.col("encoded_len") * F.col("docs_at_least")
    ).withColumn("share_within", F.lit(1.0) - longer / F.col("docs_total"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_cut, truncated_total) for a short list of limits, from ``suffix_sums``."""
    over = F.col("encoded_len") > F.col("context_limit")
    return (
        sums.withColumn("context_limit", F.explode(F.array(*[F.lit(int(limit)) for limit in limits])))
        .groupBy("context_limit")
        .agg(
            F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("docs_cut"),
            F.sum(F.least(F.col("encoded_len"), F.col("context_limit")) * F.col("n_docs")).alias("truncated_total"),
        )
    )


def quantile(sums: DataFrame, share: float) -> int | None:
    """Smallest length that at least ``share`` of the documents do not exceed."""
    return sums.where(F.col("share_within") >= share).agg(F.min("encoded_len")).first()[0]
