"""URL filter by the ratio of two character language models.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, judge a
URL by the difference of its log-likelihoods per character. A model interpolates the orders 0
to 3 (Witten-Bell): a context that was seen often and with few followers counts for much, a
context never seen counts for nothing, so the order in force varies from place to place.
The threshold is calibrated on labelled URLs that no count has seen.

Characters fall into 41 classes, so a model is a table of at most 41^4 numbers (11 MB as
floats): the sum over the whole corpus reaches the driver with at most 2 * 41^4 rows, however
large the corpus, and the table of differences is broadcast under the same bound.

Defined cases: a NULL or empty URL has no character to judge, score NULL, and is blocked.
Without labelled URLs of both kinds every score is 0 and every non-empty URL is allowed.
Repeated rows count each time; extra columns pass through; columns named like a result are
replaced.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = "./-_?=&#%:~+"
# classes: 0 edge of the URL, 1-26 letters, 27 digits, then the marks, last everything else
CLASSES = 28 + len(MARKS) + 1
ORDER = 3
CELLS = CLASSES ** (ORDER + 1)
HELD_OUT = 5
BINS, BIN_WIDTH = 4096, 1 / 128


class Rule(NamedTuple):
    """``host`` and its subdomains, if the path starts with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


class Model(NamedTuple):
    """``difference``: log-likelihood difference by 4-gram cell; ``threshold``: allowed from here on."""

    difference: np.ndarray
    threshold: float


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule], pick) -> Column:
    """``pick(rule)`` of the longest rule that fits, else NULL. Rules are a short list."""
    found = F.lit(None)
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(pick(rule))).otherwise(found)
    return found


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES - 1, np.int64)
    for n, c in enumerate(LOWER):
        table[ord(c)] = table[ord(c.upper())] = n + 1
    table[ord("0") : ord("9") + 1] = 27
    for n, c in enumerate(MARKS):
        table[ord(c)] = 28 + n
    return table


def _cells(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all 4-grams of all URLs, and how many each URL has (its characters and its end)."""
    rows = [(u or "").partition("://") for u in urls]
    data = [(rest if mark else whole).encode("utf-8", "replace") for whole, mark, rest in rows]
    sizes = np.array([len(d) + 1 for d in data], np.int64)
    edge = b"\x00" * ORDER
    codes = np.frombuffer(edge + (b"\x00" * (ORDER + 1)).join(data) + b"\x00", np.uint8)
    # every URL stands between edges: ORDER in front, one behind
    classes = np.where(codes == 0, 0, _class_table()[codes])
    cell = np.zeros(len(classes) - ORDER, np.int64)
    for back in range(ORDER + 1):
        cell = cell * CLASSES + classes[back : len(classes) - ORDER + back]
    # windows that end inside the next URL's front edge belong to nobody
    starts = np.concatenate(([0], np.cumsum(sizes + ORDER)[:-1])) if len(sizes) else sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return cell[starts[owner] + place], sizes


def _count(labelled: DataFrame) -> np.ndarray:
    """Counts by (rejected 0 / accepted 1, cell), summed over the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            cells, sizes = _cells(batch.column("url").to_pylist())
            accepted = np.repeat(np.array(batch.column("accepted").to_pylist(), np.int64), sizes)
            keys, counts = np.unique(accepted * CELLS + cells, return_counts=True)
            for key, count in zip(keys.tolist(), counts.tolist(), strict=True):
                found[key] = found.get(key, 0) + count
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found.keys()), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["cell", "n"]
        )

    partial = labelled.select("url", F.col("accepted").cast("int").alias("accepted")).mapInArrow(run, "cell bigint, n bigint")
    counts = np.zeros(2 * CELLS, np.float64)
    summed = partial.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most 2 * CELLS rows
    counts[summed["cell"].to_numpy(np.int64)] = summed["n"].to_numpy(np.float64)
    return counts.reshape((2,) + (CLASSES,) * (ORDER + 1))


def _log_likelihood(counts: np.ndarray) -> np.ndarray:
    """log p(last | context), interpolated from order 0 upwards."""
    lower = counts.sum(axis=tuple(range(ORDER)))
    p = (lower + 0.5) / (lower.sum() + 0.5 * CLASSES)
    for order in range(1, ORDER + 1):
        seen = counts.sum(axis=tuple(range(ORDER - order))) if order < ORDER else counts
        total = seen.sum(axis=-1, keepdims=True)
        kinds = (seen > 0).sum(axis=-1, keepdims=True)
        p = np.where(total > 0, (seen + kinds * p) / np.maximum(total + kinds, 1), p)
    return np.log(p).astype(np.float32)


def score(url: Column, difference: np.ndarray, spark) -> Column:
    """Log-likelihood difference per character; NULL for a NULL or empty URL."""
    shared = spark.sparkContext.broadcast(difference.reshape(-1))  # CELLS floats

    def run(urls: pd.Series) -> pd.Series:
        cells, sizes = _cells(urls.tolist())
        if not len(sizes):
            return pd.Series([], dtype="float64")
        sums = np.add.reduceat(shared.value[cells].astype(np.float64), np.cumsum(sizes) - sizes)
        return pd.Series(np.where(sizes > 1, sums / sizes, np.nan))

    run.__annotations__ = {"urls": pd.Series, "return": pd.Series}
    value = F.pandas_udf(run, "double")(url)
    return F.when(F.length(url) > 0, F.when(F.isnan(value), F.lit(0.0)).otherwise(value))


def fit(labelled: DataFrame) -> Model:
    """From (url, accepted): every fifth distinct URL calibrates, the others are counted."""
    rows = labelled.where(F.col("accepted").isNotNull() & (F.length("url") > 0)).select("url", "accepted")
    rows = rows.withColumn("_held", F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0)
    counts = _count(rows.where(~F.col("_held")))
    if not counts[0].any() or not counts[1].any():
        return Model(np.zeros(CELLS, np.float32), 0.0)
    difference = _log_likelihood(counts[1]) - _log_likelihood(counts[0])
    spark = labelled.sparkSession
    place = F.floor(score(F.col("url"), difference, spark) / BIN_WIDTH) + BINS // 2
    held = (
        rows.where("_held")
        .select("accepted", F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1)).cast("int").alias("bin"))
        .groupBy("accepted", "bin").count().collect()  # at most 2 * BINS rows
    )
    by_bin = np.zeros((2, BINS))
    for row in held:
        by_bin[int(row["accepted"]), row["bin"]] = row["count"]
    if not by_bin[0].any() or not by_bin[1].any():
        return Model(difference, 0.0)
    # share of accepted URLs below a bin's lower edge plus share of rejected ones above it
    lost = np.concatenate(([0.0], np.cumsum(by_bin[1])[:-1])) / by_bin[1].sum()
    passed = 1 - np.concatenate(([0.0], np.cumsum(by_bin[0])[:-1])) / by_bin[0].sum()
    errors = lost + passed
    best = np.flatnonzero(errors == errors.min())
    return Model(difference, float((best[len(best) // 2] - BINS // 2) * BIN_WIDTH))


def judge(pages: DataFrame, model: Model, rules: Sequence[Rule] = (), url: str = "url") -> DataFrame:
    """Add host, path, rule, verdict and score. A rule that fits decides; else the models do."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    allow = rule_for(F.col("host"), F.col("path"), rules, lambda r: r.allow).cast("boolean")
    kept = F.coalesce(allow, F.coalesce(F.col("score") >= model.threshold, F.lit(False)))
    return (
        pages.withColumns({"host": host, "path": path, "score": score(F.col(url), model.difference, pages.sparkSession)})
        .withColumn("rule", rule_for(F.col("host"), F.col("path"), rules, lambda r: r.text).cast("string"))
        .withColumn("verdict", F.when(kept, "allow").otherwise("block"))
    )


def labels_from(pages: DataFrame, rules: Sequence[Rule], rejected_words: Sequence[str] = (), url: str = "url") -> DataFrame:
    """(url, accepted) from what is known without a model: the rules, and words of rejected hosts."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    allow = rule_for(host, path, rules, lambda r: r.allow).cast("boolean")
    known_bad = F.lit(False)
    for word in rejected_words:
        known_bad = known_bad | F.contains(host, F.lit(word))
    return pages.select(F.col(url).alias("url"), F.when(known_bad, F.lit(False)).otherwise(allow).alias("accepted"))
