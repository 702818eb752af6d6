"""Exact top-k by distributed histogram selection.

Every candidate is scored against a block of queries. A round gives, per query, a histogram
of the scores inside the bracket that holds its k-th value; the histograms are summed over the
cluster, the bracket shrinks to one bin, and the next round scores again with finer bins. Bins
are whole numbers wide, so the last ones may reach past the bracket; what lies there is not counted. When
a bracket is one integer wide, or no more than SLACK scores lie above its lower edge, that edge
is the query's bound: a last pass keeps scores from the bound on and breaks ties by id.

A task sends only what can matter: of a histogram the top bins up to its own k-th value, of
the last pass its own k best by (score, id). So one vector that many rows share costs no more
than another. Queries come in blocks of bounded size; a block is all that the driver holds and
sends out. Blocks are independent and land one after the other.

Scores are exact integer inner products. Pairs whose score may pass 61 bits are scored in Python
integers, and ranked by them; ``score`` is NULL where a score does not fit into BIGINT. Where a
block has such pairs, its brackets are over the scores' floating-point patterns, which grow with
the scores; equal patterns are told apart by the last pass. Vectors that are NULL, empty, or hold
NULL or non-finite components (as DOUBLE, after scaling) take no part, nor do NULL ids.
Only vectors of equal length meet. A query's own row is every row of its id. Repeated queries
count once; repeated candidates count each time. Fewer than k candidates: all are returned.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 1024
BINS = 256
SLACK = 64
EDGE = 1 << 61
HUGE = 1 << 1000
LONG = (1 << 63) - 1


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component as DOUBLE, exact; NULL if the vector takes no part."""
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  beyond, all are integers
    x = F.transform(vector, lambda v: whole(v.cast("double") * factor))
    usable = F.forall(vector, lambda v: F.coalesce(F.abs(v.cast("double") * factor) < math.inf, F.lit(False)))
    return F.when(usable & (F.size(vector) > 0), x)


def _place(score: np.ndarray, wide: bool) -> np.ndarray:
    """Integers within 62 bits that never fall where the scores grow; the scores themselves if not ``wide``."""
    if not wide:
        return score
    if score.dtype == object:
        score = np.minimum(np.maximum(score, -HUGE), HUGE)
    number = score.astype(float)
    return np.where(number < 0, -1, 1) * (np.abs(number).view(np.int64) >> 2)


def _product(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(queries x candidates), as int64 or as Python integers."""
    bound = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * vectors.shape[1]
    if bound < 2.0**53:  # exact in floating point, and much faster there
        return (queries @ vectors.T).astype(np.int64)
    if bound < EDGE / 2:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    whole = lambda rows: np.array([[int(x) for x in row] for row in rows.tolist()], object).reshape(rows.shape)
    return whole(queries) @ whole(vectors).T


def _classes(vectors: np.ndarray) -> list[np.ndarray]:
    """Row numbers by size of components, so that a few large rows do not slow down the others."""
    largest, n = np.abs(vectors).max(axis=1, initial=0), vectors.shape[1]
    kind = np.digitize(largest, [math.sqrt(2.0**53 / n), math.sqrt(EDGE / 2 / n)])
    return [np.flatnonzero(kind == c) for c in np.unique(kind)]


def _rank_key(score: int) -> str:
    """Text that sorts as the score does, among those cut to the same BIGINT."""
    if -LONG - 1 <= score <= LONG:
        return "1"
    digits = f"{abs(score):x}"
    text = f"{len(digits):04x}{digits}"
    return "2" + text if score > 0 else "0" + "".join(f"{15 - int(c, 16):x}" for c in text) + "g"


class _Block:
    """Queries of one length, and the bracket of each one's k-th score."""

    def __init__(self, ids: list[int], vectors: list[list[float]], largest: float, k: int):
        self.ids, self.vectors = np.array(ids, np.int64), np.array(vectors, np.float64)
        self.classes = _classes(self.vectors)
        norms = [sum(int(v) ** 2 for v in row) for row in vectors]
        most = math.ceil(largest * 1.001) if largest < HUGE else HUGE * HUGE * HUGE
        reach = [math.isqrt(n * most) + 1 for n in norms]  # no score lies beyond |q| * max |x|
        self.wide = max(reach) >= EDGE
        if self.wide:
            reach = [int(_place(np.array([r], object), True)[0]) + 1 for r in reach]
        self.low = np.array([-r for r in reach], np.int64)
        self.width = np.array([-(-(2 * r + 1) // BINS) for r in reach], np.int64)
        self.high = np.array([r + 1 for r in reach], np.int64)  # the first value above the bracket
        self.need = np.full(len(ids), k, np.int64)
        self.open = np.ones(len(ids), bool)

    def scores(self, ids: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, candidates, their scores, places of these, where a candidate is the query's own row), in parts."""
        for c in _classes(vectors):
            for q in self.classes:
                found = _product(self.vectors[q], vectors[c])
                yield q, c, found, _place(found, self.wide), self.ids[q][:, None] == ids[c][None, :]


def _chunks(batches: Iterator[pa.RecordBatch], sizes: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, vectors) of runs of candidates of equal length."""
    for batch in batches:
        column, ids = batch.column("vector"), batch.column("id").to_numpy()
        flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
        lengths = np.diff(ends)
        for size in sizes & set(lengths.tolist()):
            rows = np.flatnonzero(lengths == size)
            for at in range(0, len(rows), CANDIDATE_BLOCK):
                part = rows[at : at + CANDIDATE_BLOCK]
                yield size, ids[part], flat[ends[part][:, None] + np.arange(size)[None, :]]


def _histograms(blocks: dict[int, _Block]):
    """One round: (size, query, bin, n) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {size: np.zeros((len(b.ids), BINS), np.int64) for size, b in blocks.items()}
        for size, ids, vectors in _chunks(batches, set(blocks)):
            b = blocks[size]
            for q, _, _, at, own in b.scores(ids, vectors):
                place = (at - b.low[q][:, None]) // b.width[q][:, None]
                inside = (place >= 0) & (at < b.high[q][:, None]) & ~own & b.open[q][:, None]
                row, _ = np.nonzero(inside)
                counts[size] += np.bincount(q[row] * BINS + place[inside], minlength=counts[size].size).reshape(-1, BINS)
        for size, count in counts.items():
            # bins under this task's own k-th value cannot hold the k-th value of all
            above = np.cumsum(count[:, ::-1], axis=1)[:, ::-1] - count
            q, place = np.nonzero((count > 0) & (above < blocks[size].need[:, None]))
            n = count[q, place]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(q), size, np.int64)), pa.array(q), pa.array(place), pa.array(n)], names=["size", "q", "bin", "n"]
            )

    return run


def _shrink(block: _Block, rows: list) -> None:
    """Move each open bracket to the bin of its k-th score."""
    count = np.zeros((len(block.ids), BINS), np.int64)
    for row in rows:
        count[row["q"], row["bin"]] = row["n"]
    upto = np.cumsum(count[:, ::-1], axis=1)[:, ::-1]  # in this bin or above
    enough = upto >= block.need[:, None]
    for q in np.flatnonzero(block.open):
        if not enough[q].any():  # fewer than k candidates: take all from the lower edge on
            block.open[q] = False
            continue
        place = int(np.flatnonzero(enough[q])[-1])
        block.low[q] += place * block.width[q]
        block.high[q] = min(block.high[q], block.low[q] + block.width[q])
        above = int(upto[q, place] - count[q, place])
        if block.width[q] == 1 or upto[q, place] <= min(SLACK, block.need[q] + SLACK):
            block.open[q] = False
            continue
        block.need[q] -= above
        block.width[q] = -(-block.width[q] // BINS)


def _selected(blocks: dict[int, _Block], k: int):
    """The last pass: a task's k best of each query among the scores from its bound on."""

    def best(rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        q, ids, scores = rows
        if scores.dtype == object:  # the ranks of the scores sort as they do
            order = {score: n for n, score in enumerate(sorted(set(scores.tolist())))}
            down = -np.array([order[score] for score in scores.tolist()], np.int64)
        else:
            down = -scores
        order = np.lexsort((ids, down, q))
        q = q[order]
        first = np.concatenate(([0], np.flatnonzero(np.diff(q)) + 1)) if len(q) else np.zeros(0, int)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate((first, [len(q)]))))
        return tuple(x[rank < k] for x in (q, ids[order], scores[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {size: tuple(np.zeros(0, np.int64) for _ in range(3)) for size in blocks}
        for size, ids, vectors in _chunks(batches, set(blocks)):
            b = blocks[size]
            for q, c, found, at, own in b.scores(ids, vectors):
                i, j = np.nonzero((at >= b.low[q][:, None]) & ~own)
                kept[size] = best(tuple(map(np.concatenate, zip(kept[size], (q[i], ids[c[j]], found[i, j])))))
        for size, (q, ids, scores) in kept.items():
            exact = scores.tolist()
            cut = [max(-LONG - 1, min(LONG, s)) for s in exact]
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks[size].ids[q]), pa.array(np.full(len(q), size, np.int64)), pa.array(q), pa.array(ids), pa.array(cut, pa.int64()),
                 pa.array(map(_rank_key, exact), pa.string())],
                names=["query_id", "size", "q", "vec_id", "score", "more"],
            )

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
          factor: int = 256, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every row that ``is_query``."""
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("id"), scaled(F.col(embedding), factor).alias("vector"), is_query.alias("asks")
    ).where("id IS NOT NULL AND vector IS NOT NULL")
    norm = F.aggregate("vector", F.lit(0).cast("double"), lambda s, v: s + v * v)
    facts = rows.agg(F.max(norm).alias("largest"), F.count(F.when(F.col("asks"), 1)).alias("asking")).first()
    path = work_dir(spark, "top-k")
    kinds = "query_id bigint, size bigint, q bigint, vec_id bigint, score bigint, more string"
    candidates = rows.select("id", "vector")
    n_blocks = -(-facts["asking"] // query_block)
    for n in range(n_blocks):
        asked = rows.where("asks").where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == n).select("id", "vector")
        asked = asked.dropDuplicates().collect()  # one block
        by_size: dict[int, list] = {}
        for row in sorted(asked, key=lambda r: (r["id"], r["vector"])):
            by_size.setdefault(len(row["vector"]), []).append(row)
        blocks = {s: _Block([r["id"] for r in found], [r["vector"] for r in found], facts["largest"], k) for s, found in by_size.items()}
        while any(b.open.any() for b in blocks.values()):
            partial = candidates.mapInArrow(_histograms(blocks), "size bigint, q bigint, bin bigint, n bigint")
            summed = partial.groupBy("size", "q", "bin").agg(F.sum("n").alias("n")).collect()  # at most BINS rows a query
            for size, block in blocks.items():
                _shrink(block, [r for r in summed if r["size"] == size])
        chosen = candidates.mapInArrow(_selected(blocks, k), kinds)
        order = Window.partitionBy("size", "q").orderBy(F.desc("score"), F.desc("more"), "vec_id")
        chosen = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        fits = F.when(F.col("more") == "1", F.col("score")).alias("score")
        chosen.select("query_id", "rank", "vec_id", fits).write.mode("append").parquet(path)
    kinds = "query_id bigint, rank int, vec_id bigint, score bigint"
    return spark.read.schema(kinds).parquet(path) if n_blocks else spark.createDataFrame([], kinds)
