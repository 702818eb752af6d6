"""Quality classifier: attention over the passages of a document.

A document is a bag of passages of 48 words. Every passage of the whole text is encoded by
numbers taken from its characters and words; a gated attention (tanh times sigmoid) gives
each encoded passage a weight, learned from document labels alone; the weighted sum of the
passages is scored.

The model is small (a few thousand weights) and is fitted in the driver on a bounded sample:
at most ``per_class`` labelled documents of each label, the first by a hash of their id, each
of at most ``fit_passages`` passages. Everything else is scored over all passages of all
documents, in pieces of bounded memory.

Defined cases: NULL, empty and blank texts are one passage without words. Labels other than
0 and 1 and labels of no document teach nothing; a document labelled twice counts with its
smaller label. Without both labels every score is 1, so nothing is rejected. Repeated rows are
scored alike; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PER_CLASS = 2048
FIT_PASSAGES = 512
PASSAGE_WORDS = 48
THRESHOLD = 0.7
PIECE_BYTES = 1 << 21
# byte classes: 0 white space, then these, then any other punctuation, then bytes beyond ASCII
CLASSES = [
    b" \t\n\r\v\f", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".", b",", b"!", b"?", b"|",
    b"#$%&*@^~+=<>_\\", b"'\"-:;()[]{}/`",
]
N_CLASSES = len(CLASSES) + 2
WORD_BUCKETS = 32
LONG_WORD = 16
N_FEATURES = (N_CLASSES - 1) + 8 + WORD_BUCKETS
HIDDEN, GATE = 24, 16
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 64, 0.01, 1e-4, 7


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    shift: float


def _byte_classes() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.uint8)
    table[128:] = len(CLASSES) + 1
    for n, members in enumerate(CLASSES):
        table[list(members)] = n
    return table


def _encode(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and the number of passages of each text.

    ``buf`` holds the texts' bytes one behind the other, ``ends`` where each one ends.
    """
    classes = _byte_classes()[buf]
    inside = classes > 0
    first = np.zeros(len(buf) + 1, bool)
    first[np.concatenate(([0], ends))] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    doc_of_word = np.searchsorted(ends, starts, side="right")
    words = np.bincount(doc_of_word, minlength=len(ends))
    passages = np.maximum(-(-words // PASSAGE_WORDS), 1)
    total = int(passages.sum())
    out = np.zeros((total, N_FEATURES), np.float32)
    if not len(starts):
        return out, passages
    number = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    passage = (np.cumsum(passages) - passages)[doc_of_word] + number // PASSAGE_WORDS

    word_of_byte = np.cumsum(np.bincount(starts, minlength=len(buf))) - 1
    spot = np.flatnonzero(inside)
    owner = word_of_byte[spot]
    by_class = np.bincount(passage[owner] * N_CLASSES + classes[spot], minlength=total * N_CLASSES)
    by_class = by_class.reshape(total, N_CLASSES)[:, 1:]
    size = np.bincount(owner, minlength=len(starts))
    last = classes[starts + size - 1]

    # a word's hash: its bytes times powers of an odd number
    powers = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
    terms = (buf[spot].astype(np.uint64) + np.uint64(1)) * powers[np.minimum(spot - starts[owner], 63)]
    code = np.add.reduceat(terms, np.concatenate(([0], np.cumsum(size)[:-1])))
    code ^= code >> np.uint64(29)
    same = lambda back: np.concatenate((
        np.zeros(min(back, len(code)), bool), (code[back:] == code[:-back]) & (doc_of_word[back:] == doc_of_word[:-back])
    ))
    kinds = np.unique((passage.astype(np.uint64) << np.uint64(40)) ^ (code & np.uint64((1 << 40) - 1)))
    count = np.bincount(passage, minlength=total)
    n = np.maximum(count, 1)
    share = lambda mask: np.bincount(passage, weights=mask, minlength=total) / n
    letters = np.maximum(by_class.sum(axis=1, keepdims=True), 1)
    out[:, : N_CLASSES - 1] = by_class / letters
    at = N_CLASSES - 1
    out[:, at] = np.bincount((kinds >> np.uint64(40)).astype(np.int64), minlength=total) / n
    out[:, at + 1] = share(same(1))
    out[:, at + 2] = share(same(2))
    out[:, at + 3] = share(size) / 8
    out[:, at + 4] = share(size > LONG_WORD)
    out[:, at + 5] = share((last == 4) | (last == 6) | (last == 7))
    out[:, at + 6] = share((last == 8) | (last == 9))
    out[:, at + 7] = count / PASSAGE_WORDS
    buckets = np.bincount(passage * WORD_BUCKETS + (code % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=total * WORD_BUCKETS)
    out[:, at + 8 :] = buckets.reshape(total, WORD_BUCKETS) / n[:, None]
    return out, passages


def _bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and passage counts of consecutive runs of texts of bounded size.

    A text longer than a run is cut at white space and its passages are put together again.
    """
    texts = texts.fill_null("").cast(pa.binary())
    run: list[bytes] = []
    held = 0

    def encoded():
        ends = np.cumsum([len(t) for t in run])
        return _encode(np.frombuffer(b"".join(run), np.uint8), ends)

    for value in texts:
        data = value.as_py()
        if run and held + len(data) > PIECE_BYTES:
            yield encoded()
            run, held = [], 0
        if len(data) <= PIECE_BYTES:
            run.append(data)
            held += len(data)
            continue
        parts, at = [], 0
        while at < len(data):
            end = min(at + PIECE_BYTES, len(data))
            while end < len(data) and data[end] not in CLASSES[0] and end < at + 2 * PIECE_BYTES:
                end += 1
            parts.append(_encode(np.frombuffer(data[at:end], np.uint8), np.array([end - at]))[0])
            at = end
        rows = np.concatenate(parts)
        yield rows, np.array([len(rows)])
    if run:
        yield encoded()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """All steps of scoring bags of passages."""
    starts = np.cumsum(sizes) - sizes
    h = np.tanh(x @ w["w"] + w["b"])
    t, s = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
    raw = (t * s) @ w["a"]
    raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), sizes))
    weight = raw / np.repeat(np.add.reduceat(raw, starts), sizes)
    z = np.add.reduceat(h * weight[:, None], starts)
    return {"h": h, "t": t, "s": s, "weight": weight, "z": z, "logit": z @ w["o"] + w["c"]}


def _gradient(w: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss."""
    f = _forward(w, x, sizes)
    d_logit = (_sigmoid(f["logit"]) - y) / len(y)
    bag = np.repeat(np.arange(len(y)), sizes)
    d_z = d_logit[:, None] * w["o"]
    d_weight = (f["h"] * d_z[bag]).sum(axis=1)
    mean = np.add.reduceat(f["weight"] * d_weight, np.cumsum(sizes) - sizes)
    d_raw = f["weight"] * (d_weight - mean[bag])
    d_gate = d_raw[:, None] * w["a"]
    d_t = d_gate * f["s"] * (1 - f["t"] ** 2)
    d_s = d_gate * f["t"] * f["s"] * (1 - f["s"])
    d_h = d_z[bag] * f["weight"][:, None] + d_t @ w["v"].T + d_s @ w["u"].T
    d_pre = d_h * (1 - f["h"] ** 2)
    return {
        "w": x.T @ d_pre, "b": d_pre.sum(axis=0), "v": f["h"].T @ d_t, "u": f["h"].T @ d_s,
        "a": (f["t"] * f["s"]).T @ d_raw, "o": f["z"].T @ d_logit, "c": d_logit.sum(keepdims=True),
    }


def _train(bags: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    everything = np.concatenate(bags).astype(np.float64)
    mean, scale = everything.mean(axis=0), everything.std(axis=0) + 1e-3
    bags = [(b - mean) / scale for b in bags]
    rng = np.random.default_rng(SEED)
    shape = {"w": (N_FEATURES, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "o": (HIDDEN,), "c": (1,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bc" else np.zeros(s) for k, s in shape.items()}
    slow, square, step = {k: np.zeros(s) for k, s in shape.items()}, {k: np.zeros(s) for k, s in shape.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            sizes = np.array([len(bags[i]) for i in part])
            g = _gradient(w, np.concatenate([bags[i] for i in part]), sizes, y[part])
            step += 1
            for k in w:
                d = g[k] + DECAY * w[k]
                slow[k] = 0.9 * slow[k] + 0.1 * d
                square[k] = 0.999 * square[k] + 0.001 * d * d
                w[k] = w[k] - RATE * (slow[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        per_class: int = PER_CLASS, fit_passages: int = FIT_PASSAGES) -> Model | None:
    """From documents and their labels (0 reject, 1 keep); None without both labels."""
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).cast("int").alias("_label"))
    )
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    if len(counts) < 2:
        return None
    order = [F.xxhash64("_id"), F.col("_id")]
    first = lambda y: known.where(F.col("_label") == y).orderBy(*order).limit(per_class)
    sample = F.broadcast(first(0).unionByName(first(1)))  # at most 2 * per_class narrow rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, y, at = batch.column("_id"), batch.column("_label"), 0
            for rows, sizes in _bags(batch.column("_text")):
                ends = np.cumsum(sizes)
                data = [rows[e - s : e].tobytes() if s <= fit_passages else None for e, s in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(sizes)), y.slice(at, len(sizes)), pa.array(data, pa.binary())], names=["_id", "_label", "_rows"]
                )
                at += len(sizes)

    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(sample, "_id")
    kind = dict(texts.dtypes)["_id"]
    bags = (
        texts.mapInArrow(run, f"_id {kind}, _label int, _rows binary").where("_rows IS NOT NULL")
        .dropDuplicates(["_id", "_rows"]).collect()  # bounded by the sample
    )
    bags.sort(key=lambda r: (r["_id"], bytes(r["_rows"])))
    y = np.array([r["_label"] for r in bags], float)
    if not 0 < y.sum() < len(y):
        return None
    mean, scale, w = _train([np.frombuffer(r["_rows"], np.float32).reshape(-1, N_FEATURES) for r in bags], y)
    # the sample has other shares of the labels than the labelled documents
    shift = np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(mean, scale, w, float(shift))


def score(text: Column, model: Model | None) -> Column:
    """0 to 1; higher where label 1 is likelier."""
    if model is None:
        return F.lit(1.0)

    def run(texts: pa.Array) -> pa.Array:
        found = [np.zeros(0)]
        for rows, sizes in _bags(texts):
            logit = _forward(model.weights, (rows - model.mean) / model.scale, sizes)["logit"]
            found.append(_sigmoid(logit + model.shift))
        return pa.array(np.concatenate(found))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(F.coalesce(text, F.lit("")))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are kept for judging the classifier."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def passages_of(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``attention``: the weight of every passage, in order."""

    def run(texts: pa.Array) -> pa.Array:
        found: list[np.ndarray] = []
        for rows, sizes in _bags(texts):
            weight = _forward(model.weights, (rows - model.mean) / model.scale, sizes)["weight"]
            found += np.split(weight, np.cumsum(sizes)[:-1])
        return pa.array([w.tolist() for w in found], pa.list_(pa.float64()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn("attention", F.arrow_udf(run, "array<double>")(F.coalesce(F.col(text), F.lit(""))))
