"""Near duplicates by an inverted join of MinHash coordinates.

A document's set is that of its distinct 5-word shingles. Copies (equal sets of words in equal
order) are one class; a class has a MinHash signature of K coordinates. Classes are posted under
their (coordinate, value) pairs. Two sets of similarity 0.75 agree in 48 of 64 coordinates on
average and in fewer than MATCHES = 32 about once in 100,000 times, so a pair counts if it
collides MATCHES times:

* pairs that only one class has cannot collide; a class with fewer than MATCHES others is done;
* prefix: with pairs ordered from rare to frequent, classes that collide MATCHES times share one
  of their first K - MATCHES + 1 pairs, so only those are posted. What many documents have in
  common (a shared line or passage) is frequent and stays out of nearly all prefixes;
* the postings of a pair belong to the family of their centre, the class whose pairs are the most
  frequent, so classes that share a posting share a family. Inside a family collisions are counted, pairs below MATCHES are skipped, the others are confirmed on
  their full sets.

A family may be a large part of the corpus (near copies of one text), and no family is handled
by one task. Members of a large family are first compared with its CENTRES classes of the most
frequent pairs, which are those that most copies resemble. The largest part that these link
needs no more comparisons inside; the classes left over are compared with the whole family,
block by block. No pair of classes that may link two components is passed over, and no task
emits more links than it has rows.

Links between classes make components; a document's component is the smallest doc_id in it.

Defined cases: texts without words and NULL texts have no shingles and are linked with nothing;
fewer than five words are one shingle; repeated rows are copies; NULL ids sort behind all others;
extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import land, skew_join
from .components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 5
NEAR_PERCENT = 75
K = 64
MATCHES = 32
CENTRES = 8
BLOCK = 512
KNOWN_WORDS = 1 << 19
PART = 1 << 13
SLOTS = 1 << 20
_MASK = (1 << 64) - 1
# odd multipliers and offsets, from a counter through a mixing function
_NUMBERS = [((i + 1) * 0x9E3779B97F4A7C15) & _MASK for i in range(2 * K + WORDS)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Shingler:
    def __init__(self):
        import xxhash

        self.hash = xxhash.xxh64_intdigest
        self.known: dict[bytes, int] = {}
        numbers = _mix(np.array(_NUMBERS, np.uint64))
        self.factors = numbers[:K] | np.uint64(1)
        self.offsets = numbers[K : 2 * K]
        self.places = numbers[2 * K :] | np.uint64(1)

    def words(self, text: str) -> list[bytes]:
        return text.encode("utf-8", "replace").lower().split()

    def node(self, words: list[bytes]) -> int:
        return self.hash(b" ".join(words)) - (1 << 63)

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """Sorted distinct hashes of the shingles."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known, make = self.known, self.hash
        codes = np.empty(len(words), np.uint64)
        for i, word in enumerate(words):
            code = known.get(word)
            if code is None:
                code = known[word] = make(word)
            codes[i] = code
        if len(words) < WORDS:
            # one shingle, told from longer ones by its length
            whole = np.uint64(len(words))
            for code, place in zip(codes, self.places):
                whole = whole + code * place
            return _mix(np.array([whole], np.uint64))
        n = len(words) - WORDS + 1
        total = np.full(n, WORDS, np.uint64)
        for i, place in enumerate(self.places):
            total += codes[i : i + n] * place
        return np.unique(_mix(total))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(K, _MASK, np.uint64)
        for at in range(0, len(shingles), PART):
            values = shingles[at : at + PART, None] * self.factors + self.offsets
            values ^= values >> np.uint64(31)
            least = np.minimum(least, (values * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0))
        return least


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and text_hash as they are, node (the class), n_shingles, signature."""
    shingler = _Shingler()
    with np.errstate(over="ignore"):
        for batch in batches:
            nodes, sizes, signatures = [], [], []
            for text in batch.column("text").to_pylist():
                words = shingler.words(text or "")
                shingles = shingler.shingles(words) if words else None
                nodes.append(shingler.node(words) if words else None)
                sizes.append(len(shingles) if words else 0)
                signatures.append(shingler.signature(shingles).tobytes() if words else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary())],
                names=["doc_id", "text_hash", "node", "n_shingles", "signature"],
            )


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, token: the (coordinate, value) pairs as numbers."""
    with np.errstate(over="ignore"):
        coordinate = _mix(np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        for batch in batches:
            data = b"".join(batch.column("signature").to_pylist())
            values = np.frombuffer(data, np.uint64).reshape(-1, K)
            tokens = _mix(values + coordinate).view(np.int64).reshape(-1)
            nodes = np.repeat(batch.column("node").to_numpy(), K)
            for at in range(0, len(tokens), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(tokens[part])], names=["node", "token"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members with signature and full set; rows of another text under the same id are left out."""
    shingler = _Shingler()
    with np.errstate(over="ignore"):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                words = shingler.words(row["text"] or "")
                if words and shingler.node(words) == row["node"]:
                    shingles = shingler.shingles(words)
                    rows.append({
                        "node": row["node"], "family": row["family"], "weight": row["weight"],
                        "signature": shingler.signature(shingles).tobytes(), "shingles": shingles.tobytes(),
                    })
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([
                    ("node", pa.int64()), ("family", pa.int64()), ("weight", pa.int64()), ("signature", pa.binary()), ("shingles", pa.binary()),
                ]))


MEMBERS = "node bigint, family bigint, weight bigint, signature binary, shingles binary"


class _Sets:
    """Some members, ready to be compared with one more."""

    def __init__(self, signatures: list[bytes], shingles: list[bytes]):
        self.signatures = np.frombuffer(b"".join(signatures), np.uint64).reshape(-1, K)
        self.sizes = np.array([len(s) // 8 for s in shingles], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.all = np.frombuffer(b"".join(shingles), np.uint64)

    def near(self, signature: bytes, shingles: bytes) -> np.ndarray:
        """Places of members that collide often enough and are confirmed on the full sets."""
        hits = np.flatnonzero((self.signatures == np.frombuffer(signature, np.uint64)).sum(axis=1) >= MATCHES)
        if not len(hits):
            return hits
        own = np.frombuffer(shingles, np.uint64)
        picked = np.concatenate([self.all[s : s + n] for s, n in zip(self.starts[hits], self.sizes[hits])])
        place = np.minimum(np.searchsorted(own, picked), len(own) - 1)
        sizes = self.sizes[hits]
        both = np.add.reduceat((own[place] == picked).astype(np.int64), np.cumsum(sizes) - sizes)
        return hits[100 * both >= NEAR_PERCENT * (len(own) + sizes - both)]


def _to_centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members with the centres they are linked with, as ids and as the bits of ``mask``."""
    for batch in batches:
        masks, links = [], []
        for row in batch.select(["signature", "shingles", "centres"]).to_pylist():
            centres = row["centres"]
            near = _Sets([c["signature"] for c in centres], [c["shingles"] for c in centres]).near(row["signature"], row["shingles"])
            masks.append(sum(1 << int(i) for i in near))
            links.append([centres[i]["node"] for i in near])
        yield pa.RecordBatch.from_arrays(
            [batch.column("family"), batch.column("node"), pa.array(masks, pa.int32()), pa.array(links, pa.list_(pa.int64()))],
            names=["family", "node", "mask", "links"],
        )


def _mask_roots(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a family's distinct masks (fewer than 2^CENTRES): the lowest centre of each one's component."""
    parts: list[int] = []
    for mask in rows["mask"]:
        mask = int(mask)
        parts, apart = [p for p in parts if not p & mask], [p for p in parts if p & mask]
        for p in apart:
            mask |= p
        parts.append(mask)
    whole = [next(p for p in parts if p & int(m)) for m in rows["mask"]]
    sizes = rows["n"].groupby(whole).sum()
    main = max(sizes.index, key=lambda p: (sizes[p], -p))
    return rows[["family", "mask"]].assign(lowest=[(w & -w).bit_length() - 1 for w in whole], main=[w == main for w in whole])


def _link_block(rows: pd.DataFrame) -> pd.DataFrame:
    """One block of left-over members against one block of the family: links that join components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    rows = rows.drop_duplicates(["node", "left"])
    for node, known in zip(rows["node"], rows["root"]):
        root.setdefault(find(int(node)), int(node))
        root[find(int(node))] = find(int(known))
    members, links = rows[~rows["left"]], []
    if len(members):
        sets, nodes = _Sets(list(members["signature"]), list(members["shingles"])), members["node"].to_numpy()
        for row in rows[rows["left"]].itertuples():
            for i in sets.near(row.signature, row.shingles):
                a, b = find(int(row.node)), find(int(nodes[i]))
                if a != b:
                    root[a] = b
                    links.append((int(row.node), int(nodes[i])))
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _slot(value: Column) -> Column:
    """One of SLOTS hash slots."""
    return F.pmod(F.xxhash64(value), F.lit(SLOTS)).cast("int")


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", _text_hash("text"))
    return rows.mapInArrow(_features, "doc_id bigint, text_hash bigint, node bigint, n_shingles bigint, signature binary")


def postings(classes: DataFrame) -> DataFrame:
    """(node, token, weight): the prefix pairs of classes that may collide MATCHES times."""
    tokens = classes.select("node", "signature").mapInArrow(_tokens, "node bigint, token bigint")
    shared = land(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-tokens")
    own = Window.partitionBy("node")
    hits = tokens.join(shared, "token").withColumns({
        "hits": F.count(F.lit(1)).over(own), "weight": F.sum("n").over(own),
        "rank": F.row_number().over(own.orderBy("n", "token")),
    })
    # pairs of one class alone come first in the order and fill up its prefix
    return hits.where((F.col("hits") >= MATCHES) & (F.col("rank") <= F.col("hits") - MATCHES + 1)).select("node", "token", "weight")


def families(posted: DataFrame) -> DataFrame:
    """(node, family, weight) of classes that share postings.

    A token's centre is its heaviest class, its family the heaviest centre that this class itself
    is posted with. The family depends on the token alone, so classes that share one meet; few
    classes are in more than one family.
    """
    top = posted.groupBy("token").agg(F.max(F.struct("weight", "node")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    named = land(
        skew_join(posted, top.select("token", F.col("top.weight").alias("heavy"), F.col("top.node").alias("centre")), "token").drop("token"), "near-centres"
    )
    best = named.groupBy("node").agg(F.max(F.struct("heavy", "centre")).alias("best")).select(F.col("node").alias("centre"), F.col("best.centre").alias("family"))
    return skew_join(named, best, "centre").groupBy("node", "family").agg(F.max("weight").alias("weight"))


def links(members: DataFrame) -> DataFrame:
    """(a, b): confirmed links that make the components of every family; other links add nothing."""
    sizes = land(members.groupBy("family").agg(F.count(F.lit(1)).alias("size")), "family-sizes")
    large = land(sizes.where(F.col("size") > BLOCK), "large-families")
    small = members.join(sizes.where(F.col("size") <= BLOCK).select("family"), "family")
    data = ["family", "node", "root", "signature", "shingles"]
    none = F.lit(0).cast("bigint")
    alone = small.withColumns({"root": F.col("node"), "block": none, "left_block": none})
    units = alone.select(*data, F.explode(F.array(F.lit(False), F.lit(True))).alias("left"), "block", "left_block")
    if large.isEmpty():
        return units.groupBy("family", "block", "left_block").applyInPandas(_link_block, "a bigint, b bigint")
    # centres of large families: at most CENTRES rows each
    by_weight = Window.partitionBy("family").orderBy(F.desc("weight"), "node")
    heavy = members.join(large, "family")
    best = heavy.select("family", "node", "weight").withColumn("rank", F.row_number().over(by_weight)).where(F.col("rank") <= CENTRES)
    centres = members.join(best.select("family", "node"), ["family", "node"]).groupBy("family").agg(
        F.collect_list(F.struct("node", "signature", "shingles")).alias("centres")
    )
    centres = land(centres, "centres")
    masked = members.join(centres, "family").select("family", "node", "signature", "shingles", "centres")
    masked = land(masked.mapInArrow(_to_centres, "family bigint, node bigint, mask int, links array<bigint>"), "centre-links")
    masks = masked.where("mask <> 0").groupBy("family", "mask").agg(F.count(F.lit(1)).alias("n"))
    roots = masks.groupBy("family").applyInPandas(_mask_roots, "family bigint, mask int, lowest int, main boolean")
    ids = centres.select("family", F.transform("centres", lambda c: c["node"]).alias("ids"))
    roots = land(roots.join(ids, "family").select("family", "mask", "main", F.get("ids", F.col("lowest")).alias("root")), "centre-roots")
    placed = masked.select("family", "node", "mask").join(roots, ["family", "mask"], "left").select(
        "family", "node", F.coalesce("root", "node").alias("root"), F.coalesce(~F.col("main"), F.lit(True)).alias("rest")
    )
    placed = land(placed, "placed")
    facts = placed.groupBy("family").agg(F.count(F.lit(1)).alias("size"), F.count_if("rest").alias("rest_size")).where("rest_size > 0")
    facts = land(facts.select("family", F.ceil(F.col("size") / BLOCK).alias("blocks"), F.ceil(F.col("rest_size") / BLOCK).alias("left_blocks")), "families")
    rows = members.join(placed, ["family", "node"]).join(facts, "family")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
    left_block = F.pmod(F.xxhash64("node"), F.col("left_blocks")).alias("left_block")
    each = lambda n: F.explode(F.sequence(none, F.col(n) - 1))
    every = rows.select(*data, F.lit(False).alias("left"), block, each("left_blocks").alias("left_block"))
    rest = rows.where("rest").select(*data, F.lit(True).alias("left"), each("blocks").alias("block"), left_block)
    units = units.union(every).union(rest)
    pairs = units.groupBy("family", "block", "left_block").applyInPandas(_link_block, "a bigint, b bigint")
    return pairs.union(masked.select(F.col("node").alias("a"), F.explode("links").alias("b")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, component, component_id, kept), one row a document.

    ``component`` numbers the components; it is NULL for documents without shingles.
    """
    rows = land(features(docs, doc_id, text), "near-features")
    classes = land(
        rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("signature").alias("signature")), "near-classes"
    )
    candidates = land(families(land(postings(classes), "near-postings")), "near-families")
    wanted = land(classes.select("node", "least").join(candidates, "node"), "near-wanted")
    texts = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("text"))
    # most texts have no partner and need not move: a set of at most SLOTS hash slots, broadcast,
    # tells nearly all of them; the join that follows is exact
    slots = wanted.select(_slot(F.col("least")).alias("_slot")).distinct()
    texts = texts.join(F.broadcast(slots), _slot(F.col("_id")) == F.col("_slot"), "left_semi")
    members = texts.hint("merge").join(wanted, F.col("_id").eqNullSafe(F.col("least")))
    members = members.select("node", "family", "weight", "text").mapInArrow(_sets, MEMBERS)
    found = components(links(land(members, "near-members")))
    roots = land(classes.select("node", "least").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-roots")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = land(skew_join(roots, least, "root").select("node", F.col("root").alias("component"), "component_id"), "near-components")
    linked = rows.where("node IS NOT NULL").select("doc_id", "text_hash", "node", "n_shingles").join(named, "node")
    alone = rows.where("node IS NULL").select("doc_id", "text_hash", "n_shingles", F.col("node").alias("component"), F.col("doc_id").alias("component_id"))
    return linked.select(*alone.columns).union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, one of each group of near duplicates: that of the smallest id (then text hash).

    Documents without words are no duplicates of anything; of rows equal in id and text one stays.
    Only documents that share a hash slot with one that goes are compared with the list of those.
    """
    near = land(near_duplicates(docs, doc_id, text), "near-all")
    grouped = near.where("n_shingles > 0").select("component", "doc_id", "text_hash")
    first = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("one"))
    stays = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("text_hash") == F.col("one.text_hash"))
    gone = land(skew_join(grouped, first, "component").where(~stays).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "near-gone")
    twice = near.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count(F.lit(1)).alias("n"))
    twice = land(twice.where("n > 1").drop("n"), "near-repeated")
    rows = docs.withColumn("_hash", _text_hash(text)).withColumn("_slot", _slot(F.col("_hash")))
    slots = F.broadcast(gone.union(twice).select(_slot(F.col("_hash")).alias("_slot")).distinct())  # at most SLOTS rows
    same = lambda right: F.col(doc_id).cast("bigint").eqNullSafe(right["_id"]) & (F.col("_hash_") == right["_hash"])
    clear = rows.join(slots, "_slot", "left_anti")
    met = rows.join(slots, "_slot", "left_semi").withColumnRenamed("_hash", "_hash_")
    met = met.join(gone, same(gone), "left_anti")
    if not twice.isEmpty():
        several = met.join(twice, same(twice), "left_semi").dropDuplicates([doc_id, "_hash_"])
        met = met.join(twice, same(twice), "left_anti").union(several)
    return clear.select(docs.columns).union(met.select(docs.columns))
