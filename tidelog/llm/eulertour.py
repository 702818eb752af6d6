"""Conversation prefix trie, totals over its subtrees by an Euler tour.

A node is a distinct sequence of the first d turns. Each node gives the tour two arcs, enter and exit;
each arc knows the next one. Ranking that linked list puts the arcs in order, and what holds for a
subtree is a difference of prefix sums at its node's two arcs: no walk, no recursion by depth.

The list is ranked by pointer jumping to rulers: one arc in ``SPARSE`` is a ruler, the others jump in
doubling steps until they meet one (their number shrinks from step to step), and the rulers alone are
a list of the same kind, ranked likewise until at most ``FEW`` are left, which fit anywhere.

Conversations of any length: places in a conversation come from one range sort of narrow rows, and a
prefix is known by its depth and two sums over its turns of 64-bit hashes of (place, digest of the
turn), the digest being 128 bits of SHA-256. Sums of that kind are prefix sums too, taken in slices.

NULL roles and texts count as empty. Turns are in order of ``turn``, NULL first; equal ones in the order
of their digests. Rows without a conversation id belong to none and take no part. Repeated rows are
turns of their own. An empty table has no trie. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import land

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE = 4096
SPARSE = 64
FEW = 4096
SUM = "decimal(38,0)"
NODE = ["depth", "a", "b"]


def _sorted(df: DataFrame, purpose: str, *order: Column) -> DataFrame:
    """``df`` with ``_rank``, from 0, in the given order over the whole table; landed.

    Ranges are sorted each on its own; a row's rank is its place in the range behind the rows of the
    ranges before. Windows hold one row a range.
    """
    here = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = land(rows.withColumns({"_range": F.shiftright(here, 33), "_at": here.bitwiseAND((1 << 33) - 1)}), purpose)
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(counts, "_range").withColumn("_rank", F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def _running(df: DataFrame, within: list[str], place: str, values: list[str], slice_rows: int = SLICE) -> DataFrame:
    """Replace each value by its sum up to this row; ``place`` counts the rows of a group. Two levels of sums."""
    rows = df.withColumn("_slice", F.floor(F.col(place) / F.lit(slice_rows)).cast("bigint"))
    ahead = Window.partitionBy(*within).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*within, "_slice").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    totals = totals.select(*within, "_slice", *[F.coalesce(F.sum(f"_{v}").over(ahead), F.lit(0)).alias(f"_{v}") for v in values])
    inside = Window.partitionBy(*within, "_slice").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({v: F.sum(v).over(inside) for v in values}).join(totals, [*within, "_slice"])
    return rows.withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).drop("_slice", *[f"_{v}" for v in values])


# ------------------------------------------------------------------ turns

def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, n_bytes) of every turn; pos from 1."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"), digest.alias("digest"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
    )
    ranked = _sorted(rows, "turns", F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("digest"))
    first = ranked.groupBy("conv_id").agg(F.min("_rank").alias("_first"))
    # Spark splits a hot conversation: both sides are exchanged for the join
    first = first.withColumn("conv_id", F.col("conv_id").bitwiseXOR(F.lit(0).cast("bigint")))
    return ranked.join(first, "conv_id").select("conv_id", (F.col("_rank") - F.col("_first") + 1).alias("pos"), "digest", "n_bytes")


class Rebuilt(NamedTuple):
    """turns: (conv_id, depth, digest, n_bytes); conversations: (conv_id, n_turns), turnless ones too."""

    turns: DataFrame
    conversations: DataFrame


def branch(turns: DataFrame, source: Column, shared: Column, most: int) -> Rebuilt:
    """Conversations that begin like another: the first ``shared`` (at most ``most``) turns of conversation
    ``source``, all of them if it has fewer, then their own turns behind the first ``shared``. Both are
    expressions over conv_id."""
    heads = turns.groupBy("conv_id").agg(
        F.max("pos").alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("pos") <= most, F.struct("pos", "digest", "n_bytes")))).alias("head"),
    )
    heads = land(heads, "heads")
    known = heads.select(F.col("conv_id").alias("_source"), F.col("head").alias("_head"))
    convs = heads.select("conv_id", "n", source.alias("_source"), shared.cast("bigint").alias("_shared")).join(known, "_source", "left")
    given = F.coalesce(F.slice("_head", F.lit(1), F.col("_shared").cast("int")), F.array().cast(heads.schema["head"].dataType))
    convs = convs.withColumn("_given", given).withColumn("_n_given", F.size("_given").cast("bigint"))
    own = F.greatest(F.col("n") - F.col("_shared"), F.lit(0))
    convs = land(convs.select("conv_id", "_shared", "_given", "_n_given", (F.col("_n_given") + own).alias("n_turns")), "branches")
    begin = convs.select("conv_id", F.explode("_given").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.digest", "t.n_bytes")
    rest = turns.join(convs.select("conv_id", "_shared", "_n_given"), "conv_id").where(F.col("pos") > F.col("_shared")).select(
        "conv_id", (F.col("pos") - F.col("_shared") + F.col("_n_given")).alias("depth"), "digest", "n_bytes"
    )
    return Rebuilt(begin.union(rest), convs.select("conv_id", "n_turns"))


# ------------------------------------------------------------------ trie

def prefixes(rebuilt: Rebuilt) -> DataFrame:
    """(conv_id, depth, a, b, up_a, up_b, n_bytes, last): the node of every prefix and its parent; landed."""
    hashed = [F.xxhash64(F.lit(salt), "depth", "digest").cast(SUM) for salt in (1, 2)]
    rows = rebuilt.turns.select("conv_id", "depth", "n_bytes", hashed[0].alias("a"), hashed[1].alias("b"), hashed[0].alias("own_a"), hashed[1].alias("own_b"))
    summed = _running(rows, ["conv_id"], "depth", ["a", "b"]).join(rebuilt.conversations, "conv_id")
    cast = lambda value: value.cast(SUM)
    return land(
        summed.select(
            "conv_id", "depth", cast(F.col("a")).alias("a"), cast(F.col("b")).alias("b"),
            cast(F.col("a") - F.col("own_a")).alias("up_a"), cast(F.col("b") - F.col("own_b")).alias("up_b"),
            "n_bytes", (F.col("depth") == F.col("n_turns")).alias("last"),
        ),
        "prefixes",
    )


def trie(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """(g, conv_id, depth, parent_conv_id, n_convs, n_bytes, a, b): the nodes, numbered from 0 at the root
    in the order of depth, parent and smallest member, so that siblings are neighbours; landed."""
    nodes = land(
        found.groupBy(*NODE).agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
            F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"),
        ),
        "nodes",
    )
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    nothing = F.lit(0).cast(SUM)
    root = root.select(
        F.lit(0).cast("bigint").alias("depth"), nothing.alias("a"), nothing.alias("b"), "conv_id", "n_convs", F.lit(0).cast("bigint").alias("n_bytes"),
    )
    # both sides are scans, so that Spark can split the children of a hot node
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    first = root.select("conv_id").scalar()
    below = nodes.where("depth > 1").join(up, ["depth", "up_a", "up_b"]).unionByName(nodes.where("depth = 1").withColumn("parent_conv_id", first))
    every = below.drop("up_a", "up_b").unionByName(root.withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    ranked = _sorted(every, "trie", F.asc("depth"), F.asc_nulls_first("parent_conv_id"), F.asc("conv_id"))
    return land(ranked.withColumnRenamed("_rank", "g"), "numbered")


def with_children(nodes: DataFrame) -> DataFrame:
    """Add n_children, first_child and last_child (numbers)."""
    kids = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"), F.min("g").alias("first_child"), F.max("g").alias("last_child")
    )
    return land(nodes.join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "children")


def euler_tour(nodes: DataFrame) -> DataFrame:
    """(arc, next): arc 2g enters node g, 2g + 1 leaves it; the last arc has no next."""
    enter, leave = F.col("g") * 2, F.col("g") * 2 + 1
    into = nodes.select(enter.alias("arc"), F.coalesce(F.col("first_child") * 2, leave).alias("next"))
    # a last child is followed by the exit of its parent, any other by its neighbour
    last = nodes.where("n_children > 0").select(F.col("last_child").alias("g"), leave.alias("_up"))
    out = nodes.join(last, "g", "left").select(
        leave.alias("arc"), F.when(F.col("depth") > 0, F.coalesce(F.col("_up"), (F.col("g") + 1) * 2)).alias("next")
    )
    return into.union(out)


# ------------------------------------------------------------------ list ranking

def list_rank(arcs: DataFrame, sparse: int = SPARSE, few: int = FEW) -> DataFrame:
    """(arc, to_end) of linked lists (arc, next) of unique arcs: the number of steps to the end of the list."""
    steps = F.col("next").isNotNull().cast("bigint")
    return _ranked(land(arcs.select("arc", "next", steps.alias("steps")), "arcs"), sparse, few, 0)


def _ranked(arcs: DataFrame, sparse: int, few: int, level: int) -> DataFrame:
    """``arcs``: (arc, next, steps): how many steps the next one is away, or the end where there is none."""
    spark, size = arcs.sparkSession, arcs.count()
    if size <= few:
        ahead = {r.arc: (r.next, r.steps) for r in arcs.collect()}
        ends = {after: arc for arc, (after, _) in ahead.items() if after is not None}
        rows = []
        for arc in (arc for arc, (after, _) in ahead.items() if after is None):
            total = 0
            while arc is not None:
                total += ahead[arc][1]
                rows.append((arc, total))
                arc = ends.get(arc)
        return spark.createDataFrame(rows, "arc BIGINT, to_end BIGINT")
    ruler = lambda name: F.pmod(F.xxhash64(F.lit(level), name), F.lit(sparse)) == 0
    met = F.col("next").isNull() | ruler("next")
    moving = arcs.withColumn("met", met)
    stopped, active = [moving.where("met")], moving.where("NOT met")
    while True:
        table = active
        for more in stopped:
            table = table.union(more)
        hop = table.select(F.col("arc").alias("next"), F.col("next").alias("_next"), F.col("steps").alias("_steps"), F.col("met").alias("_met"))
        jumped = active.select("arc", "next", "steps").join(hop, "next").select(
            "arc", F.col("_next").alias("next"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_met").alias("met")
        )
        jumped = land(jumped, "jumped")
        stopped.append(jumped.where("met"))
        active = jumped.where("NOT met")
        if active.isEmpty():
            break
    reached = stopped[0]
    for more in stopped[1:]:
        reached = reached.union(more)
    reached = land(reached.select("arc", "next", "steps"), "reached")
    rulers = _ranked(land(reached.where(ruler("arc")), "rulers"), sparse, few, level + 1)
    behind = rulers.select(F.col("arc").alias("next"), F.col("to_end").alias("_rest"))
    # an arc that met the end has no ruler ahead
    to_end = F.col("steps") + F.coalesce("_rest", F.lit(0))
    return land(reached.join(behind, "next", "left").select("arc", to_end.alias("to_end")), "ranked")


# ------------------------------------------------------------------ totals

def totals(nodes: DataFrame) -> DataFrame:
    """Add n_leaves and saved_tokens, over the subtree of every node with its children counted.

    saved_tokens: UTF-8 bytes that are stored once instead of once a member.
    """
    n_arcs = F.lit(2) * nodes.agg(F.count(F.lit(1))).scalar()
    ranks = list_rank(euler_tour(nodes))
    own = nodes.select(
        (F.col("g") * 2).alias("arc"), (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
    )
    places = ranks.join(own, "arc", "left").select(
        F.shiftright("arc", 1).alias("g"), F.col("arc").bitwiseAND(1).alias("exit"), (n_arcs - 1 - F.col("to_end")).alias("place"),
        F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
        F.coalesce("n_leaves", F.lit(0)).alias("own_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("own_saved"),
    )
    summed = _running(places.withColumn("_list", F.lit(0)), ["_list"], "place", ["n_leaves", "saved_tokens"])
    # the sum up to the exit less the sum before the entry
    signed = lambda name, own: F.sum(F.when(F.col("exit") == 1, F.col(name)).otherwise(F.col(own) - F.col(name))).cast("bigint")
    result = summed.groupBy("g").agg(signed("n_leaves", "own_leaves").alias("n_leaves"), signed("saved_tokens", "own_saved").alias("saved_tokens"))
    return nodes.join(result, "g")


def ends(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): digest of the ids of the conversations that end at a node, ascending and
    comma-joined. Ids are joined in runs first; the digest of a node reads its runs in order, in a stream."""
    nothing = F.lit(0).cast(SUM)
    rows = found.where("last").select(*NODE, "conv_id").union(
        conversations.where("n_turns = 0").select(F.lit(0).cast("bigint"), nothing, nothing, "conv_id")
    )
    run = F.floor(F.col("conv_id") / F.lit(SLICE)).cast("bigint")
    runs = rows.groupBy(*NODE, run.alias("run")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    runs = runs.select(*NODE, "run", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    dealt = runs.repartition(*NODE).sortWithinPartitions(*NODE, "run").select(F.struct(*NODE).alias("node"), "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            nodes, hashes = [], []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node == current:
                    state.update(b",")
                else:
                    if current is not None:
                        nodes.append(current)
                        hashes.append(state.hexdigest())
                    current, state = node, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, batch.column(0).type), pa.array(hashes, pa.string())], names=["node", "ends_sha256"])
            kind = batch.column(0).type
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    return dealt.mapInArrow(digest, f"node STRUCT<depth: BIGINT, a: {SUM}, b: {SUM}>, ends_sha256 STRING").select("node.*", "ends_sha256")


def prefix_trie(rebuilt: Rebuilt) -> DataFrame:
    """One row a node: conv_id (its smallest member) and depth, which name it; parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256."""
    found = prefixes(rebuilt)
    conversations = land(rebuilt.conversations, "conversations")
    nodes = totals(with_children(trie(found, conversations)))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(ends(found, conversations), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
