"""Temperature mixing of sources, realised as budgeted permutations of blocks.

Weights are token shares raised to an exponent and normalised: 1 keeps the corpus as it is, 0
gives every source the same. The exponent is found by bisection so that the weights reach a
target entropy, or that no source is repeated more often than another by more than a limit.
The power sums come from one aggregate over the table of sources a step, so any number of
sources works.

Realising: every source is a stream of passes over its documents. A pass is a permutation of
the source's blocks (documents dealt by hash, about ``block_tokens`` each). A source whose
budget is 2.4 times its tokens gets two whole passes and blocks of a third one until 0.4 are
filled; the last block is filled in the order of a hash. ``position`` in [0, 1) is a block's
place in its source's stream: sorted by it, the sources arrive at their weights throughout.
Without a budget the smallest one is taken that gives every source at least one whole pass, so
no document is lost. A smaller budget stops streams early; that is the operator's decision.

Defined cases: NULL sources are one source; NULL and empty texts have no tokens and go with
their block; a source without tokens gets one pass; documents of equal id and text share a
place, all or none; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import land, running_before, unit

BLOCK_TOKENS = 1 << 18
REPEAT_LIMIT = 1.5
STEPS = 40
PLAN = ("pass", "block", "position")


# scripts that put no spaces between words: a character counts as a word
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
# a run without spaces counts once for so many characters
LONGEST_WORD = 16
WORD = rf"[{UNSPACED}]|[^\s\p{{Z}}{UNSPACED}]{{1,{LONGEST_WORD}}}"


def words(text: Column) -> Column:
    """Number of words: runs between white space of any kind, long ones in parts, unspaced scripts by character."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def _rows(docs: DataFrame, tokens: Column, source: str, doc_id: str, text: str, seed: int) -> DataFrame:
    """(_src, _t, _place) of every document, landed, so that tokens are counted once."""
    place = _place(doc_id, text, seed)
    return land(docs.select(_source_key(source).alias("_src"), F.coalesce(tokens, F.lit(0)).cast("bigint").alias("_t"), place.alias("_place")), "mix-rows")


def _place(doc_id: str, text: str, seed: int) -> Column:
    return unit(F.lit(seed), F.col(doc_id), F.coalesce(F.col(text), F.lit("")))


def source_tokens(docs: DataFrame, tokens: Column, source: str = "source") -> DataFrame:
    """(src, tokens, docs): totals by source; summed before the shuffle, so a hot source is no load."""
    return _totals(docs.select(_source_key(source).alias("_src"), F.coalesce(tokens, F.lit(0)).alias("_t")))


def _totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("_src").alias("src")).agg(F.sum("_t").cast("bigint").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def _entropy(sources: DataFrame, exponent: float) -> float:
    """In bits, of the shares raised to the exponent."""
    power = F.pow(F.col("tokens").cast("double") / F.col("most"), F.lit(exponent))
    row = sources.agg(F.sum(power).alias("z"), F.sum(power * exponent * F.log2(F.col("tokens") / F.col("most"))).alias("s")).first()
    return math.log2(row["z"]) - row["s"] / row["z"]


def find_exponent(sources: DataFrame, entropy: float | None = None, repeat_limit: float | None = None, steps: int = STEPS) -> float:
    """The exponent in [0, 1] that meets the target, by bisection.

    ``entropy``: the exponent whose weights have it; out of reach, the nearer end.
    ``repeat_limit``: the smallest exponent (the flattest mix) whose most repeated source has at
    most so many times the passes of the least repeated one.
    """
    facts = sources.where("tokens > 0").agg(F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    if facts["least"] is None or facts["least"] == facts["most"]:
        return 1.0
    if entropy is not None:
        table = sources.where("tokens > 0").withColumn("most", F.lit(float(facts["most"])))
        flatter = lambda x: _entropy(table, x) >= entropy
    else:
        ratio = facts["most"] / facts["least"]
        flatter = lambda x: ratio ** (1 - x) > (repeat_limit or REPEAT_LIMIT)
    if not flatter(0.0):
        return 0.0
    if flatter(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps if entropy is None else min(steps, 20)):
        middle = (low + high) / 2
        low, high = (middle, high) if flatter(middle) else (low, middle)
    return high


def weights(sources: DataFrame, exponent: float, budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Add weight, quota (tokens of the source in the mix), passes (whole ones) and blocks."""
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(exponent))).otherwise(F.lit(0.0))
    # a source's passes are quota / tokens; without a budget the least repeated source has one
    sums = sources.agg(F.sum(power).alias("z"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / power)).alias("unit")).first()
    z = sums["z"] or 1.0
    scale = (budget / z) if budget is not None else (sums["unit"] or 1.0)
    # rounded up, and never below one pass by a rounding error
    quota = F.ceil(power * scale - F.lit(1e-6)).cast("bigint")
    quota = quota if budget is not None else F.greatest(quota, F.col("tokens"))
    return sources.withColumns({
        "weight": power / z, "quota": quota, "blocks": F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)).cast("bigint"),
    }).withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1)).cast("bigint"))


def realise(docs: DataFrame, mix: DataFrame, tokens: Column, source: str = "source", doc_id: str = "doc_id", text: str = "text",
            seed: int = 0, rows: DataFrame | None = None) -> DataFrame:
    """The documents of the mix, once for each pass that takes them, with pass, block and position."""
    mix = land(mix, "mix")
    rows = _rows(docs, tokens, source, doc_id, text, seed) if rows is None else rows
    blocks = mix.select(F.col("src").alias("_src"), F.col("blocks").alias("_blocks"))
    narrow = rows.join(blocks, "_src")
    block = F.floor(F.col("_place") * F.col("_blocks")).cast("bigint")
    totals = land(
        narrow.groupBy("_src", block.alias("_block")).agg(F.sum("_t").alias("_tokens")), "mix-blocks"
    )
    # every pass is a permutation of the blocks of its own; the last one may be cut
    streams = totals.join(mix.select(F.col("src").alias("_src"), "tokens", "quota", "passes"), "_src").withColumn(
        "pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes")))
    )
    streams = streams.withColumn("_turn", unit(F.lit(seed), F.lit("turn"), F.col("_src"), F.col("pass"), F.col("_block")))
    streams = running_before(streams, ["_src", "pass"], "_turn", "_tokens", "_ahead")
    rest = F.col("quota") - F.col("pass") * F.col("tokens") - F.col("_ahead")
    streams = streams.withColumn("_room", F.when(F.col("pass") < F.col("passes"), F.col("_tokens")).otherwise(rest)).where(
        (F.col("pass") < F.col("passes")) | (F.col("_room") > 0)
    )
    streams = streams.select(
        "_src", "_block", "pass", "_tokens", "_room",
        (F.col("pass") * F.col("tokens") + F.col("_ahead")).alias("_start"), F.greatest("quota", F.lit(1)).alias("_quota"),
    )
    streams = land(streams, "mix-streams")
    # blocks that are cut, at most one of a source: their documents in the order of a hash, while they fit
    cut = streams.where("_room < _tokens").select("_src", "_block", "_room")
    docs_of_cut = narrow.select("_src", block.alias("_block"), "_t", "_place").join(cut, ["_src", "_block"])
    by_place = docs_of_cut.groupBy("_src", "_block", "_room", "_place").agg(F.sum("_t").alias("_t"))
    filled = F.sum("_t").over(Window.partitionBy("_src", "_block").orderBy("_place"))
    last = by_place.withColumn("_filled", filled).where("_filled <= _room").groupBy("_src", "_block").agg(F.max("_place").alias("_last"))
    plan = streams.join(last, ["_src", "_block"], "left").select(
        "_src", "_block", "pass", (F.col("_start") / F.col("_quota")).alias("position"),
        F.when(F.col("_room") >= F.col("_tokens"), F.lit(2.0)).otherwise(F.coalesce("_last", F.lit(-1.0))).alias("_upto"),
    )
    plan = land(plan, "mix-plan")
    # columns of the documents named like those of the plan are replaced
    dealt = docs.drop(*PLAN).withColumns({"_src": _source_key(source), "_place": _place(doc_id, text, seed)})
    taken = dealt.join(blocks, "_src").withColumn("_block", block).join(plan, ["_src", "_block"]).where(F.col("_place") <= F.col("_upto"))
    return taken.withColumnRenamed("_block", "block").select(*[c for c in docs.columns if c not in PLAN], *PLAN)


def mix(docs: DataFrame, tokens: Column | None = None, entropy: float | None = None, repeat_limit: float | None = REPEAT_LIMIT,
        budget: int | None = None, source: str = "source", doc_id: str = "doc_id", text: str = "text", seed: int = 0,
        block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Weights by temperature, then their realisation."""
    tokens = words(F.col(text)) if tokens is None else tokens
    rows = _rows(docs, tokens, source, doc_id, text, seed)
    sources = land(_totals(rows), "mix-sources")
    exponent = find_exponent(sources, entropy, repeat_limit)
    return realise(docs, weights(sources, exponent, budget, block_tokens), tokens, source, doc_id, text, seed, rows)
