"""Structure of token sequences, computed inside the row that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Token ids of the prompt format (fixed values).
TURN_PREFIX = 248045
END_OF_TURN = 248046
THINK = 248068
TOOL_CALL = 248058


def _starts(ids: Column) -> Column:
    """Positions of turn prefixes that have a successor."""
    marked = F.transform(ids, lambda token, at: F.when((token == TURN_PREFIX) & (at < F.size(ids) - 1), at))
    return F.filter(marked, lambda p: p.isNotNull())


def token_sections(tokens: DataFrame) -> DataFrame:
    """One row per section start (position, distance to the previous start, label
    token), and a tail row (label NULL) for what follows the last one."""
    ids = F.col("token_ids")
    listed = tokens.select("seq_id", "token_ids", F.explode(F.array(_starts(ids))).alias("_starts"))

    def section(start: Column, at: Column) -> Column:
        before = F.when(at > 0, F.get(F.col("_starts"), at - 1)).otherwise(0)
        return _section(start, start - before, F.get(ids, start + 1))

    size = F.size(ids)
    last = F.coalesce(F.try_element_at("_starts", F.lit(-1)), F.lit(0))
    rows = F.concat(
        F.transform("_starts", section), F.array(_section(size, size - last, F.lit(None)))
    )
    return listed.select("seq_id", F.posexplode(rows).alias("section", "s")).select(
        "seq_id", F.col("section").cast("bigint").alias("section"), "s.position", "s.delta", "s.label_token"
    )


def _section(position: Column, delta: Column, label: Column) -> Column:
    return F.struct(
        position.cast("bigint").alias("position"), delta.cast("bigint").alias("delta"),
        label.cast("bigint").alias("label_token"),
    )


def token_counts(tokens: DataFrame) -> DataFrame:
    def count(token_id: int) -> Column:
        return F.size(F.filter("token_ids", lambda t: t == token_id)).cast("bigint")

    return tokens.select(
        "seq_id", F.size("token_ids").cast("bigint").alias("num_tokens"),
        count(END_OF_TURN).alias("end_of_turn"), count(THINK).alias("think"), count(TOOL_CALL).alias("tool_call"),
    )


def token_output(tokens: DataFrame) -> DataFrame:
    """The written form: {token_ids, num_tokens, model}."""
    return tokens.select(
        "seq_id",
        F.to_json(F.struct("token_ids", F.size("token_ids").alias("num_tokens"), "model")).alias("line"),
    )
