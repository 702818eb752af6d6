"""The operators over the given tables, one query each."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, work_dir
from . import eulertour, infill, lengths, merkle, mixing, neardup, packing, pieces, pii, quality, topk, urls, warc
from .common import land, table, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(configure(spark), sf_dir)

    QUERIES[build.__name__] = run
    return run


RULES = (
    urls.Rule("net", "/", False), urls.Rule("example.net", "/en/", True),
    urls.Rule("example.com", "/de/", False), urls.Rule("org", "/fr/", True),
)
# hosts that hold one of these count as rejected examples, whatever the rules say
REJECTED_WORDS = ("casino", "bets", "pills", "viagra", "poker", "lottery", "payday")


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = urls.fit(urls.labels_from(pages, RULES, REJECTED_WORDS))
    return urls.judge(pages, model, RULES).select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "warc")
    warc.write(warc.crawl_records(table(spark, sf_dir, "pages")), path)
    page = lambda name: F.expr(f"try_cast(substring({name}, 10) AS bigint)")  # noqa: E731  behind urn:page:
    stored = F.col("record_type") == "response"
    return warc.read(spark, path).select(
        page("record_id").alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(stored, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


@query
def op3_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(lengths.length_histogram(table(spark, sf_dir, "documents")))


@query
def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    # the mark travels with the text, so that no tree of a next text is built again
    rows = merkle.with_next(docs, {"mark": lambda text: merkle.mark(merkle.tree(text))})
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint"))
    moved = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - moved), F.substring("next_text", F.lit(1), moved))
    rows = rows.withColumn("edited", edited).withColumns({"outline": merkle.outline(F.col("text")), "edited_tree": merkle.tree(F.col("edited"))})
    rows = rows.withColumn("edited_mark", merkle.mark(F.col("edited_tree")))
    mark, edited_mark = F.col("mark"), F.col("edited_mark")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        merkle.shown(mark).alias("fingerprint"), merkle.shown(edited_mark).alias("edited_fingerprint"),
        merkle.alike(mark, edited_mark).alias("near_edited"), merkle.alike(mark, F.col("next_mark")).alias("near_next"),
        merkle.first_edit(F.col("outline"), F.col("edited_tree")).alias("first_edit"),
    )


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(kind) for kind in pii.KINDS], F.sha2(pii.listed(F.col("spans")), 256).alias("base_sha256"),
        pii.listed(F.concat("spans", pii.as_spans(F.col("terms")))).alias("spans"),
    )


# tokens of the mix for a token of the corpus: as many passes as the limit of repetition, so every source gets one at least
MIX_PASSES = mixing.REPEAT_LIMIT


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", lengths.encoded_length(F.col("text")).alias("tokens"), F.md5(text_of()).alias("digest")
    )
    docs = land(docs, "mix-docs")  # encoded once; no text is needed from here on
    budget = math.ceil(MIX_PASSES * (docs.agg(F.sum("tokens")).first()[0] or 0))
    return mixing.mix(docs, F.col("tokens"), budget=budget, text="digest").select("doc_id", "source", "tokens", *mixing.PLAN)


@query
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


@query
def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.decode(pieces.encode(docs))
    return coded.select(
        "doc_id", F.size("ids").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "component")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = quality.held_out(F.col("doc_id"))
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held).select("doc_id", "quality"))
    return docs.select("doc_id", held.alias("held_out"), quality.score(F.col("text"), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= quality.THRESHOLD).cast("int")
    )


# a conversation begins like the one of the next lower multiple of five, for up to eight turns
SHARED_MOST = 8


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = eulertour.turns_in_order(table(spark, sf_dir, "conversations"))
    conv = F.col("conv_id")
    shared = F.crc32(conv.cast("string")) % (SHARED_MOST + 1)
    return eulertour.prefix_trie(eulertour.branch(turns, conv - conv % 5, shared, SHARED_MOST))


@query
def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    rows = infill.transform(docs, "doc_id")
    restored = infill.restore(F.col("output"), F.col("form"))
    return rows.select(
        "doc_id", "n", "form", F.col("low").alias("prefix_chars"), (F.col("high") - F.col("low")).alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"),
    )


@query
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces_of = packing.cut(table(spark, sf_dir, "documents"), ["doc_id"], with_ids=False)
    return packing.place(pieces_of).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


# the highest scores by plain sorting of all pairs of a query and another row
ORACLES["op7_top_k"] = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

# nodes by the texts of whole prefixes, subtrees by a join of every node with the nodes above it
ORACLES["op11_prefix_trie"] = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT conv_id FROM t
), crc AS (  -- CRC-32 of the decimal id, bit by bit
  WITH RECURSIVE r(conv_id, i, v) AS (
    SELECT conv_id, 0, CAST(4294967295 AS BIGINT) FROM ids
    UNION ALL
    SELECT conv_id, i + 1, CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM (
      SELECT conv_id, i, CASE WHEN i % 8 = 0 THEN xor(v, ascii(substring(CAST(conv_id AS VARCHAR), i // 8 + 1, 1))) ELSE v END AS x,
             8 * length(CAST(conv_id AS VARCHAR)) AS bits FROM r) WHERE i < bits
  ) SELECT conv_id, CAST(xor(v, 4294967295) % 9 AS BIGINT) AS h FROM r WHERE i = 8 * length(CAST(conv_id AS VARCHAR))
), given AS (
  SELECT c.conv_id, t.pos, t.role, t.text FROM crc c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos <= c.h
), n_given AS (
  SELECT conv_id, count(*) AS m FROM given GROUP BY 1
), built AS (
  SELECT conv_id, pos AS depth, role, text FROM given
  UNION ALL
  SELECT t.conv_id, t.pos - c.h + coalesce(g.m, 0), role, text
  FROM t JOIN crc c USING (conv_id) LEFT JOIN n_given g USING (conv_id) WHERE t.pos > c.h
), chained AS (
  SELECT conv_id, depth, strlen(text) AS bytes,
         string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path
  FROM built
), member AS (
  SELECT conv_id, depth, bytes, path FROM chained UNION ALL SELECT conv_id, 0, 0, '' FROM ids
), longest AS (
  SELECT conv_id, max(depth) AS n FROM member GROUP BY 1
), node AS (
  SELECT m.depth, m.path, min(m.conv_id) AS conv_id, count(*) AS n_convs, max(m.bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (l.n = m.depth), '')) AS ends_sha256
  FROM member m JOIN longest l USING (conv_id) GROUP BY 1, 2
), above AS (  -- the nodes on the way to each node, itself included
  SELECT n.conv_id, n.depth, a.conv_id AS top_conv, a.depth AS top_depth
  FROM node n JOIN member m ON m.conv_id = n.conv_id AND m.depth <= n.depth JOIN node a ON a.depth = m.depth AND a.path = m.path
), kids AS (
  SELECT top_conv AS conv_id, top_depth AS depth, count(*) AS n_children FROM above WHERE depth = top_depth + 1 GROUP BY 1, 2
), subtree AS (
  SELECT u.top_conv AS conv_id, u.top_depth AS depth, count(*) FILTER (k.n_children IS NULL) AS n_leaves,
         CAST(sum((n.n_convs - 1) * n.bytes) AS BIGINT) AS saved_tokens
  FROM above u JOIN node n USING (conv_id, depth) LEFT JOIN kids k USING (conv_id, depth) GROUP BY 1, 2
)
SELECT n.conv_id, n.depth, p.top_conv AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
       s.n_leaves, s.saved_tokens, n.ends_sha256
FROM node n JOIN subtree s USING (conv_id, depth) LEFT JOIN kids k USING (conv_id, depth)
LEFT JOIN above p ON p.conv_id = n.conv_id AND p.depth = n.depth AND p.top_depth = n.depth - 1
"""

ORACLES["op12_infill"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), h AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
         CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || t[:lo] || '<S>' || substring(t, hi + 1) || '<M>' || substring(t, lo + 1, hi - lo)
    ELSE '<S>' || substring(t, hi + 1) || '<P>' || t[:lo] || '<M>' || substring(t, lo + 1, hi - lo) END AS output FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
