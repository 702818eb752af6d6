"""From raw documents to token ids, in stages that are written and read again.

Each stage works on all rows its predecessor kept; all but the last return the columns of
documents. Decisions: rejected documents go; of near duplicates one stays; personal data is
replaced in the text; documents of small sources are repeated to meet the mix, none is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import mixing, neardup, pieces, pii, quality
from tidelog.llm.common import land, table
from tidelog.session import configure

# no stage but the mixing could be put in SQL; the tests hold run() against a brute-force version
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    known = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id"))).select("doc_id", "quality")
    model = quality.fit(docs, known)
    return docs.where(quality.score(F.col("text"), model) >= quality.THRESHOLD)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return neardup.one_of_each(docs)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    # written in the order of the stream, so that a reader of the files meets the sources at their weights
    return mixing.mix(docs).orderBy("position", "doc_id").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    coded = pieces.encode(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", good_quality),
    ("near duplicates", no_near_duplicates),
    ("personal data", no_personal_data),
    ("source mixing", mixed_sources),
    ("token ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
