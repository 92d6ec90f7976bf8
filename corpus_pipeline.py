"""A training corpus from raw documents: language, near-duplicates, repeats, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read as the next stage's documents; all but the last return the columns of ``documents``.

1. language_id: documents in no learned language go (no letter, no known n-gram, or a score
   below the limit that the labelled documents set, see language.limits); a missing ``lang`` is
   filled in, one that the text clearly contradicts is replaced.  Nothing else is dropped.
2. near_dedup: of each group of documents whose five-word shingles have a similarity of 0.8 or
   more (and what these links connect), the one of the smallest doc_id stays.
3. substring_dedup: runs of 20 words and more that also start earlier are cut out; n_chars
   follows; a document that loses all its words stays, empty.
4. packing: sequences of at most 1024 tokens; one row per piece.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefspark.llm import language, packing, simhash, substrings
from briefspark.llm.common import shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    profiles = language.learned_from(docs)
    return language.identify(docs, profiles, language.limits(docs, profiles))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    stays = simhash.near_duplicates(docs).filter("stays").select("uid").distinct()
    # rows that repeat both doc_id and text share a uid; the join has dealt out by it already
    copy = F.row_number().over(Window.partitionBy("uid").orderBy("doc_id"))
    found = simhash.with_uid(docs).join(stays, "uid", "left_semi").withColumn("copy", copy)
    return found.filter("copy = 1").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(docs.select(*COLUMNS))
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return found.select("doc_id", F.col("kept").alias("text"), "row.lang", "row.source", size.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: No SQL for the stages: models, fingerprints and tokens.  tests/llm checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between two stages is a table in the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        if n:
            path = f"{folder}/{STAGES[n - 1][0]}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        docs = stage(spark, docs, sf_dir)
    return docs
