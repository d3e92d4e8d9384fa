"""A corpus pipeline over `documents`: quality rules, near duplicates, secrets, mixing, tokens.

Each stage takes the documents that its predecessor kept, and is written to the shared folder and read again. All stages read the columns of `documents` by name: extra columns go no
further. An empty table stays empty through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whence.llm import bpe, mixing, ngram_join, quality, secrets
from whence.llm.common import keep, small_or_not, table

#: Narrow rows (an id, a hash and a number) up to which they are broadcast.
MOST_BROADCAST = 500_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass; lines above their host's limit are removed from them.

    A null or empty text has too few words and goes; a null source is a host of its own; null ids and rows that repeat an id are judged by their own text.
    """
    return quality.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of similar ones (five words, 0.8).

    A null or empty text, and a null id, are similar to nothing and stay; of rows equal in all columns one stays.
    """
    return ngram_join.distinct_documents(docs, n=5, num=80, den=100)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by markers; a null text stays null, and every row stays, repeated ones too."""
    return secrets.redacted(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null or empty text has no words and is taken 0 times; a null source is a source of its own; a null id is an id like another; of rows that repeat an id and a text all are taken as
    often as the one that is taken most.
    """
    names = ("text", "lang", "source", "n_chars")
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    # Decided on narrow rows and joined back; rows that repeat an id and a text are taken alike.
    taken = mixing.mix(docs.withColumn("key_", mark), extra=("key_",), named=False).filter("passes > 0").groupBy("doc_id", "key_").agg(F.max("passes").alias("passes"))
    taken = keep(taken.withColumnRenamed("doc_id", "id_"), "taken")
    joined = docs.withColumn("mark_", mark).join(small_or_not(taken, taken.count(), MOST_BROADCAST), F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("mark_") == F.col("key_")))
    return joined.withColumn("pass_", F.explode(F.sequence(F.lit(1), F.col("passes")))).select("doc_id", *names)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and their number; a null text has none."""
    ids = bpe.encode_documents(docs)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing", mixing_weights),
    ("bpe_tokens", tokens),
]

#: Merging by rank and an R-tree join have no form in SQL: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs, name)
    return docs
