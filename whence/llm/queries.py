"""The ten corpus operators as registered queries: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, html, language, mixing, ngram_join, quality, secrets, sharding, winnowing
from .common import table
from .oracles import ORACLES

SHARDS = 24


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.hilbert_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.winnowed_pairs(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), extra=("source",), named=False).select("doc_id", "size", "source_size", "target", "taken", "source", "passes")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_digests(chat.planted(table(spark, sf_dir, "conversations")))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secret_scan, op2_ngram_join, op3_hilbert_shards, op4_winnowing, op5_quality_rules, op6_bpe, op7_mixing, op8_chat_format, op9_html_text, op10_language_id, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query. The others are tested against brute force, round trips or held-out accuracy."""
    return dict(ORACLES)
