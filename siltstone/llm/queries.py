"""What ``__spark_entry__`` registers of this subpackage: one query an operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import oracle
from siltstone.llm.batches import read


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.secrets import find_secrets

    return find_secrets(read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.lines import dedup_lines

    return dedup_lines(read(spark, sf_dir, "documents"), least_words=1)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.bpe import round_trip

    return round_trip(read(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.sharding import shard_documents

    return shard_documents(read(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.ngram_join import similarity_join

    return similarity_join(read(spark, sf_dir, "documents")).drop("node", "root")


def op6_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.crf_quality import quality_scores

    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.quotes import reply_ordered

    return reply_ordered(read(spark, sf_dir, "conversations"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.rules import quality_rules

    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("quality = 1"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.decontaminate import contamination

    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_line_dedup, op3_byte_bpe, op4_sharding, op5_ngram_join, op6_crf_quality, op7_quote_links, op8_quality_rules, op9_decontaminate, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
