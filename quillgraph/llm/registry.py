"""The queries ``opN_<name>`` over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bitpack, bytebpe, common, forest, gam, linededup, packing, quality, secret_scan, simhash, substring


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return common.prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A public tokenizer's file. Its package is there on every machine, as pyspark is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(_table(spark, sf_dir, "embeddings"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_table(spark, sf_dir, "documents"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytebpe.encode(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.read_ids(spark, bitpack.write_ids(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op10_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_simhash, op2_secrets, op3_neighbours, op4_lines, op5_substrings, op6_packing, op7_byte_bpe, op8_quality_rules, op9_token_files, op10_classifier)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op4_lines": linededup.ORACLE_SQL, "op5_substrings": substring.ORACLE_SQL, "op8_quality_rules": quality.ORACLE_SQL}
