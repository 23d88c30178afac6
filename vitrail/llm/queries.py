"""Registered queries of the training-data operators, and their SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vitrail.llm import bpe, dedup, gam, license, packing, rules, shard, simhash, tokens, warc
from vitrail.llm.common import load


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(load(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign(load(spark, sf_dir, "documents"), 24)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.report(load(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token across a line end counts to the line it starts in."""
    return tokens.by_line(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), None, "start")


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archive(load(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(load(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.decisions(load(spark, sf_dir, "documents"))


def op9_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels").where("quality = 1"))


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_minimax_shards": op2_minimax_shards,
    "op3_license_scan": op3_license_scan,
    "op4_token_counts": op4_token_counts,
    "op5_quality_gam": op5_quality_gam,
    "op6_warc_index": op6_warc_index,
    "op7_simhash": op7_simhash,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_ngram_ratio": op9_ngram_ratio,
    "op10_pattern_packing": op10_pattern_packing,
}

#: DuckDB SQL of the queries that SQL can state; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": license.ORACLE,
    "op8_exact_dedup": dedup.ORACLE,
}
