"""From raw documents to packed sequences: five stages, each one of the operators in vitrail.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return documents in
their own columns, whatever extra columns there are and whatever they are called.

Defined results: a null or empty text has too few words for the base rules and goes there. Repeated rows are copies, of which one stays.
An empty table gives no rows. Each stage's own cases are stated in its operator's module.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vitrail.llm import dedup, gam, overlap, packing, rules
from vitrail.llm.common import load, materialize
from vitrail.session import interim, remove, shared_path

#: Of the run's rows no stage with a learnt model, XXH64 or a tokenizer can be stated in SQL.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model predicts to be good."""
    return gam.keep_good(docs, load(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram ratio against the documents labelled good."""
    return rules.keep_clean(docs, load(spark, sf_dir, "labels").where("quality = 1"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: SimHash fingerprints of five-word shingles, Jaccard 0.8 or more."""
    return overlap.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; what a stage returns is written before the next one reads it, and its own
    intermediate tables are removed then."""
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        with interim(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
