"""From a raw corpus to packed training sequences: five stages, each on all that its predecessor kept.

Every stage's result is written as Parquet to the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomlog.llm import mixing, packing, passages, quality, simhash
from loomlog.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither scorer rejects."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.survivors(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    return passages.without_passages(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.apply(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), separator=0, capacity=2048)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", filter_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_passages),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Hashes, alignments and a trained model are not to be had in SQL: the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, from the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
