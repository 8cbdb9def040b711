"""Documents to training data: the stages of a corpus, one operator each.

A stage deletes the tables that the one before it made on its way, once its result is
written: they would only fill the disk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spark_climbs.llm import mixing, pieces, quality_rules, simhash, suffix_dedup, tokenizers_at
from spark_climbs.materialize import made_here, materialize

#: What deletes the intermediate tables of the stage that ran last.
_LAST: list[Callable[[list[str]], None]] = []


def _staged(stage: Callable) -> Callable:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        while _LAST:
            _LAST.pop()(read)
        with made_here() as delete:
            out = stage(spark, docs, sf_dir)
        _LAST.append(delete)
        return out

    run.__doc__ = stage.__doc__
    return run


@_staged
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.accepted(docs)


@_staged
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.first_of_each(docs)


@_staged
def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages (some 40 words or more) that start anywhere else too."""
    return suffix_dedup.cut(docs, suffix_dedup.PASSAGE)


@_staged
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order, a row for every time a document is taken."""
    return mixing.mix(docs)


@_staged
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as piece ids, and as they decode."""
    return pieces.encode(docs, tokenizers_at.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", rules),
    ("simhash", near_copies),
    ("suffix_dedup", unrepeated),
    ("mixing", mixed),
    ("pieces", encoded),
]

#: The fingerprint stage hashes with XXH64 and follows links to any depth: not SQL's work.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
