"""The operators of this package over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spark_climbs.llm import bpe_lexicon, crf_quality, html_text, interpolated_lm, merkle_manifest, mixing, multi_index, pieces, quality_rules, simhash, suffix_dedup, token_alignment, token_output, tokenizers_at


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark, sf_dir):
    return mixing.shares(_table(spark, sf_dir, "documents"))


def op3_pieces(spark, sf_dir):
    return pieces.digests(_table(spark, sf_dir, "documents"), tokenizers_at.path("piece_bpe_32k.model"))


def op4_crf_quality(spark, sf_dir):
    return crf_quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality_rules(spark, sf_dir):
    return quality_rules.verdicts(_table(spark, sf_dir, "documents"))


def op6_interpolated_lm(spark, sf_dir):
    return interpolated_lm.score(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.spans(_table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_html_text(spark, sf_dir):
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_multi_index(spark, sf_dir):
    return multi_index.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_token_output(spark, sf_dir):
    return token_output.round_trip(_table(spark, sf_dir, "documents"), tokenizers_at.path("word_bpe_49k.json"))


def op11_token_alignment(spark, sf_dir):
    return token_alignment.digests(_table(spark, sf_dir, "documents"), tokenizers_at.path("byte_bpe_50k.json"), tokenizers_at.path("piece_bpe_32k.model"))


def op12_merkle_manifest(spark, sf_dir):
    return merkle_manifest.tampering(_table(spark, sf_dir, "documents"))


def op13_bpe_lexicon(spark, sf_dir):
    return bpe_lexicon.digests(_table(spark, sf_dir, "documents"), tokenizers_at.path("byte_bpe_50k.json"))


def all_queries():
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}
