"""The registered queries of this folder: one per operator, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rxlake.llm import (dartminhash, fim, hardnegatives, huffman, kdtrees, langid, packing, pii, quality, quotes, toxicity, warc,
                         wumanber)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op2_ordered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(table(spark, sf_dir, "conversations"))


def op4_sharded_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.report(table(spark, sf_dir, "documents"))


def op6_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_clause_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wumanber.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_kd_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtrees.report(table(spark, sf_dir, "embeddings"))


def op12_slot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardnegatives.report(table(spark, sf_dir, "embeddings"))


def op13_block_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ecoc_language": op1_ecoc_language,
    "op2_ordered_packing": op2_ordered_packing,
    "op3_quote_threads": op3_quote_threads,
    "op4_sharded_warc": op4_sharded_warc,
    "op5_dart_minhash": op5_dart_minhash,
    "op6_bootstrapped_pii": op6_bootstrapped_pii,
    "op7_clause_grammar": op7_clause_grammar,
    "op8_wu_manber": op8_wu_manber,
    "op9_risk_controlled_rules": op9_risk_controlled_rules,
    "op10_huffman_ids": op10_huffman_ids,
    "op11_kd_trees": op11_kd_trees,
    "op12_slot_negatives": op12_slot_negatives,
    "op13_block_rotation": op13_block_rotation,
}

ORACLE = {
    "op4_sharded_warc": warc.ORACLE,
    "op8_wu_manber": wumanber.ORACLE,
    "op11_kd_trees": kdtrees.ORACLE,
    "op12_slot_negatives": hardnegatives.ORACLE,
    "op13_block_rotation": fim.ORACLE,
}
