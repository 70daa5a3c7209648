"""A training-data pipeline over ``documents`` (part of rxlake.llm).

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's documents.  All but the last
return the columns of ``docs``.

1. quality rules: documents that the base rule or a certified cutoff rejects go;
2. near-duplicates: of each class the document with the smallest id stays;
3. decontamination: documents with 5 % or more of their words inside benchmark
   windows go;
4. personal data: found spans are replaced by ``[EMAIL]``, ``[IP]``, ``[CARD]``, ``[PHONE]``;
5. packing: the texts' ids, cut into sequences of 2048.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rxlake.llm import dartminhash, packing, pii, quality, wumanber
from rxlake.llm.store import drop, drop_unread, recorded, written

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dartminhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), "text")
    checked = wumanber.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["row"])
    return checked.where("not contaminated").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


def _own(stage):
    """The stage; of the tables it writes for itself only those stay that its result reads, so a result
    that is not yet written can be computed again, whatever runs beside or after it."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with recorded() as made:
            out = stage(spark, docs, sf_dir)
        drop_unread(out, made)
        return out
    return run_stage


STAGES = [("quality_rules", _own(quality_rules)), ("near_dedup", _own(near_dedup)),
          ("decontamination", _own(decontamination)), ("personal_data", _own(personal_data)), ("packing", _own(pack))]
#: learned cutoffs, signatures and token ids are beyond SQL; tests/llm/test_pipeline.py has the plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  A stage's tables go once the next result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with recorded() as left:
            out = stage(spark, docs, sf_dir)
        with recorded() as now:
            docs = written(out, name)
        drop(spark, before + left)
        before = now
    return STAGES[-1][1](spark, docs, sf_dir)
