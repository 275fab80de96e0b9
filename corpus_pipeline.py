"""Corpus cleaning in five stages; each works on all that the one before it kept, written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and all but the last return the columns of documents. Null texts count as empty;
repeated rows are alike in every decision, and the near-duplicate stage keeps one of them; an empty table gives an empty
result, and columns beyond those of documents pass through until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmill.llm import decontam, langid, packing, quality, simhash
from weftmill.llm.common import id_crc32, saved, table
from weftmill.llm.queries import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labels of the documents outside the fold 0 of 5."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.pmod(id_crc32("doc_id"), F.lit(5)) != 0)
    return quality.accepted(docs, model)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: neither without a letter nor too far from every centroid."""
    model = langid.fit(docs, F.pmod(id_crc32("doc_id"), F.lit(4)) != 2)
    return langid.recognised(docs, model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash near-duplicate group, that of smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' token pieces in sequences of 4096."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL cannot express a stage's learned models and fingerprints; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
