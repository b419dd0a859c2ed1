"""The corpus pipeline: documents through quality, near-duplicates, decontamination, personal data and tokens.

Each stage is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docpipe.llm import bagminhash, bpe, decontam, mil, pii
from docpipe.llm.common import drop_since, made, shared_dir

TOKENIZER = "word_bpe_49k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not reject.

    Null texts count as empty; repeated rows share their fate; all columns stay; empty tables stay empty.
    """
    return mil.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates.

    That with the smallest doc_id, null as the largest; null and empty texts are one class; all columns stay.
    """
    return bagminhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts contain none; all columns stay.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind.

    Null texts stay null; other columns stay but n_chars, which is counted anew.
    """
    return pii.redact(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, hashes, and the token ids and decoded text of each document.

    Null texts count as empty: no ids, and empty text back.
    """
    return bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from a table in the shared folder; what the stages wrote besides is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = made()
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = shared_dir(spark, name)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        drop_since(spark, since, keep=path)
    return docs


#: Classifier and signatures are beyond SQL; tests/llm/test_pipeline.py compares the rows with a plain restatement instead.
ORACLE_SQL = None
