"""The queries of this subpackage: op1 to op13 over whole tables, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docpipe.llm import bagminhash, bpe, decontam, lpf, merkle, mil, periodic, pii, rans, replay, secrets, topk, warc

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of every page, from archives that are written and read back."""
    records = warc.archive_pages(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and hashes of every document, encoded and decoded."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), keep_ids=False)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every query vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


def op5_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, size and checksum of every document's ids, read from the archive that is written first."""
    archive = rans.token_archive(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=0)
    return archive.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document."""
    return mil.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lpf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes and spans of every document."""
    return lpf.removed_spans(table(spark, sf_dir, "documents"), keep_text=False)


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near-duplicates."""
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.find(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.report(table(spark, sf_dir, "documents"))


def op11_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and hashes of every document, encoded by replayed merges and decoded."""
    return replay.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), keep_ids=False)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeating words of every document, a tenth of them with a looped tail."""
    return periodic.periodic(table(spark, sf_dir, "documents"), rewrite=True, keep_text=False)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and check of every document, a third of them tampered with."""
    return merkle.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_containment, op2_warc, op3_bpe_round_trip, op4_topk, op5_rans_tokens, op6_attention_mil, op7_lpf, op8_bagminhash, op9_pii, op10_secrets, op11_merge_replay, op12_periodic, op13_merkle)}


def oracle_sql() -> dict[str, str]:
    return {"op1_containment": decontam.ORACLE, "op2_warc": warc.ORACLE, "op4_topk": topk.ORACLE, "op13_merkle": merkle.ORACLE}
