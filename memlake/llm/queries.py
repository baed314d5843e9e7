"""The registered queries of this subpackage; each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, langid, licences, media, minhash, oracles, packing, pii, quality, secrets, sentencepieces, turns, vectors
from .common import table


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents"))


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered segments of every page of the pages table."""
    return media.segments(media.sequences(table(spark, sf_dir, "pages")), "page_id")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_documents(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_damaged(table(spark, sf_dir, "conversations"))


# What exact rules fix, apart from what the methods add, so that SQL can say it, too.


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_pii(spark, sf_dir).drop("spans")


def media_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes", "media_sha256")


def licence_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_licences(spark, sf_dir).drop("labels", "score")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_secrets(spark, sf_dir).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_pii, op2_media, op3_licences, op4_secrets, op5_quality, op6_vectors, op7_bpe, op8_packing, op9_minhash, op10_langid, op11_sentencepiece, op12_turns)
    return {f.__name__: f for f in (*every, media_pages, pii_base, media_base, licence_base, secret_base)}


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the whole result; the tests hold the rest against brute force, round trips or held-out accuracy."""
    return dict(oracles.SQL)
