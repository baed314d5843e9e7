"""The corpus pipeline: language ID, quality, near-duplicates, secrets, packing.

Every stage takes what its predecessor kept; all but the last return the columns of documents, whatever further columns
and names those have. What happens to odd rows: a null text, and one without a letter, goes with the language stage; an
empty table passes as an empty table; rows repeated with id and text are copies, of which one stays; rows with an id of
null are kept by the near-duplicate stage and packed each; equal scores share the fate of their threshold. Texts are
taken whole, of any length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from memlake.llm import langid, minhash, packing, quality, secrets
from memlake.llm.common import delete, table
from memlake.llm.queries import tokenizer
from memlake.session import shared_folder
from memlake.sources.stores import exists

#: Documents that score below this go. It is lower than the classifier's own cut, so that clean documents stay; README says what each keeps.
QUALITY_FLOOR = 0.5
#: The least similarity, in hundredths, of near-duplicates.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), QUALITY_FLOOR)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_first(docs, percent=NEAR_PERCENT)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: Classifiers and tokenizers have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over documents; each result is written below *folder* and read again, and its predecessor's goes.

    *folder* is a new one in the shared folder of the session. A run that was stopped goes on after its last whole stage
    if it is given the same folder again.
    """
    folder = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    names = [name for name, _ in STAGES[:-1]]
    last = max((i for i, name in enumerate(names) if exists(spark, f"{folder}/{name}/_SUCCESS")), default=-1)
    docs = spark.read.parquet(f"{folder}/{names[last]}") if last >= 0 else table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[last + 1 : -1], last + 1):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if i:
            delete(spark, f"{folder}/{names[i - 1]}")
    return STAGES[-1][1](spark, docs, sf_dir)
