"""Mines a table of documents into drawers: windows of their texts, filed by wing and room, with a status of what is where.

    python -m jobs.mine_documents --config jobs/mine_documents.json --documents PATH --output PATH

Reads Parquet (doc_id, text, lang, source). Writes ``<output>/drawers``, partitioned by wing (the source) and room (the
topic with most keywords in the document), and ``<output>/status``, partitioned by wing: drawers, characters and
documents of each room and hall. Each run replaces both with what the table holds now, so a stopped or repeated run
leaves the same result. A null or blank source is the wing ``unknown``; a null, blank or short text has no drawers; rows
that repeat an id are mined each, into drawers that share ids.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.text import short_hash
from memlake.operators import classify, transcript

log = logging.getLogger("jobs.mine_documents")

SETTINGS = ["documents", "output", "size", "overlap", "least"]
DRAWERS = "id string, doc_id long, chunk_index int, source_file string, lang string, hall string, document string, wing string, room string"

STATUS = "room string, hall string, drawers long, characters long, documents long, wing string"


def drawers(docs: DataFrame, size: int = transcript.CHUNK, overlap: int = transcript.OVERLAP, least: int = transcript.LEAST) -> DataFrame:
    """Windows of every document with their place, content type and fixed id; texts are read and cut where they lie."""
    text = F.coalesce("text", F.lit(""))
    wing = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("unknown"))
    files = docs.select("doc_id", "lang", text.alias("document"), wing.alias("wing"), classify.keyword_class(text, classify.TOPICS, "general").alias("room"), F.concat_ws("/", wing, F.col("doc_id").cast("string")).alias("source_file"))
    chunks = transcript.fixed_chunks(files, "doc_id", "document", size, overlap, least, keep=("lang", "wing", "room", "source_file"))
    digest = short_hash(24, F.col("source_file"), F.col("chunk_index").cast("string"))
    return chunks.select(
        F.concat_ws("_", F.lit("drawer"), "wing", "room", digest).alias("id"), "doc_id", "chunk_index", "source_file", "lang",
        classify.keyword_class(F.col("chunk"), classify.HALLS, "general").alias("hall"), F.col("chunk").alias("document"), "wing", "room",
    )


def status(of: DataFrame) -> DataFrame:
    """(wing, room, hall, drawers, characters, documents): every hall of every room, and each room as a whole (hall null)."""
    return of.groupingSets([["wing", "room", "hall"], ["wing", "room"]], "wing", "room", "hall").agg(F.count("*").alias("drawers"), F.sum(F.length("document")).alias("characters"), F.count_distinct("doc_id").alias("documents"))


def run(spark: SparkSession, documents: str, output: str, size: int = transcript.CHUNK, overlap: int = transcript.OVERLAP, least: int = transcript.LEAST) -> DataFrame:
    """Mines the table at *documents* into *output* and returns the drawers as they were written."""
    docs = spark.read.parquet(documents)
    log.info("reading %s", documents)
    # Rebalancing by partition keeps files few, and splits a wing or room that holds much of the table.
    made = drawers(docs, size, overlap, least).hint("rebalance", "wing", "room")
    made.write.mode("overwrite").partitionBy("wing", "room").parquet(f"{output}/drawers")
    written = spark.read.schema(DRAWERS).parquet(f"{output}/drawers")
    status(written).write.mode("overwrite").partitionBy("wing").parquet(f"{output}/status")
    total = spark.read.schema(STATUS).parquet(f"{output}/status").where("hall IS NULL").agg(F.sum("drawers"), F.sum("documents"), F.count("*")).first()
    log.info("wrote %s drawers of %s documents in %s rooms below %s", total[0] or 0, total[1] or 0, total[2], output)
    return written


def main() -> None:
    from jobs.settings import arguments, start_log
    from memlake.session import session

    given = arguments(__doc__.split("\n")[0], SETTINGS)
    numbers = {k: int(given.pop(k)) for k in ("size", "overlap", "least") if k in given}
    start_log()
    spark = session()
    try:
        run(spark, **given, **numbers)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
