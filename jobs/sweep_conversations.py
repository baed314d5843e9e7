"""Sweeps new files of conversations into drawers, message by message, each message once.

    python -m jobs.sweep_conversations --config jobs/sweep_conversations.json --conversations PATH --output PATH --checkpoint PATH

A file stream over Parquet (conv_id, turn, role, text; a folder, or a pattern of files) takes the files that its
checkpoint doesn't know, in micro-batches of *files_per_batch* at most (all of them if not given), and ends. Messages of
users and assistants go to ``<output>/messages``, partitioned by batch and room; what has no place in a conversation,
another role, or no text, goes to ``<output>/rejected``, partitioned by batch and reason, and is never lost.

A message's id comes from conversation and turn. One that comes again, in the same file or a later one, is the same
message; of several texts the first by role and text is taken, and one that was written stays. So a run that is
repeated, stopped within a batch, or has lost its checkpoint, ends in the same tables.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.operators import classify
from memlake.sources.stores import read_if_there
from memlake.streaming.sweep import add_batch, batch_label

log = logging.getLogger("jobs.sweep_conversations")

SETTINGS = ["conversations", "output", "checkpoint", "files_per_batch"]
SCHEMA = "conv_id long, turn long, role string, text string"
ROLES = ("user", "assistant")


def judged(rows: DataFrame) -> DataFrame:
    """The rows with their id and, if they are no messages, the reason."""
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    reason = F.when(~placed, "place").when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "role").when(~F.coalesce(F.rlike("text", F.lit(r"\S")), F.lit(False)), "blank")
    digest = F.sha2(F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}), 256)
    sweep_id = F.concat_ws("_", F.lit("sweep"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return rows.select("conv_id", "turn", "role", "text", reason.alias("reason"), F.when(reason.isNull(), sweep_id).otherwise(digest).alias("id"))


def filed(messages: DataFrame) -> DataFrame:
    """One row of each id, with the room and hall that its text tells."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("role", "text"))
    once = messages.withColumn("__n", first).where("__n = 1")
    text = F.col("text")
    return once.select("id", "conv_id", "turn", "role", text.alias("document"), classify.keyword_class(text, classify.HALLS, "general").alias("hall"), classify.keyword_class(text, classify.TOPICS, "general").alias("room"))


def _add(output: str):
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        label = batch_label(spark, number)
        rows = judged(batch).persist()
        add_batch(filed(rows.where("reason IS NULL")), f"{output}/messages", ["id"], label, "room")
        add_batch(rows.where("reason IS NOT NULL").dropDuplicates(["id"]), f"{output}/rejected", ["id"], label, "reason")
        counts = {name: spark.read.parquet(f"{output}/{name}").where(F.col("batch") == label).count() if read_if_there(spark, f"{output}/{name}") is not None else 0 for name in ("messages", "rejected")}
        log.info("batch %s: read %s rows, wrote %s messages and %s rejected rows", label, rows.count(), counts["messages"], counts["rejected"])
        rows.unpersist()

    return write


def run(spark: SparkSession, conversations: str, output: str, checkpoint: str, files_per_batch: int | None = None) -> DataFrame:
    """Takes in the new files, waits for the end, and returns all that the output holds."""
    reader = spark.readStream.schema(SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    log.info("reading new files of %s", conversations)
    stream = reader.parquet(conversations).writeStream.foreachBatch(_add(output)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    return written(spark, output)


def written(spark: SparkSession, output: str) -> DataFrame:
    """(id, conv_id, turn, role, document, hall, room, reason) of all messages and rejected rows."""
    columns = {"id": "string", "conv_id": "long", "turn": "long", "role": "string", "document": "string", "hall": "string", "room": "string", "reason": "string"}
    out = spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in columns.items()))
    messages, rejected = (read_if_there(spark, f"{output}/{name}") for name in ("messages", "rejected"))
    if messages is not None:
        out = out.unionByName(messages.drop("batch"), allowMissingColumns=True)
    if rejected is not None:
        out = out.unionByName(rejected.drop("batch").withColumnRenamed("text", "document"), allowMissingColumns=True)
    return out


def main() -> None:
    from jobs.settings import arguments, start_log
    from memlake.session import session

    given = arguments(__doc__.split("\n")[0], SETTINGS)
    if "files_per_batch" in given:
        given["files_per_batch"] = int(given["files_per_batch"])
    start_log()
    spark = session()
    try:
        run(spark, **given)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
