"""Structured Streaming: sweeps with per-session cursors, saves every n messages, rate windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.incremental import sweep
from ..sources.chats import sweep_records
from ..sources.stores import read_if_there


def message_id():
    return F.concat(F.lit("sweep_"), F.col("session_id"), F.lit("_"), F.col("uuid"))


def batch_label(spark: SparkSession, number: int) -> str:
    """The name of a micro-batch, asked for within it: the stream's id, which its checkpoint keeps, and the batch's number.

    A stream that lost its checkpoint has a new id and begins at 0 again; it replaces no batch of its predecessor.
    """
    return f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number:09d}"


def write_batch(rows: DataFrame, path: str, label: str, *by: str) -> None:
    """Writes a batch as partitions of its own; one that is run again replaces them, so nothing is written twice."""
    rows.withColumn("batch", F.lit(label)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(path)


def add_batch(rows: DataFrame, path: str, keys: list[str], label: str, *by: str) -> None:
    """Writes those rows of a batch whose keys no other batch of the table has; of the table only the keys are read.

    Keys of the batch are distinct and not null.
    """
    held = read_if_there(rows.sparkSession, path)
    if held is not None:
        rows = rows.join(held.where(F.col("batch") != label).select(*keys), keys, "left_anti")
    write_batch(rows, path, label, *by)


def _tips(rows: DataFrame) -> DataFrame:
    """The newest rows of each session and batch: they are all that a sweep needs to know of what is held."""
    newest = F.max("timestamp").over(Window.partitionBy("session_id", "batch"))
    return rows.select("session_id", "timestamp", "id", "batch", newest.alias("__t")).where("timestamp = __t").drop("__t")


def _held(spark: SparkSession, target: str, label: str) -> DataFrame | None:
    """The newest rows of what other batches have written: by their table, and for batches it lacks by the target itself.

    A batch that was stopped between both, or whose table was lost, is among the latter.
    """
    all_rows, tips = read_if_there(spark, target), read_if_there(spark, f"{target}.tips")
    if all_rows is None:
        return None
    others = all_rows.where(F.col("batch") != label)
    if tips is None:
        return _tips(others)
    lacking = others.select("batch").distinct().join(tips.select("batch").distinct(), "batch", "left_anti")
    names = [r["batch"] for r in lacking.collect()]  # names of the batches that were stopped: a handful
    known = tips.where(F.col("batch") != label).select("session_id", "timestamp", "id", "batch")
    return known.unionByName(_tips(others.where(F.col("batch").isin(names)))) if names else known


def _merge(spark: SparkSession, target: str):
    """Writes each batch as a partition of the target, its sessions' newest rows and its broken lines beside it.

    A batch reads the newest rows only, of the target but the names of its batches.
    """
    target = target.rstrip("/")

    def write(batch: DataFrame, number: int) -> None:
        label = batch_label(spark, number)
        lines = batch.persist()
        broken = lines.where((F.trim("line") != "") & F.try_parse_json("line").isNull()).distinct()
        add_batch(broken, f"{target}.broken", ["source_file", "line"], label)
        rows = sweep_records(lines).drop("source_file").withColumn("id", message_id()).dropDuplicates(["id"])
        held = _held(spark, target, label)
        new = rows
        if held is not None:
            new = sweep(rows, held.join(rows.select("session_id").distinct(), "session_id", "left_semi")).where("state = 'new'").drop("state")
        new = new.persist()
        write_batch(new, target, label)
        write_batch(_tips(new.withColumn("batch", F.lit(label))), f"{target}.tips", label)
        new.unpersist()
        lines.unpersist()

    return write


def sweep_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Reads new session logs below *source* once and merges their messages into *target*.

    A message older than its session's cursor is dropped; one at the cursor is tried again and found by its id. Lines
    that are no JSON go to ``<target>.broken``, each once. A lost checkpoint means that all files are read again, and
    loses or doubles nothing.
    """
    lines = spark.readStream.text(source, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("line"))
    return lines.writeStream.foreachBatch(_merge(spark, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def save_every(messages: DataFrame, n: int) -> DataFrame:
    """(session_id, saves): how many times a session has reached another n user messages; state is one counter each."""

    def counted(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        now = before + sum(int((f.role == "user").sum()) for f in frames)
        state.update((now,))
        if now // n > before // n:
            yield pd.DataFrame({"session_id": [key[0]], "saves": [now // n]})

    return messages.groupBy("session_id").applyInPandasWithState(counted, "session_id string, saves long", "n long", "append", GroupStateTimeout.NoTimeout)


def rate_stream(requests: DataFrame, key: str, time: str, seconds: int = 60, late: str = "2 minutes") -> DataFrame:
    """Counts of each key in aligned windows, closed once the watermark has passed."""
    return requests.withWatermark(time, late).groupBy(key, F.window(time, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
