"""Incremental ingest as joins with state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cursors(held: DataFrame, session: str = "session_id", time: str = "timestamp") -> DataFrame:
    """High-water mark of each session."""
    return held.groupBy(session).agg(F.max(time).alias("cursor"))


def sweep(incoming: DataFrame, held: DataFrame, session: str = "session_id", time: str = "timestamp", key: str = "id") -> DataFrame:
    """Incoming rows with a state: skipped (strictly before the session's cursor), present (same id held) or new."""
    rows = incoming.join(cursors(held, session, time), session, "left").join(held.select(key, F.lit(True).alias("__held")), key, "left")
    state = F.when(F.col(time) < F.col("cursor"), "skipped").when(F.col("__held"), "present").otherwise("new")
    return rows.withColumn("state", state).drop("cursor", "__held")


def stale_sources(files: DataFrame, state: DataFrame, version: int = 2, tolerance: float = 0.001) -> DataFrame:
    """Files to ingest: unknown, of an older version, or with another modification time."""
    known = state.where(F.col("version") >= version).select("source_file", F.col("mtime").alias("__m"))
    fresh = files.join(known, "source_file").where(F.abs(F.col("mtime") - F.col("__m")) <= tolerance).select("source_file")
    return files.join(fresh, "source_file", "left_anti")


def reingest(held: DataFrame, new: DataFrame, sources: DataFrame, source: str = "source_file") -> DataFrame:
    """The table after the *sources* were read again: all their old rows go, the new rows come, others stay."""
    return held.join(sources.select(source).distinct(), source, "left_anti").unionByName(new.join(sources.select(source).distinct(), source, "left_semi"))


def file_state(files: DataFrame, chunks: DataFrame, version: int = 2, source: str = "source_file") -> DataFrame:
    """(source, mtime, version, n_chunks) of every file that was read. One without a chunk has a row, too, and isn't read again."""
    counts = chunks.groupBy(source).agg(F.count("*").alias("n_chunks"))
    return files.select(source, "mtime").join(counts, source, "left").select(source, "mtime", F.lit(version).alias("version"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def diary_news(entries: DataFrame, state: DataFrame, source: str = "source_file") -> DataFrame:
    """Entries (source, size, position, entry) not yet taken in, by the state (source, size, entry_count) of the last run.

    A file of the same size is unchanged; of others the entries from the count on are new, as diaries only grow.
    """
    known = state.select(F.col(source).alias("__s"), F.col("size").alias("__size"), F.col("entry_count").alias("__n"))
    met = entries.join(known, entries[source] == F.col("__s"), "left")
    return met.where(F.col("__s").isNull() | ((F.col("size") != F.col("__size")) & (F.col("position") >= F.col("__n")))).drop("__s", "__size", "__n")


def diary_state(entries: DataFrame, source: str = "source_file") -> DataFrame:
    return entries.groupBy(source).agg(F.first("size").alias("size"), F.count("*").alias("entry_count"))


def rate_windows(events: DataFrame, key: str, time: str, seconds: int = 60) -> DataFrame:
    """Requests of each key in aligned windows."""
    return events.groupBy(key, F.window(time, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("window_start"), "n")
