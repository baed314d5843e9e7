"""Tables of drawers: reads, writes by merge, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .where import Metadata, compile_where

#: Columns that are no fields of their own.
PARTS = ("document", "embedding", "metadata")


def fields_of(df: DataFrame) -> Metadata:
    """Every column but the parts is a field; further ones are looked up in the JSON text of ``metadata``."""
    numeric = frozenset(f.name for f in df.schema if isinstance(f.dataType, T.NumericType))
    return Metadata({c: df[c] for c in df.columns if c not in PARTS}, df["metadata"] if "metadata" in df.columns else None, numeric)


def get(df: DataFrame, ids: list | None = None, where: dict | None = None, where_document: dict | None = None, limit: int | None = None, offset: int = 0, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rows by ids and filters, in a stable order if a page is asked for."""
    out = df.where(compile_where(where, where_document, fields_of(df), df["document"]))
    if ids is not None:
        out = out.where(F.col("id").isin(ids))
    if limit is not None or offset:
        out = out.orderBy(*order).offset(offset)
        out = out if limit is None else out.limit(limit)
    return out


def include(df: DataFrame, what: tuple[str, ...] = ("documents", "metadatas")) -> DataFrame:
    """Only the asked-for parts; unknown names are ignored, embeddings are off unless named."""
    groups = {"documents": ("document",), "embeddings": ("embedding",), "distances": ("distance",)}
    chosen = {"id", *(c for w in what for c in groups.get(w, ()))}
    if "metadatas" in what:
        chosen |= set(df.columns) - {c for g in groups.values() for c in g}
    return df.select(*[c for c in df.columns if c in chosen])


def add(df: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Append; an id that is there already fails the job."""
    clash = new.join(df.select(key), key, "left_semi").withColumn(key, F.raise_error(F.lit("duplicate id")).cast(df.schema[key].dataType))
    return df.unionByName(new).unionByName(clash)


def upsert(df: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace those of the same id."""
    return df.join(new.select(key), key, "left_anti").unionByName(new)


def update(df: DataFrame, changes: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Non-null values of *changes* replace those of the same id; unknown ids are added with nulls elsewhere."""
    renamed = changes.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = df.join(renamed, df[key] == F.col("__key"), "full")
    return joined.select(*[F.coalesce(key, "__key").alias(key) if c == key else F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def delete(df: DataFrame, ids: list | None = None, where: dict | None = None) -> DataFrame:
    """The rows that stay. One of the arguments is needed, so that nothing is emptied by mistake."""
    if ids is None and not where:
        raise ValueError("delete needs ids or a filter")
    gone = compile_where(where, None, fields_of(df), df["document"]) if where else F.lit(True)
    gone = gone if ids is None else gone & F.col("id").isin(ids)
    return df.where(~F.coalesce(gone, F.lit(False)))


def top(df: DataFrame, k: int, order: list[Column], by: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1; Spark limits the groups before it shuffles them."""
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def among(df: DataFrame, keys: DataFrame, small: bool) -> DataFrame:
    """The rows that have the values of the columns of *keys*; if those are few, they go to the rows, so that no row is shuffled for it."""
    keys = keys.distinct()
    return df.join(F.broadcast(keys) if small else keys, keys.columns, "left_semi")


def newest(df: DataFrame, k: int, by: str, tie: str = "id") -> DataFrame:
    """The k newest rows, nulls last."""
    return df.orderBy(F.col(by).desc_nulls_last(), tie).limit(k)


def taxonomy(df: DataFrame, *levels: str) -> DataFrame:
    """Counts by levels; a missing name counts as unknown."""
    return df.groupBy(*[F.coalesce(level, F.lit("unknown")).alias(level) for level in levels]).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, outer: str = "wing", inner: str = "room") -> DataFrame:
    """Counts by both levels, numbered within the outer one from the largest; equal ones by name."""
    counted = taxonomy(df, outer, inner)
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(outer).orderBy(F.col("n").desc(), inner)))


def source_groups(df: DataFrame, least: int = 5, pattern: str | None = None, wing: str | None = None) -> DataFrame:
    """(source_file, n) of sources with so many drawers at least, in a wing and with a pattern in their name if asked for."""
    rows = df if wing is None else df.where(F.col("wing") == wing)
    rows = rows if pattern is None else rows.where(F.contains(F.lower("source_file"), F.lit(pattern.lower())))
    return rows.groupBy("source_file").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def top_sources(groups: DataFrame, k: int = 15) -> DataFrame:
    return groups.orderBy(F.col("n").desc(), "source_file").limit(k)


def export_stats(df: DataFrame) -> DataFrame:
    """Rooms and drawers of each wing, as an export's index tells them."""
    per_room = df.groupBy(F.coalesce("wing", F.lit("unknown")).alias("wing"), F.coalesce("room", F.lit("general")).alias("room")).agg(F.count("*").alias("n"))
    return per_room.groupBy("wing").agg(F.count("*").alias("rooms"), F.sum("n").alias("drawers"))


def unreadable(ids: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Ids on record without a readable row: absent, or with a null document."""
    return ids.select(key).distinct().join(rows.where("document is not null").select(key), key, "left_anti")


def prune(rows: DataFrame, bad: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(bad.select(key), key, "left_anti")
