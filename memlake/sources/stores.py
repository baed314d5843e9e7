"""Copies between stores: resumable appends, and replacement by a verified new folder."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    store, p = _at(spark, path)
    return store.exists(p)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at *path*; None if there is none, or none with a row yet. Any other failure is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def copy_new(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose keys the Parquet store at *path* lacks, and returns how many.

    A stopped copy is resumed by calling it again. Of rows with equal keys one is copied; rows with a null key aren't.
    """
    spark = rows.sparkSession
    fresh = rows.dropna(subset=keys).dropDuplicates(keys)
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    before = spark.read.parquet(path).count() if exists(spark, path) else 0
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def replace(rows: DataFrame, path: str, keep_old: bool = True) -> str | None:
    """Writes the rows beside *path*, counts them there, and only then renames; the old folder becomes path.old-<id> unless it is dropped.

    The rows may be read from *path* itself. Returns where the old folder is, if it is kept.
    """
    spark = rows.sparkSession
    tag = uuid.uuid4().hex
    fresh, old = f"{path}.new-{tag}", f"{path}.old-{tag}"
    rows.write.parquet(fresh)
    written, wanted = spark.read.parquet(fresh).count(), rows.count()
    if written != wanted:
        raise RuntimeError(f"{written} rows written of {wanted}")
    store, p = _at(spark, path)
    had = store.exists(p)
    if had and not store.rename(p, _at(spark, old)[1]):
        raise RuntimeError(f"can't move {path}")
    if not store.rename(_at(spark, fresh)[1], p):
        if had:
            store.rename(_at(spark, old)[1], p)
        raise RuntimeError(f"can't move {fresh}")
    spark.catalog.refreshByPath(path)
    if had and not keep_old:
        store.delete(_at(spark, old)[1], True)
    return old if had and keep_old else None


def counts_agree(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Groups (by, n_a, n_b) whose counts differ between two stores; none if the copy is whole."""
    count = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    x, y = count(a, "n_a"), count(b, "n_b")
    on = [x[c].eqNullSafe(y[c]) for c in by]
    both = x.join(y, on, "full").select(*[F.coalesce(x[c], y[c]).alias(c) for c in by], F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return both.where("n_a <> n_b")
