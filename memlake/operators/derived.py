"""Tables derived row by row from another one, of which only changed partitions are written again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stores import read_if_there

#: Partitions of a derived table, by a hash of the key.
PARTS = 64


def row_digest(df: DataFrame, key: str) -> Column:
    """A digest of all columns of a row but its key."""
    return F.sha2(F.to_json(F.struct(*[c for c in sorted(df.columns) if c != key]), {"ignoreNullFields": "false"}), 256)


def current(df: DataFrame, key: str) -> DataFrame:
    """The rows of a derived table as it was read, without what the table keeps for itself."""
    return df.where(F.col(key).isNotNull()).drop("__digest", "__part")


def refresh(rows: DataFrame, path: str, derive: Callable[[DataFrame], DataFrame], key: str = "id", parts: int = PARTS) -> int:
    """Brings the table at *path* to what *derive* makes of the rows (one for each key), and returns how many rows were derived anew.

    The table holds a digest of each source row. Rows whose digest it has stay as they are; a partition in which a row is
    new, changed or gone is written again, by dynamic overwrite, and others aren't touched. A run that was stopped is
    repeated with the same result. *derive* keeps the key and gives each row a result of its own. Rows without a key are left out.
    A partition that has lost all its rows holds one row without a key.
    """
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int").alias("__part")
    now = rows.where(F.col(key).isNotNull()).select("*", row_digest(rows, key).alias("__digest"), part)
    held = read_if_there(spark, path)
    made = derive(now.drop("__digest", "__part"))
    known = (held if held is not None else spark.createDataFrame([], made.schema).withColumns({"__digest": F.lit(""), "__part": F.lit(0)})).where(F.col(key).isNotNull())
    a, b = now.select(key, "__digest", "__part"), known.select(F.col(key).alias("__k"), F.col("__digest").alias("__d"), F.col("__part").alias("__p"))
    met = a.join(b, F.col(key) == F.col("__k"), "full")
    other = met.where(~F.col("__digest").eqNullSafe(F.col("__d"))).select(F.coalesce("__part", "__p").alias("__part")).distinct()
    touched = sorted(r["__part"] for r in other.collect())  # at most all partitions
    if not touched:
        return 0
    own = now.where(F.col("__part").isin(touched))
    same = known.where(F.col("__part").isin(touched)).select(key, "__digest")
    new = own.join(same, [key, "__digest"], "left_anti").persist()
    n = new.count()  # before the table changes
    fresh = derive(new.drop("__digest", "__part")).join(new.select(key, "__digest", "__part"), key)
    kept = known.where(F.col("__part").isin(touched)).join(own.select(key, "__digest"), [key, "__digest"], "left_semi")
    empty = spark.createDataFrame([(p,) for p in touched], "__part int").join(own.select("__part").distinct(), "__part", "left_anti")
    out = fresh.unionByName(kept, allowMissingColumns=True).unionByName(empty, allowMissingColumns=True)
    out.hint("rebalance", "__part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__part").parquet(path)
    new.unpersist()
    return n
