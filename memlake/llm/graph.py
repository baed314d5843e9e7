"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: Distinct edges, by count, up to which one task finds the components; it holds three numbers an edge. More go in rounds.
ONE_TASK = 200_000


def smallest_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    ends = np.concatenate([table.column("u").to_numpy(), table.column("v").to_numpy()])
    ids, at = np.unique(ends, return_inverse=True)
    root = ids[smallest_reachable(len(ids), at[: table.num_rows], at[table.num_rows :])]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root)], names=["id", "component"])


def _print(edges: DataFrame) -> tuple:
    """Number and order-free digest of the edges; two numbers, whatever the size."""
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame, a: str, b: str, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component): the smallest id reachable, for every id on an edge between different ids.

    Up to ONE_TASK distinct edges are one task. Beyond, there are rounds of stars, with the same result.
    Rounds go on until one changes nothing, about log(d) squared of them for a component of diameter d. Each round
    groups with map-side minima and joins them back to the edges. Both sides of those joins are written
    before, so that the edges of a hub lie in shuffle partitions that adaptive execution may split.
    Null ends and loops are left out; repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(e.distinct())
    seen, now = None, _print(e)
    if now[0] <= one_task and dict(e.dtypes)["u"] == "bigint":
        found = cut(e.coalesce(1).mapInArrow(_reached, "id long, component long"))
        drop(e)
        return found
    while now[0] and now != seen:
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).union(e.select(F.col("v").alias("n"), F.col("u").alias("m")))
        low = cut(both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low")))
        large = cut(both.where("m > n").join(low, "n").select(F.col("m").alias("u"), F.col("low").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("low")))
        small = large.join(least, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        done, e = e, cut(small.union(least.select("u", F.col("low").alias("v"))).distinct())
        drop(low, large, least, done)
        seen, now = now, _print(e)
    ids = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
