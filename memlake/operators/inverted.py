"""Exact nearest rows by inverted lists: lists that can't hold one of the k nearest aren't read for a question.

Vectors are scaled to length 1, where the squared Euclidean distance is twice the cosine distance. Centres come from
k-means on SAMPLE vectors at most, chosen by a hash of the key; every vector then goes to its nearest centre's list,
and a list's radius is the largest distance to its centre. By the triangle inequality no row of a list is nearer to a
question than the distance to the centre less the radius. A question first reads the lists nearest to it that hold k
rows; the distance of the k-th is a bound, and all lists within it are read. So results are those of a scan
of all rows, whatever the centres; these decide how much is read only. Questions meet rows in packed blocks, each of which
goes to a task once, not once for each list; a task works out which of its lists each question of a block reads.

Vectors that are null, zero or hold nulls or non-finite components are in no list. Vectors of several lengths are
clustered apart. Rows that repeat a key are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .collection import top
from .search import BLOCK, best_of

#: Vectors that k-means sees at most, the bytes of a list that its number aims at, and the most lists of an index.
SAMPLE, LIST_BYTES, MOST_LISTS = 20_000, 64 << 20, 4096
ROUNDS = 12
#: Bytes of all packed questions up to which they are broadcast, of one block of them, and of a task's share of more.
QUESTION_BYTES, BLOCK_BYTES, SHARE_BYTES = 8 << 20, 4 << 20, 32 << 20
#: Added to every bound, so that rounding can't hide a row.
SLACK = 1e-6


class Lists(NamedTuple):
    """A written index: rows (list, id, vector) by list; centres (list, dims, centre, radius, n), at most MOST_LISTS for each length."""

    rows: DataFrame
    centres: list[tuple[int, int, np.ndarray, float, int]]


def _units(vectors: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Lengths of all vectors (0 where one is no good) and by length the unit vectors."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    units = {}
    for dims in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == dims)
        m = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        good = np.isfinite(m).all(axis=1) & m.any(axis=1)
        sizes[own[~good]] = 0
        units[dims] = _scaled(m[good])
    return sizes, units


def _scaled(m: np.ndarray) -> np.ndarray:
    """Vectors of length 1."""
    m = m / np.abs(m).max(axis=1)[:, None]
    return m / np.sqrt((m**2).sum(axis=1))[:, None]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def kmeans(vectors: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of unit vectors, from evenly spread first ones; a centre without vectors stays where it is."""
    lists = min(lists, len(vectors))
    centres = vectors[np.linspace(0, len(vectors) - 1, lists).astype(int)].copy()
    step = max(1, (1 << 20) // max(1, lists))
    for _ in range(rounds):
        near = np.concatenate([(vectors[i : i + step] @ centres.T).argmax(axis=1) for i in range(0, len(vectors), step)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        size = np.sqrt((sums**2).sum(axis=1))
        good = size > 1e-12
        centres[good] = sums[good] / size[good][:, None]
    return centres


def build(rows: DataFrame, folder: str, key: str = "id", vector: str = "embedding", lists: int | None = None) -> None:
    """Writes the lists of all rows below *folder*; *lists* for each vector length, by default as many as their bytes and their root ask for."""
    id_type = rows.schema[key].dataType.simpleString()
    own = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("id IS NOT NULL AND size(vector) > 0")
    told = own.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).collect()  # one row for each length
    n, scale = sum(r["n"] for r in told), 1 << 40
    sample = own.where(F.pmod(F.xxhash64("id"), F.lit(scale)) < min(scale, SAMPLE * scale // max(1, n))).toArrow()
    sizes, units = _units(sample.column("vector"))
    order = np.argsort(np.array(sample.column("id").to_pylist(), dtype=object), kind="stable") if len(sizes) else np.zeros(0, dtype=np.int64)
    centres = {}
    for dims, m in units.items():
        count = next(r["n"] for r in told if r["dims"] == dims)
        wanted = lists or max(int(count**0.5), count * dims * 8 // LIST_BYTES)
        place = np.full(len(sizes), -1)
        place[sizes == dims] = np.arange(len(m))
        centres[dims] = kmeans(m[[place[i] for i in order if place[i] >= 0]], min(MOST_LISTS, wanted)) if len(m) else np.eye(1, dims)
    for dims in {r["dims"] for r in told} - centres.keys():
        centres[dims] = np.eye(1, dims)
    first = {dims: sum(len(c) for d, c in centres.items() if d < dims) for dims in centres}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, units = _units(batch.column(1))
            for dims, m in units.items():
                if len(m):
                    d = _distances(m, centres[dims])
                    near = d.argmin(axis=1)
                    at = pa.array(np.flatnonzero(sizes == dims))
                    arrays = [pa.array(near + first[dims], pa.int32()), batch.column(0).take(at), batch.column(1).take(at), pa.array(d[np.arange(len(m)), near])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["list", "id", "vector", "away"])

    made = own.mapInArrow(dealt, f"list int, id {id_type}, vector array<double>, away double")
    made.hint("rebalance", "list").sortWithinPartitions("list", "id").write.partitionBy("list").parquet(f"{folder}/rows")
    spark = rows.sparkSession
    written = spark.read.schema(f"id {id_type}, vector array<double>, away double, list int").parquet(f"{folder}/rows")
    radii = written.groupBy("list").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    numbered = [(first[d] + i, d, c) for d, m in centres.items() for i, c in enumerate(m)]
    numbers, dims, vectors = zip(*numbered) if numbered else ((), (), ())
    known = spark.createDataFrame(pa.table({"list": pa.array(numbers, pa.int32()), "dims": pa.array(dims, pa.int32()), "centre": pa.array(vectors, pa.list_(pa.float64()))}))
    known.join(radii, "list").write.parquet(f"{folder}/centres")


def load(spark: SparkSession, folder: str, id_type: str = "long") -> Lists:
    held = spark.read.parquet(f"{folder}/centres").select("list", "dims", "radius", "n", "centre").toArrow()
    numbers, dims, radii, n = (held.column(c).to_pylist() for c in range(4))
    centres = [(*x[:2], c.values.to_numpy(), *x[2:]) for x, c in zip(zip(numbers, dims, radii, n), held.column(4))]
    rows = spark.read.schema(f"id {id_type}, vector array<double>, away double, list int").parquet(f"{folder}/rows")
    return Lists(rows, sorted(centres, key=lambda c: c[0]))


def _by_dims(centres: list) -> dict[int, tuple[np.ndarray, ...]]:
    return {dims: tuple(np.array(x) for x in zip(*[(i, c, r, n) for i, d, c, r, n in centres if d == dims])) for dims in {c[1] for c in centres}}


def _reach(units: np.ndarray, centres: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """How far each question's nearest centres are whose lists hold k rows."""
    d = _distances(units, centres)
    order = np.argsort(d, axis=1, kind="stable")
    last = np.minimum((np.cumsum(n[order], axis=1) < k).sum(axis=1), d.shape[1] - 1)
    rows = np.arange(len(d))
    return d[rows, order[rows, last]]


def _blocks(index: Lists, queries: DataFrame, k: int | None = None) -> DataFrame:
    """(qids, dims, data, most): questions (qid, embedding, bound) of a length packed together, each with how far off it reads.

    That is its bound, or with *k* the distance of the centres whose lists hold k rows.
    """
    held = _by_dims(index.centres)
    types = queries.schema["qid"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, units = _units(batch.column(1))
            bounds = batch.column(2).to_numpy(zero_copy_only=False)
            for dims, m in units.items():
                if dims not in held:
                    continue
                _, centres, _, n = held[dims]
                at = np.flatnonzero(sizes == dims)
                per = max(1, BLOCK_BYTES // (8 * dims))
                for low in range(0, len(m), per):
                    own = pa.array(at[low : low + per])
                    ids, data = batch.column(0).take(own), batch.column(1).take(own).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    if k is None:
                        most = np.where(np.isnan(x := bounds[at[low : low + per]]), np.inf, x)
                    else:
                        most = np.concatenate([_reach(m[i : i + BLOCK], centres, n, k) for i in range(low, min(low + per, len(m)), BLOCK)])
                    of = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                    yield pa.RecordBatch.from_arrays([of(ids), pa.array([dims], pa.int32()), pa.array([data.tobytes()], pa.binary()), of(pa.array(most, pa.float64()))], names=["qids", "dims", "data", "most"])

    rows = queries.select("qid", F.col("embedding").cast("array<double>"), F.col("bound").cast("double")).where("qid IS NOT NULL AND embedding IS NOT NULL")
    return rows.mapInArrow(packed, f"qids array<{types}>, dims int, data binary, most array<double>")


def _matrix(data: pa.Scalar, dims: int) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), dtype=np.float64).reshape(-1, dims)


def _read(units: np.ndarray, centres: np.ndarray, radii: np.ndarray, most: np.ndarray, balls: bool) -> np.ndarray:
    """Whether each question reads each list: its ball, or else its centre, is no farther than *most*."""
    return _distances(units, centres) - (radii[None] if balls else 0.0) - SLACK <= most[:, None]


def _pairs(index: Lists, blocks: DataFrame, balls: bool) -> DataFrame:
    """(qid, list) of what questions read."""
    held = _by_dims(index.centres)
    types = blocks.schema["qids"].dataType.elementType.simpleString()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qids, dims, data, most = (batch.column(c)[i] for c in range(4))
                numbers, centres, radii, _ = held[dims.as_py()]
                m, most = _matrix(data, dims.as_py()), most.values.to_numpy()
                for low in range(0, len(m), BLOCK):
                    q, which = np.nonzero(_read(_scaled(m[low : low + BLOCK]), centres, radii, most[low : low + BLOCK], balls))
                    yield pa.RecordBatch.from_arrays([qids.values.take(pa.array(q + low)), pa.array(numbers[which], pa.int32())], names=["qid", "list"])

    return blocks.mapInArrow(pairs, f"qid {types}, list int")


def _met(index: Lists, blocks: DataFrame, balls: bool, k: int, others: bool) -> DataFrame:
    """(qid, id, distance): of each list that a question reads the k nearest rows of every batch; with *balls* those within its bound."""
    held = _by_dims(index.centres)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers of the lists that a block reads, and as -1 its bytes."""
        for batch in batches:
            for i in range(batch.num_rows):
                dims, data, most = (batch.column(c)[i] for c in range(3))
                numbers, centres, radii, _ = held[dims.as_py()]
                m, most = _matrix(data, dims.as_py()), most.values.to_numpy()
                read = np.zeros(len(numbers), dtype=bool)
                for low in range(0, len(m), BLOCK):
                    read |= _read(_scaled(m[low : low + BLOCK]), centres, radii, most[low : low + BLOCK], balls).any(axis=0)
                found = numbers[read]
                yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1), pa.int32()), pa.array(np.append(np.zeros(len(found), dtype=np.int64), m.nbytes))], names=["list", "size"])

    size = {r["list"]: r["size"] for r in blocks.select("dims", "data", "most").mapInArrow(told, "list int, size long").groupBy("list").agg(F.sum("size").alias("size")).collect()}  # at most all lists
    rows = index.rows.where(F.col("list").isin([x for x in size if x >= 0]))
    q_type, r_type = blocks.schema["qids"].dataType.elementType.simpleString(), rows.schema["id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch, sort_keys=[("list", "ascending"), ("id", "ascending")]))
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for dims in np.unique(sizes).tolist():
                own = pa.array(np.flatnonzero(sizes == dims))
                lists, ids, vectors = (batch.column(c).take(own) for c in range(3))
                of = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                data = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes()
                yield pa.RecordBatch.from_arrays([of(lists), of(ids), pa.array([dims], pa.int32()), pa.array([data], pa.binary())], names=["lists", "ids", "rdims", "rdata"])

    left = rows.select("list", "id", "vector").mapInArrow(packed, f"lists array<int>, ids array<{r_type}>, rdims int, rdata binary")
    whole = size.get(-1, 0)
    # In a product each partition of questions reads all rows anew, so there are few.
    both = left.crossJoin(F.broadcast(blocks) if whole <= QUESTION_BYTES else blocks.coalesce(1 + whole // SHARE_BYTES))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lists, ids, rdims, rdata, qids, dims, data, most = (batch.column(c)[i] for c in range(8))
                if dims.as_py() != rdims.as_py():
                    continue
                m, n, most = _matrix(rdata, dims.as_py()), _matrix(data, dims.as_py()), most.values.to_numpy()
                numbers, centres, radii, _ = held[dims.as_py()]
                which, starts = np.unique(lists.values.to_numpy(), return_index=True)
                at = np.searchsorted(numbers, which)
                read = _read(_scaled(n), centres[at], radii[at], most, balls)
                parts = []
                for j, (low, high) in enumerate(zip(starts, np.append(starts[1:], len(m)))):
                    q = np.flatnonzero(read[:, j])
                    # The bound is the Euclidean distance of unit vectors, the root of twice the cosine distance.
                    limits = most[q] ** 2 / 2 if balls else None
                    parts += best_of(n[q], m[low:high], qids.values.take(pa.array(q)), ids.values.slice(low, high - low), k, others, limits)
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*parts)], names=["qid", "id", "distance"])

    return both.mapInArrow(met, f"qid {q_type}, id {r_type}, distance double")


def knn(index: Lists, queries: DataFrame, k: int, others: bool = False) -> tuple[DataFrame, DataFrame]:
    """(found, visited): the exact k nearest rows (qid, id, distance, rank) of every question (qid, embedding), and (qid, list) of what was read.

    With *others* a row whose id is the question's doesn't count. Distances and ties are those of ``search.nearest``.
    """
    order = [F.col("distance"), F.col("id")]
    shared_folder(queries.sparkSession)
    rows = queries.select("qid", "embedding", F.lit(None).cast("double").alias("bound"))
    first = _blocks(index, rows, k + others).checkpoint()  # both are used by several jobs
    # The k-th distance so far bounds the rest; cosine distance d is a Euclidean one of the root of 2 d.
    kth = top(_met(index, first, False, k, others), k, order, ["qid"]).groupBy("qid").agg(F.sqrt(2 * F.greatest(F.max("distance"), F.lit(0.0)) + F.lit(1e-9)).alias("bound"), F.count("*").alias("n"))
    bounds = kth.select("qid", F.when(F.col("n") >= k, F.col("bound")).alias("bound"))
    again = _blocks(index, rows.drop("bound").join(bounds, "qid", "left")).checkpoint()
    begun = _pairs(index, first, False)
    visited = begun.unionByName(_pairs(index, again, True).join(begun, ["qid", "list"], "left_anti"))
    return top(_met(index, again, True, k, others), k, order, ["qid"]), visited
