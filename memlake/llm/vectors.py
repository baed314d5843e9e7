"""Near-duplicate vectors by int8 tile products with error bounds (operator 6).

Equal vectors of a label become one class with a count. The classes of a label are dealt to blocks of about BLOCK by a
hash; each pair of blocks is one tile, one task's work at a time. Tiles hold int8 codes, scales and error norms only. In
a tile, products of the codes give every cosine up to a bound: for unit vectors u = u' + r and w = w' + t, with u', w' as
quantised, |u.w - u'.w'| <= |r| + (1 + |r|)|t|. Pairs that are above the threshold by more than their own bound are
links, those below it by more are none. Only classes that stand in a pair between the two are fetched in full precision,
and only those pairs are recomputed in double precision, in a second tile of the same blocks.

A tile returns, for each class, how many vectors it is linked with there and the smallest id of its component within the
tile, so rows follow the classes and not the links. Those stars are joined to components afterwards.

Vectors link only within one label and one dimension. A vector that is null, zero or holds nulls or non-finite
components, and one whose label or id is null, links with nothing and is its own component. Rows that share an id are
one node of the components; each is counted as a vector. Ties at the threshold count as links. An empty table gives no
rows; the input's other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop
from .graph import components, smallest_reachable

THRESHOLD = 0.93
BLOCK = 1024
BROADCAST_ROWS = 100_000
PAIRS_AT_ONCE = 1 << 15


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, their int8 codes, scales, and the norms of what the codes leave out, rounded up."""
    norm = np.sqrt((v * v).sum(axis=1))
    unit = v / norm[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    left = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return unit, codes, scale, left


def bounds(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Products of two blocks of (codes, scale, left) and how far the true cosines may be from them."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    # Integers below 2 ** 24 are exact in float32 up to 1040 dimensions; beyond, in float64.
    kind = np.float32 if qa.shape[1] <= 1040 else np.float64
    rough = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64) * sa[:, None] * sb[None, :]
    return rough, ea[:, None] + (1 + ea[:, None]) * eb[None, :]


def judged(a: tuple, b: tuple, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the pairs that are links for sure, and of those in doubt; below the diagonal only if both are one block."""
    rough, error = bounds(a, b)
    sure = rough - error >= threshold + 1e-9
    doubt = (rough + error >= threshold - 1e-9) & ~sure
    if same:
        lower = np.tri(len(a[1]), k=-1, dtype=bool)
        sure, doubt = sure & lower, doubt & lower
    return sure, doubt


def exact(va: np.ndarray, vb: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which index pairs have a cosine of at least *threshold* in double precision."""
    keep = np.zeros(len(i), dtype=bool)
    na, nb = np.sqrt((va * va).sum(axis=1)), np.sqrt((vb * vb).sum(axis=1))
    for at in range(0, len(i), PAIRS_AT_ONCE):
        p, q = i[at : at + PAIRS_AT_ONCE], j[at : at + PAIRS_AT_ONCE]
        keep[at : at + PAIRS_AT_ONCE] = np.einsum("ij,ij->i", va[p], vb[q]) / (na[p] * nb[q]) >= threshold
    return keep


def _scaled(data: list[bytes]) -> np.ndarray:
    v = np.stack([np.frombuffer(x, dtype="<f8") for x in data])
    with np.errstate(all="ignore"):
        return v / np.abs(v).max(axis=1)[:, None]


def _coded(classes: DataFrame) -> DataFrame:
    """The classes with codes, scale and left in place of the vector."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(b"", 0.0, 0.0)] * batch.num_rows
            dims = np.array([len(x) for x in batch.column(5).to_pylist()])
            for n in np.unique(dims).tolist():
                own = np.flatnonzero(dims == n)
                _, codes, scale, left = quantise(_scaled(batch.column(5).take(pa.array(own)).to_pylist()))
                for k, c, s, e in zip(own.tolist(), codes, scale.tolist(), left.tolist()):
                    out[k] = c.tobytes(), s, e
            made = [pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 3, (pa.binary(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *made], names=["key", "rep", "copies", "label", "dims", "codes", "scale", "left"])

    chosen = classes.select("key", "rep", "copies", "label", F.octet_length("vector").alias("dims"), "vector")
    return chosen.mapInArrow(mapped, "key binary, rep long, copies long, label string, dims int, codes binary, scale double, left double")


FOUND = pa.schema([("key", pa.binary()), ("rep", pa.int64()), ("copies", pa.int64()), ("label", pa.string()), ("dims", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("block", pa.int32()), ("links", pa.int64()), ("root", pa.int64()), ("doubt", pa.bool_())])


def _tile(threshold: float, full: bool):
    """Links of a tile: the sure ones from codes, or those among the doubtful that hold in full precision."""

    def linked(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rep", "ascending"), ("key", "ascending")])
        ids, copies, block = (table.column(c).to_numpy() for c in ("rep", "copies", "block"))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        if full:
            v = _scaled(table.column("vector").to_pylist())
            _, codes, scale, left = quantise(v)
        else:
            codes = np.stack([np.frombuffer(x, dtype=np.int8) for x in table.column("codes").to_pylist()])
            scale, left = table.column("scale").to_numpy(), table.column("left").to_numpy()
        a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
        sure, unsure = judged((codes[a], scale[a], left[a]), (codes[b], scale[b], left[b]), low == high, threshold)
        i, j = np.nonzero(unsure)
        doubt = np.zeros(len(ids), dtype=bool)
        if full:
            keep = exact(v[a], v[b], i, j, threshold)
            i, j = i[keep], j[keep]
        else:
            doubt[a[i]] = doubt[b[j]] = True
            i, j = np.nonzero(sure)
        i, j = a[i], b[j]
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        root = smallest_reachable(len(ids), i, j)
        hit = np.flatnonzero((links > 0) | doubt)
        kept = table.select(["key", "rep", "copies", "label", "dims", "low", "high", "block"]).take(pa.array(hit))
        for name, values in (("links", links[hit].astype(np.int64)), ("root", ids[root[hit]]), ("doubt", doubt[hit])):
            kept = kept.append_column(name, pa.array(values))
        return kept.cast(FOUND)

    return linked


def _keyed(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector, key): the vector as doubles and a digest of label and vector; both null if it links with nothing."""
    chosen = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, keys = [], []
            for i, label, v in zip(*(c.to_pylist() for c in batch.columns)):
                v = np.array(v, dtype="<f8") if i is not None and label is not None and v and None not in v else np.zeros(0)
                good = len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())
                data = (v + 0.0).tobytes() if good else None
                out.append(data)
                keys.append(hashlib.blake2b(data, key=hashlib.sha256(label.encode()).digest(), digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array(keys, pa.binary())], names=["id", "label", "vector", "key"])

    return chosen.mapInArrow(mapped, "id long, label string, vector binary, key binary")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: id, n_links, component_id and kept."""
    rows = cut(_keyed(df, id_col, vector_col, label_col))
    classes = cut(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")))
    group = ["label", "dims"]
    sized = cut(_coded(classes))
    blocks = cut(sized.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    dealt = sized.join(F.broadcast(blocks) if blocks.count() <= BROADCAST_ROWS else blocks, group).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    schema, tile = "key binary, rep long, copies long, label string, dims int, low int, high int, block int, links long, root long, doubt boolean", [*group, "low", "high"]
    rough = cut(tiles.drop("blocks", "other").groupBy(*tile).applyInArrow(_tile(threshold, False), schema))
    whole = rough.where("doubt").drop("links", "root", "doubt").join(classes.select("key", "vector"), "key")
    fine = cut(whole.groupBy(*tile).applyInArrow(_tile(threshold, True), schema))
    found = rough.unionByName(fine).where("links > 0")
    reached = components(found.select("rep", "root"), "rep", "root")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = classes.select("key", "rep", "copies").join(counts, "key", "left").join(reached.withColumnRenamed("id", "rep"), "rep", "left")
    rest = known.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    known = cut(rest)
    drop(classes, sized, blocks, rough, fine)
    out = rows.select("id", "key").join(known, "key", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
