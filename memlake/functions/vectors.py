"""Column functions on vectors held as arrays; all arithmetic is in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine, from 0 to 2; null if a vector is zero."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(n > 0, F.lit(1.0) - dot(a, b) / n)


def _distances(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosine distances of two columns of vectors, row by row; null where one has no direction or their lengths differ."""
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (a, b)]
    out = np.full(len(a), np.nan)
    for dims in np.unique(sizes[0][(sizes[0] == sizes[1]) & (sizes[0] > 0)]).tolist():
        at = np.flatnonzero((sizes[0] == dims) & (sizes[1] == dims))
        x, y = (v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims) for v in (a, b))
        with np.errstate(all="ignore"):
            out[at] = 1.0 - (x * y).sum(axis=1) / (np.sqrt((x**2).sum(axis=1)) * np.sqrt((y**2).sum(axis=1)))
    return pa.array(out, mask=~np.isfinite(out))


def packed_distance(a: Column, b: Column) -> Column:
    """Cosine distance of two columns of vectors, a batch of rows as one product of arrays; null where there is none."""
    return F.arrow_udf(_distances, "double")(a.cast("array<double>"), b.cast("array<double>"))
