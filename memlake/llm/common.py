"""What the operators of this subpackage share: Arrow mapping of whole texts, lineage cuts, word hashes."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import shared_folder

#: Bytes of text that one call of a mapped function sees; a longer text comes alone and whole.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise *df* in the folder that the cluster names in ``spark.checkpoint.dir``; it survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables made by ``cut`` that nothing reads any more."""
    for df in tables:
        plan = df._jdf.queryExecution().logical()
        file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
        if file is not None and file.isDefined():
            delete(df.sparkSession, file.get())


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into row ranges whose text column holds about *most* bytes."""
    if not batch.num_rows:
        return
    sizes = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    group = np.cumsum(sizes) // most
    starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def map_texts(df: DataFrame, keep: list[str], text_col: str, fn: Callable[[list[str | None]], list], fields: list[tuple[str, str]]) -> DataFrame:
    """Returns the *keep* columns and those that *fn* makes of the whole texts, in Arrow batches.

    *fn* takes a list of texts (null as None) and returns one list, numpy or Arrow array per field.
    Columns are taken by position, so the input's other columns may have any names.
    """
    chosen = df.select(*[df[c] for c in keep], df[text_col].alias("__text"))
    kept = T.StructType([T.StructField(c, df.schema[c].dataType) for c in keep])
    schema = T.StructType(kept.fields + T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields)).fields)
    at = len(keep)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, at):
                made = fn(part.column(at).to_pylist())
                columns = [part.column(i) for i in range(at)] + [x if isinstance(x, pa.Array) else pa.array(x, type=out.field(at + i).type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    return chosen.mapInArrow(mapped, schema)


def rewrite_texts(df: DataFrame, text_col: str, fn: Callable[[list[str | None]], tuple[list[bool], list[str | None] | None]], length_col: str | None = None) -> DataFrame:
    """Keeps the rows for which *fn* says so, with the texts that it returns (None: as they were), all columns as they came."""
    at, names = df.columns.index(text_col), df.columns
    long_at = names.index(length_col) if length_col in names else None
    schema = df.schema

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                before = part.column(at).to_pylist()
                keep, texts = fn(before)
                columns = list(part.columns)
                if texts is not None:
                    columns[at] = pa.array(texts, type=columns[at].type)
                    if long_at is not None:
                        lengths = [n if a == b else len(b) for n, a, b in zip(columns[long_at].to_pylist(), before, texts)]
                        columns[long_at] = pa.array(lengths, type=columns[long_at].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(keep, type=pa.bool_()))

    return df.mapInArrow(mapped, schema)


# --- spans -----------------------------------------------------------------------------------------------------------


def union_of(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches, in order, that the spans cover."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if starts and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def is_free(taken: tuple[list[int], list[int]], a: int, b: int) -> bool:
    """Whether a:b meets none of the stretches of ``union_of``."""
    i = bisect_left(taken[0], b)
    return i == 0 or taken[1][i - 1] <= a


# --- hashes of words -------------------------------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective mixer of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the maximal runs of bytes for which the 256-entry mask *is_word* is true."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=np.uint64)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = is_word[raw]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _power_table(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return starts, ends, mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
