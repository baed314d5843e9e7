"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration (operator 5).

Each document becomes STATISTICS of its whole text. After standardising, FEATURES random cosines approximate a Gaussian
kernel. Each partition sums its share of the normal equations; the shares are added by matrix row, so nothing but the
final FEATURES + 1 rows reaches the driver, however many partitions there are. Scores of a held-back third of the
labelled rows, counted in BINS, fit the isotonic map to the probability of label 1.

Null and empty texts have statistics of their own (all counts 0) and get a score like any other. A document whose label
is null or missing is not learned from; repeated label rows count once each. With no labelled rows every score is 0.5.
Equal statistics, repeated rows among them, get equal scores. Texts are read whole, of any length; an empty table gives
no rows. Columns are taken by name and position, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import apply, isotonic
from .common import cut, map_texts, rewrite_texts

FEATURES = 192
RIDGE = 1.0
WIDTH = 4.0
BINS = 512
#: Partial sums that one task adds at a time.
GROUP = 256
SEED = 5
#: A document counts as good from this score on.
THRESHOLD = 0.7

_PUNCTUATION = np.array([chr(i) in ".,;:!?'\"()-" for i in range(256)])
_SYMBOL = np.array([chr(i) in "#$%&*|<>{}[]\\/^~_=+@`" for i in range(256)])
_DIGIT = np.array([48 <= i < 58 for i in range(256)])
_UPPER = np.array([65 <= i < 91 for i in range(256)])
_LOWER = np.array([97 <= i < 123 for i in range(256)])
_SPACE = np.array([chr(i) in " \t\n\r\v\f" for i in range(256)])
_MASKS = np.stack([_PUNCTUATION, _SYMBOL, _DIGIT, _UPPER, _LOWER, _SPACE, np.arange(256) >= 128], axis=1).astype(float)
STATISTICS = 26


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text; all of them finite."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256).astype(float)
    shares = np.sqrt(counts @ _MASKS / n).tolist()
    p = counts[counts > 0] / n
    words = data.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    lines = data.split(b"\n")
    filled = [x for x in lines if x.strip()]
    kinds = len(set(words))
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 0
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        *shares,
        float(-(p * np.log(p)).sum()) if len(p) else 0.0,
        float(lengths.mean()),
        float(lengths.std()),
        float(np.log1p(lengths.max())),
        kinds / w,
        pairs / w,
        float(np.log1p(w / max(1, kinds))),
        len(set(filled)) / max(1, len(filled)),
        float(np.log1p(len(filled))),
        float(np.log1p(len(data) / max(1, len(filled)))),
        np.sqrt(data.count(b"!") / w),
        np.sqrt(data.count(b"|") / w),
        np.sqrt(data.count(b".") / w),
        np.sqrt(data.count(b",") / w),
        sum(map(bytes.istitle, words)) / w,
        float((lengths <= 2).mean()),
        float(len(data) == 0),
    ]


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, stats array<double>) of every document."""
    return map_texts(docs, [id_col], text_col, lambda texts: [[statistics(t) for t in texts]], [("stats", "array<double>")])


class Fourier:
    """Standardised statistics to random cosines."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        r = np.random.default_rng(SEED)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.w = r.normal(0, 1 / WIDTH, (STATISTICS, FEATURES))
        self.b = r.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))], axis=1)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def normal_equations(learned: DataFrame, map_of: Fourier) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y over all rows of (stats, y): summed in each partition, then by matrix row over GROUP partitions at a time.

    A group of the first addition gets a row from each of about a GROUP-th of the partitions, one of the second GROUP rows.
    """
    d = FEATURES + 1

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for batch in batches:
            if batch.num_rows:
                x = map_of(_matrix(batch, "stats"))
                y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False).astype(float)
                total += np.concatenate([x, np.ones((len(x), 1))], axis=1)[:, :d].T @ np.column_stack([x, y])
        if total.any():
            own = TaskContext.get().partitionId() % GROUP
            yield pa.RecordBatch.from_arrays([pa.array(range(d), type=pa.int32()), pa.array([own] * d, type=pa.int32()), pa.array(total.tolist(), type=pa.list_(pa.float64()))], names=["row", "part", "sums"])

    def added(table: pa.Table) -> pa.Table:
        sums = np.array(table.column("sums").to_pylist()).sum(axis=0)
        return table.slice(0, 1).set_column(2, "sums", pa.array([sums.tolist()], type=pa.list_(pa.float64())))

    schema = "row int, part int, sums array<double>"
    rows = learned.select("stats", "y").mapInArrow(summed, schema).groupBy("row", "part").applyInArrow(added, schema).groupBy("row").applyInArrow(added, schema).collect()
    total = np.zeros((d, d + 1))
    for r in rows:
        total[r["row"]] = r["sums"]
    return total[:, :d], total[:, d]


class Model:
    """What scoring needs; plain arrays, so it can be sent to every task."""

    def __init__(self, map_of: Fourier | None, weights: np.ndarray | None, knots: np.ndarray, values: np.ndarray):
        self.map_of, self.weights, self.knots, self.values = map_of, weights, knots, values

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.map_of(x) @ self.weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return apply(self.knots, self.values, self.raw(x))


def fit(stats: DataFrame, labels: DataFrame, id_col: str, label_id: str = "doc_id", label_col: str = "quality") -> Model:
    """Fits on the rows of *stats* that *labels* marks 0 or 1."""
    marked = labels.select(F.col(label_id).alias("__id"), F.col(label_col).cast("double").alias("y")).where("y in (0, 1) and __id is not null")
    joined = stats.join(marked, stats[id_col] == marked["__id"]).select(F.col("__id"), "stats", "y")
    joined = cut(joined.withColumn("held", F.pmod(F.xxhash64("__id"), F.lit(3)) == 0))
    moments = joined.select("y", F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    if not moments:
        return Model(None, None, np.array([0.0]), np.array([0.5]))
    mean, scale = np.zeros(STATISTICS), np.ones(STATISTICS)
    for r in moments:
        mean[r["i"]], scale[r["i"]] = r["m"], r["s"]
    map_of = Fourier(mean, scale)
    a, b = normal_equations(joined.where("not held"), map_of)
    weights = np.linalg.solve(a + RIDGE * np.eye(len(a)), b)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = map_of(_matrix(batch, "stats")) @ weights
                bins = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(raw), batch.column(batch.schema.get_field_index("y")).cast(pa.float64())], names=["bin", "raw", "y"])

    counted = joined.where("held").select("stats", "y").mapInArrow(binned, "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("x"), F.sum("y").alias("p"), F.count("*").alias("n")).collect()
    if not counted:
        return Model(map_of, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    x, p, n = (np.array([float(r[k]) for r in counted]) for k in ("x", "p", "n"))
    return Model(map_of, weights, *isotonic(x, p, n))


def held_out(id_col: str, folds: int, fold: int):
    """True where crc32 of the id as text falls in the fold that is never learned from; an id of null is learned from no label anyway."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, whether it is held out, score and prediction."""
    stats = cut(document_statistics(docs, id_col, text_col))
    learned = stats.where(~held_out(id_col, 4, 2))
    fitted = fit(learned, labels, id_col)
    id_type = stats.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = fitted(_matrix(batch, "stats"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[id_col, "score", "predicted"])

    out = stats.select(id_col, "stats").mapInArrow(scored, f"`{id_col}` {id_type}, score double, predicted int")
    return out.select(id_col, held_out(id_col, 4, 2).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score at least *threshold*, all columns as they came."""
    # Statistics are joined to the labels, not texts: a text is never shuffled, at the price of scoring from it again.
    fitted = fit(document_statistics(docs.where(~held_out(id_col, 4, 2)), id_col, text_col), labels, id_col)
    return rewrite_texts(docs, text_col, lambda texts: ((fitted(np.array([statistics(t) for t in texts])) >= threshold).tolist(), None))
