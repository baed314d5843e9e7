"""Language identification: averaged hashed subword embeddings and a linear softmax (operator 10).

A text's subwords are the n-grams (ORDERS bytes of UTF-8) of its lower-cased words, with one mark before and after each
word; none reaches beyond its word. Each is hashed to a bucket with an embedding, the text's vector is their mean, and a
softmax layer gives the languages. Embeddings and layer are trained by stochastic gradient descent in numpy, on about
SAMPLE labelled documents and SAMPLE_BYTES of text at most (whole texts, chosen by a hash of the id). A fifth of the
sample sets the temperature of the softmax and the score below which a document is rejected: there, no more than REJECT
of the rightly predicted documents fall below it.

As the layer is linear, embedding and layer are multiplied once, and a text's scores are a mean of table rows. All texts
of a batch are scored together, from one flat array of bytes.
A text that is null or has no letter (Unicode category L) is ``und`` with score 0. Without any labelled row all texts are
``und``. Of languages with equal scores the first by name is taken. Repeated rows get equal results; in training each
counts. Texts are scored whole; a very long one is scored alone. An empty table gives no rows. The input's other columns
may have any names.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, rewrite_texts
from .quality import held_out

BUCKETS = 1 << 16
WIDTH = 16
ORDERS = (2, 3, 4, 5)
#: Training takes about so many documents, and about so many bytes of text, at most.
SAMPLE = 3000
SAMPLE_BYTES = 64 << 20
EPOCHS = 5
RATE = 0.5
#: The share of the rightly predicted calibration documents that may score below the threshold: of about 600, one.
REJECT = 0.003
AT_ONCE = 1 << 19
_WORDLIKE = re.compile(r"[^\W\d_]")
#: Bytes that count as parts of words; all others are word boundaries, turned to spaces.
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    """Whether a character of Unicode's category L stands in the text; numbers such as superscripts are none."""
    return text is not None and any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def subwords(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the bucket of every byte position (BUCKETS where no n-gram stands), and the texts' starts."""
    data = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " * max(ORDERS) for t in texts]
    starts = np.cumsum([0, *map(len, data)])[:-1]
    raw = _FOLD[np.frombuffer(b"".join(data), dtype=np.uint8)]
    space = raw == 32
    h = raw.astype(np.uint32) + np.uint32(7)
    out, valid = [], np.ones(len(raw), dtype=bool)
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(0x9E3779B1) + raw[n - 1 :]
        if n > 2:
            valid = valid[:-1] & ~space[n - 2 : -1]
        else:
            valid = ~(space[:-1] & space[1:])
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
            bucket = np.full(len(raw), BUCKETS, dtype=np.int32)
            bucket[: len(h)] = np.where(valid, mixed >> np.uint32(16), BUCKETS)
            out.append(bucket)
    return out, starts


class Model:
    def __init__(self, table: np.ndarray, bias: np.ndarray, languages: list[str], temperature: float, threshold: float):
        self.languages, self.bias, self.temperature, self.threshold = languages, bias, temperature, threshold
        self.table = np.zeros((len(languages) + 1, BUCKETS + 1), dtype=np.float32)
        self.table[:-1, :BUCKETS] = table.T
        self.table[-1, :BUCKETS] = 1

    def logits(self, texts: list[str]) -> np.ndarray:
        """Scores of every language; the flat arrays hold about AT_ONCE characters at a time, a longer text alone and whole."""
        group = np.cumsum([len(t) for t in texts]) // AT_ONCE
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        return np.concatenate([self._flat(texts[a:b]) for a, b in zip(bounds, bounds[1:])])

    def _flat(self, texts: list[str]) -> np.ndarray:
        orders, starts = subwords(texts)
        sums = np.zeros((len(self.languages) + 1, len(texts)))
        for bucket in orders:
            for k, column in enumerate(self.table):
                sums[k] += np.add.reduceat(column[bucket], starts, dtype=np.float64)
        return (sums[:-1] / np.maximum(sums[-1], 1)).T + self.bias

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        known = [has_letter(t) for t in texts]
        p = softmax(self.logits([t or "" for t in texts]) / self.temperature)
        best = p.argmax(axis=1)
        return [self.languages[b] if k else "und" for b, k in zip(best, known)], np.where(known, p.max(axis=1), 0.0).tolist()


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and their counts; none without a letter."""
    if not has_letter(text):
        return np.zeros(0, dtype=np.uint16), np.zeros(0, dtype=np.int32)
    grams = np.concatenate(subwords([text])[0])
    grams, counts = np.unique(grams[grams < BUCKETS], return_counts=True)
    return grams.astype(np.uint16), counts.astype(np.int32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> Model:
    """Stochastic gradient descent over documents in a fixed shuffled order, then calibration on every fifth."""
    languages = sorted(set(langs))
    if not languages:
        return Model(np.zeros((BUCKETS, 0)), np.zeros(0), [], 1.0, 0.0)
    target = {k: i for i, k in enumerate(languages)}
    r = np.random.default_rng(10)
    ys = [target[k] for b, k in zip(bags, langs) if len(b[0])]
    bags = [b for b in bags if len(b[0])]
    held = np.arange(len(ys)) % 5 == 4
    embed, layer, bias = r.normal(0, 0.1, (BUCKETS, WIDTH)), np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    own = np.flatnonzero(~held)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in r.permutation(own):
            grams, counts = bags[i]
            share = counts / counts.sum()
            h = share @ embed[grams]
            z = h @ layer + bias
            g = -np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            g[ys[i]] += 1
            back = layer @ g
            layer += rate * np.outer(h, g)
            bias += 0.1 * rate * g
            embed[grams] += rate * np.outer(share * len(share) ** 0.5, back)
    model = Model(embed @ layer, bias, languages, 1.0, 0.0)
    sample = np.flatnonzero(held)
    if len(sample):
        z = np.stack([model.table[:-1, g].astype(float) @ (c / c.sum()) + bias for g, c in (bags[i] for i in sample)])
        y = np.array(ys)[sample]
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 40), key=loss))
        p = softmax(z / model.temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
        if len(right):
            model.threshold = float(right[int(REJECT * len(right))]) * (1 - 1e-6)
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Trains on documents with a language that are not held out; about *sample* of them if there are more.

    The share of documents that is taken keeps both bounds, of rows and of bytes, as an expectation.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, 5, 0))
    total, size = usable.agg(F.count("*"), F.sum(F.octet_length(text_col).cast("long"))).first()
    scale = 1 << 40
    share = min(scale, sample * scale // max(1, total), SAMPLE_BYTES * scale // max(1, size or 0))
    chosen = usable.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(scale)) < share).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))

    def counted(texts: list[str | None]) -> list:
        bags = [bag(t) for t in texts]
        return [[g.tobytes() for g, _ in bags], [c.tobytes() for _, c in bags]]

    # Texts stay on the executors; the driver gets six bytes for each distinct bucket of a text.
    rows = map_texts(chosen, ["i", "l"], "t", counted, [("grams", "binary"), ("counts", "binary")]).collect()
    rows = sorted(rows, key=lambda r: (zlib.crc32(r["i"].encode()), r["i"], r["l"], r["grams"], r["counts"]))
    return train([(np.frombuffer(r["grams"], dtype=np.uint16), np.frombuffer(r["counts"], dtype=np.int32)) for r in rows], [r["l"] for r in rows])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, whether it is held out, predicted language, score, and whether it is rejected."""
    model = fit(docs, id_col, text_col, lang_col)

    def predicted(texts: list[str | None]) -> list:
        langs, scores = model(texts)
        return [langs, scores, [k == "und" or s < model.threshold for k, s in zip(langs, scores)]]

    out = map_texts(docs, [id_col], text_col, predicted, [("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")])
    return out.select(id_col, held_out(id_col, 5, 0).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that are not rejected, all columns as they came."""
    model = fit(docs, id_col, text_col, lang_col)

    def keep(texts: list[str | None]) -> tuple[list[bool], None]:
        langs, scores = model(texts)
        return [k != "und" and s >= model.threshold for k, s in zip(langs, scores)], None

    return rewrite_texts(docs, text_col, keep)
