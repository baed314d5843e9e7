"""Lexical ranking on a table of postings that is built once, at ingest, and read by term afterwards."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from .collection import top

#: Bytes of text for each bucket of an index, and the least and most buckets; a bucket has as many files as its bytes ask for.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 64 << 20, 8, 4096
#: Distinct terms of questions up to which the index is read by literal buckets and terms; more of them are joined.
LITERALS = 1000
#: Rows of questions' terms, or of questions, up to which they are broadcast, by count.
BROADCAST_ROWS = 100_000
#: Postings, and positions in them, of a batch that a task of the build holds, about; one text's stay together.
PIECE = 100_000


class Index(NamedTuple):
    """A written index: postings and terms (bucket, term, df), both by bucket and sorted by term; rows, mean length, buckets."""

    postings: DataFrame
    terms: DataFrame
    n: int
    average: float
    buckets: int


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, key: str = "id", text: str = "document") -> DataFrame:
    """(term, key, tf, dl, first) for every distinct token of every text; one row with a null term for a text without any.

    *first* marks one row of each text. A text's tokens are counted where it is read; nothing is shuffled. A null text counts as empty.
    """
    id_type = docs.schema[key].dataType.simpleString()
    token = regex.compile(TOKEN)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, terms, tfs, lengths, firsts = [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                found = Counter(token.findall((t.as_py() or "").lower()))
                n = max(1, len(found))
                index += [i] * n
                terms += list(found) or [None]
                tfs += list(found.values()) or [0]
                lengths += [sum(found.values())] * n
                firsts += [True] + [False] * (n - 1)
                if len(terms) >= PIECE or i == batch.num_rows - 1:
                    arrays = [pa.array(terms, pa.string()), batch.column(0).take(pa.array(index, pa.int64())), pa.array(tfs, pa.int64()), pa.array(lengths, pa.int64()), pa.array(firsts, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["term", key, "tf", "dl", "first"])
                    index, terms, tfs, lengths, firsts = [], [], [], [], []

    return docs.select(key, text).mapInArrow(counted, f"term string, `{key}` {id_type}, tf long, dl long, first boolean")


def write_index(made: DataFrame, docs: DataFrame, folder: str, text: str = "document") -> None:
    """Writes postings (term, ..., dl, first) and what is known of each term and of all texts below *folder*.

    Tasks write by bytes: rebalancing splits the buckets of frequent words and joins those of rare ones.
    """
    spark = made.sparkSession
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, size // BUCKET_BYTES))

    def write(rows: DataFrame, name: str) -> DataFrame:
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/{name}")
        return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema if f.name != 'bucket')}, bucket int").parquet(f"{folder}/{name}")

    written = write(made.withColumn("bucket", F.coalesce(bucket_of(F.col("term"), buckets), F.lit(0))), "postings")
    write(written.where("term IS NOT NULL").groupBy("bucket", "term").agg(F.count("*").alias("df")), "terms")
    written.where("first").agg(F.count("*").alias("n"), F.avg("dl").alias("average")).withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/statistics")


def build(docs: DataFrame, folder: str, key: str = "id", text: str = "document") -> None:
    """Writes the index of all texts below *folder*."""
    write_index(postings(docs, key, text), docs, folder, text)


def load(spark: SparkSession, folder: str) -> Index:
    told = spark.read.parquet(f"{folder}/statistics").first()
    return Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/terms"), told["n"], told["average"] or 0.0, told["buckets"])


def asked_of(index: Index, asked: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """The index's postings and terms of the questions' terms (term, ...), and whether the questions are few enough to be broadcast.

    Few distinct terms become literals, so that a scan opens their buckets only and skips row groups by term.
    """
    words = asked.groupBy(bucket_of(F.col("term"), index.buckets).alias("bucket"), "term").agg(F.count("*").alias("n"))
    some = words.limit(LITERALS + 1).collect()
    if len(some) <= LITERALS:
        among = F.col("bucket").isin(sorted({r["bucket"] for r in some})) & F.col("term").isin(sorted({r["term"] for r in some if r["term"] is not None}))
        return index.postings.where(among), index.terms.where(among), sum(r["n"] for r in some) <= BROADCAST_ROWS
    return *(t.join(words.drop("n"), ["bucket", "term"], "left_semi") for t in (index.postings, index.terms)), False


def alike(queries: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(qid, *by*): one question for all of the same words, the one with the smallest id; and (qid, form) that leads from each question to it."""
    first = queries.groupBy(by).agg(F.min("qid").alias("form"))
    same = queries.join(first, queries[by].eqNullSafe(first[by])).select("qid", "form").distinct()
    return first.select(F.col("form").alias("qid"), by), F.broadcast(same) if same.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else same


def for_all(found: DataFrame, same: DataFrame) -> DataFrame:
    """What was found for one question of each wording, for all of them."""
    return found.withColumnRenamed("qid", "form").join(same, "form").select(*found.columns)


def search(index: Index, queries: DataFrame, k: int | None = None, key: str = "id", k1: float = 1.5, b: float = 0.75, among: DataFrame | None = None) -> DataFrame:
    """(qid, key, bm25, rank): Okapi BM25 of every question (qid, terms) over the index; rows without a term are left out.

    The statistics are those of the whole index; *among* restricts the rows that may be found. Scores are ranked as
    rounded to six digits, then by key. Questions of the same terms are scored once. Postings are dealt by text before
    they meet the questions, so what is shuffled doesn't grow with the questions, and each task passes k rows a question.
    """
    forms, same = alike(queries.select("qid", F.array_sort(F.array_distinct("terms")).alias("terms")).where("terms IS NOT NULL"), "terms")
    asked = forms.select("qid", F.explode("terms").alias("term"))
    hit, words, few = asked_of(index, asked)
    if among is not None:
        hit = hit.join(among.select(key), key, "left_semi")
    idf = F.ln((F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = asked.join(words.drop("bucket"), "term").select("qid", "term", idf.alias("idf"))
    weights = F.broadcast(weights) if few else weights
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(index.average)))
    scored = hit.select("term", key, "tf", "dl").repartition(key).join(weights, "term").groupBy("qid", key).agg(F.sum(part).alias("bm25"))
    if k is None:
        return for_all(scored, same)
    return for_all(top(scored, k, [(F.floor(F.col("bm25") * 1e6 + 0.5)).desc(), F.col(key)], ["qid"]), same)
