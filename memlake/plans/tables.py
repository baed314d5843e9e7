"""The driver's tables in the shapes that the operators take, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fulltext, inverted, lexical
from ..session import shared_folder


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drawers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("document"),
        F.col("lang").alias("wing"),
        F.col("source").alias("room"),
        F.concat(F.lit("f"), F.expr("doc_id div 5")).alias("source_file"),
        (F.col("doc_id") % 5).cast("int").alias("chunk_index"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int")), "yyyy-MM-dd").alias("occurred_at"),
        F.concat(F.lit("h"), F.col("n_chars") % 3).alias("hall"),
        "n_chars",
    )


D = """d AS (SELECT doc_id AS id, text AS document, lang AS wing, source AS room, 'f' || CAST(doc_id // 5 AS VARCHAR) AS source_file,
 CAST(doc_id % 5 AS INTEGER) AS chunk_index, strftime(DATE '2024-01-01' + CAST(doc_id % 366 AS INTEGER), '%Y-%m-%d') AS occurred_at,
 'h' || CAST(n_chars % 3 AS VARCHAR) AS hall, n_chars FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")


V = "v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question, embedding): every vector whose id is divisible by 50, with a passage of the benchmark as its words."""
    v = vectors(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")
    b = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    return v.join(b, F.col("item_id") == F.col("qid") % 40, "left").select("qid", F.coalesce("question", F.lit("")).alias("question"), "embedding")


Q = """q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS qe, coalesce(b.text, '') AS question FROM embeddings LEFT JOIN benchmark b ON b.item_id = vec_id % 40 WHERE vec_id % 50 = 0)"""

_indexes: dict[tuple, str] = {}


def _index(spark: SparkSession, sf_dir: str, kind, of=drawers, name: str = "documents") -> str:
    """The folder of an index, built by the first query of a session that needs it; another one if the table's files change."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    status, content = system.getFileStatus(path), system.getContentSummary(path)
    key = (kind.__name__, spark.sparkContext.applicationId, sf_dir, status.getModificationTime(), content.getLength())
    if key not in _indexes:
        folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        kind.build(of(spark, sf_dir), folder)
        _indexes[key] = folder
    return _indexes[key]


def lexical_index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """Postings for BM25."""
    return lexical.load(spark, _index(spark, sf_dir, lexical))


def fulltext_index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """Postings with positions of stems."""
    return lexical.load(spark, _index(spark, sf_dir, fulltext))


def vector_lists(spark: SparkSession, sf_dir: str) -> inverted.Lists:
    """Inverted lists of all vectors."""
    return inverted.load(spark, _index(spark, sf_dir, inverted, vectors, "embeddings"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a fact about its user until the user's next event of the type."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    e = read(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("subject"),
        F.col("event_type").alias("predicate"),
        F.concat(F.lit("k"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("none"))).alias("object"),
        day(F.col("ts")).alias("valid_from"),
        day(F.lead("ts").over(w)).alias("valid_to"),
    )


K = """t AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS subject, event_type AS predicate, 'k' || coalesce(json_extract_string(props, '$.k'), 'none') AS object,
 strftime(ts, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), '%Y-%m-%d %H:%M:%S') AS valid_to FROM events),
n AS (SELECT DISTINCT subject AS id, upper(subject) AS name FROM t UNION SELECT DISTINCT object, upper(object) FROM t)"""


def entities(of: DataFrame) -> DataFrame:
    ids = of.select(F.col("subject").alias("id")).union(of.select(F.col("object").alias("id"))).distinct()
    return ids.select("id", F.upper("id").alias("name"))
