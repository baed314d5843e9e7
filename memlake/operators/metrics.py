"""Retrieval and answer metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalised_answer, strip, tokens


def recall(ranked: DataFrame, k: int) -> DataFrame:
    """(qid, recall_any, recall_all) of rows (qid, rank, relevant); relevant rows beyond k are missed."""
    hit = F.col("relevant") & (F.col("rank") <= k)
    return ranked.groupBy("qid").agg(F.max(hit.cast("int")).alias("recall_any"), (F.count_if(hit) == F.count_if("relevant")).cast("int").alias("recall_all"), (F.count_if(hit) / F.greatest(F.count_if("relevant"), F.lit(1))).alias("recall"))


def ndcg(ranked: DataFrame, k: int) -> DataFrame:
    """NDCG@k whose ideal order is that of the retrieved rows alone; without relevant rows 0."""
    top = ranked.where(F.col("rank") <= k)
    gain = F.when(F.col("relevant"), 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    sums = top.groupBy("qid").agg(F.sum(gain).alias("dcg"), F.count_if("relevant").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1))
    return sums.select("qid", F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def token_f1(pairs: DataFrame, a: str, b: str, key: list[str]) -> DataFrame:
    """F1 of the two texts' tokens as multisets."""
    one = pairs.select(*key, F.explode(tokens(F.col(a))).alias("t"), F.lit(1).alias("x"), F.lit(0).alias("y"))
    two = pairs.select(*key, F.explode(tokens(F.col(b))).alias("t"), F.lit(0).alias("x"), F.lit(1).alias("y"))
    counts = one.unionByName(two).groupBy(*key, "t").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    sums = counts.groupBy(*key).agg(F.sum(F.least("x", "y")).alias("c"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    return sums.select(*key, F.when(F.col("c") > 0, 2.0 * F.col("c") / (F.col("x") + F.col("y"))).otherwise(0.0).alias("f1"))


def answer_f1(pairs: DataFrame, predicted: str, truth: str, key: list[str]) -> DataFrame:
    """(key, f1): F1 of the words of two answers, both normalised, as multisets; 1 if both are empty, 0 if one is. Null counts as empty."""
    words = lambda c: F.filter(F.split(normalised_answer(F.coalesce(c, F.lit(""))), " "), lambda w: w != "")
    rows = pairs.select(*key, words(F.col(predicted)).alias("__p"), words(F.col(truth)).alias("__t"))
    each = rows.select(*key, F.size("__p").alias("p"), F.size("__t").alias("t"), F.explode_outer(F.array_distinct("__p")).alias("w"), "__p", "__t")
    times = lambda words: F.size(F.filter(words, lambda x: x == F.col("w")))
    sums = each.withColumn("c", F.coalesce(F.least(times("__p"), times("__t")), F.lit(0))).groupBy(*key, "p", "t").agg(F.sum("c").alias("c"))
    f1 = F.when((F.col("p") == 0) | (F.col("t") == 0), (F.col("p") == F.col("t")).cast("double")).when(F.col("c") == 0, 0.0).otherwise(2.0 * F.col("c") / (F.col("p") + F.col("t")))
    return sums.select(*key, f1.alias("f1"))


def kendall_tau(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Tau of two rankings (qid, id, rank) over the items that both hold; the lists are top-k reports."""
    both = a.select("qid", key, F.col("rank").alias("ra")).join(b.select("qid", key, F.col("rank").alias("rb")), ["qid", key])
    left, right = both.alias("l"), both.alias("r")
    pairs = left.join(right, (F.col("l.qid") == F.col("r.qid")) & (F.col(f"l.{key}") < F.col(f"r.{key}")))
    sign = F.signum((F.col("l.ra") - F.col("r.ra")).cast("double")) * F.signum((F.col("l.rb") - F.col("r.rb")).cast("double"))
    return pairs.groupBy(F.col("l.qid").alias("qid")).agg((F.sum(sign) / F.count("*")).alias("tau"), F.count("*").alias("pairs"))


def evidence_recall(evidence: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(qid, recall): the share of each question's evidence ids (qid, evidence array) among the retrieved rows (qid, id); 1 without evidence."""
    want = evidence.select("qid", F.explode(F.array_distinct("evidence")).alias("id"))
    met = want.join(retrieved.select("qid", "id").distinct().withColumn("__hit", F.lit(1)), ["qid", "id"], "left").groupBy("qid").agg(F.avg(F.coalesce("__hit", F.lit(0))).alias("r"))
    return evidence.select("qid").join(met, "qid", "left").select("qid", F.coalesce("r", F.lit(1.0)).alias("recall"))


def evidence_sessions(evidence: Column) -> Column:
    """Sessions of dialog ids such as D3:7."""
    numbers = F.transform(evidence, lambda e: F.regexp_extract(e, r"^D(\d+):", 1))
    return F.array_distinct(F.transform(F.filter(numbers, lambda n: n != ""), lambda n: F.concat(F.lit("session_"), n)))


def message_recall(evidence: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(qid, recall): the share of evidence texts that hold, or lie within, a retrieved text of the question, case aside."""
    clean = lambda df, name: df.select("qid", F.lower(strip(F.col("text"))).alias(name)).distinct()
    found = F.contains("e", F.col("t")) | F.contains("t", F.col("e"))
    pairs = clean(evidence, "e").join(clean(retrieved, "t"), "qid", "left").groupBy("qid", "e").agg(F.max(F.coalesce(found, F.lit(False)).cast("int")).alias("hit"))
    return pairs.groupBy("qid").agg(F.avg("hit").alias("recall"))


def held_out(key: Column, share: int = 10) -> Column:
    """Whether a key belongs to the held-out nine of ten (1 - 1/share), by its digest; the same at any size and order."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % share != 0


def recall_report(recalls: DataFrame, category: str = "category") -> DataFrame:
    """(category, n, average, perfect, partial, zero) of rows (category, recall); the row without category is over all."""
    r = F.col("recall")
    sums = [F.count("*").alias("n"), F.avg(r).alias("average"), F.count_if(r >= 1).alias("perfect"), F.count_if((r > 0) & (r < 1)).alias("partial"), F.count_if(r <= 0).alias("zero")]
    return recalls.groupingSets([[F.col(category)], []], F.col(category)).agg(*sums)
