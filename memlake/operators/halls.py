"""Halls of sessions and questions, and the ranking in two passes that goes by them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import overlap
from .search import nearest

PREFERENCES, ASSISTANT, EVENTS, FACTS, GENERAL = "preferences", "assistant", "events", "facts", "general"

#: Signals of sessions by hall, with how many must occur and whose words count.
SESSION_SIGNALS = {
    PREFERENCES: ["i prefer", "i usually", "i've been having trouble", "i've been feeling", "i've been struggling", "i want to", "i'm worried", "i've been thinking", "i've been considering", "lately i", "recently i", "i tend to"],
    ASSISTANT: ["i suggest", "i recommend", "here are", "you might want to", "option 1", "option 2", "1.", "2.", "3.", "first,", "second,", "you could try", "i would recommend", "my recommendation"],
    EVENTS: ["milestone", "graduation", "promotion", "anniversary", "birthday", "moved", "started", "finished", "completed", "launched", "opened", "achieved", "won", "accepted", "hired", "married", "born"],
    FACTS: ["degree", "major", "university", "college", "job", "position", "role", "company", "city", "country", "street", "born in", "grew up", "studied", "works at", "lives in", "years old", "salary", "budget"],
}
LEAST = {PREFERENCES: 1, ASSISTANT: 2, EVENTS: 1, FACTS: 2}
#: Signals of questions, and the halls to look in, best first.
QUESTION_SIGNALS = {
    ASSISTANT: ["you suggested", "you told me", "you mentioned", "you said", "you recommended", "you provided", "you listed", "you gave", "remind me what you", "you came up with", "you explained"],
    PREFERENCES: ["i've been having trouble", "i've been feeling", "i prefer", "i usually", "battery", "nostalgic", "reunion", "lately", "recently been", "struggling with"],
    EVENTS: ["milestone", "when did", "what happened", "achievement", "ago", "last week", "last month", "last year", "four weeks", "three months"],
    FACTS: ["degree", "study", "graduate", "major", "job", "work", "live", "born", "city", "country", "company", "school"],
}
TARGETS = {ASSISTANT: [ASSISTANT, GENERAL], PREFERENCES: [PREFERENCES, GENERAL], EVENTS: [EVENTS, FACTS, GENERAL], FACTS: [FACTS, GENERAL]}
#: Factors of distance for the first hall, the other ones, and rows that the first pass found; rows it keeps.
FIRST, OTHER, FOUND, PASS = 0.75, 0.90, 0.85, 10


def _count(low: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words])


def session_hall(user: Column, assistant: Column) -> Column:
    """The first hall whose signals occur often enough; preferences count in the user's words, advice in the assistant's, the rest in both."""
    u, a = F.lower(F.coalesce(user, F.lit(""))), F.lower(F.coalesce(assistant, F.lit("")))
    where = {PREFERENCES: u, ASSISTANT: a, EVENTS: F.concat(u, a), FACTS: F.concat(u, a)}
    out = None
    for hall, words in SESSION_SIGNALS.items():
        met = _count(where[hall], words) >= LEAST[hall]
        out = F.when(met, hall) if out is None else out.when(met, hall)
    return out.otherwise(GENERAL)


def sessions(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, user_text, assistant_text, hall) of conversations: each side's turns in order, joined by spaces."""
    side = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct(F.col(order).alias("i"), F.col("text").alias("t"))))), lambda x: x["t"]), " ")
    return turns.groupBy(key).agg(side("user").alias("user_text"), side("assistant").alias("assistant_text")).withColumn("hall", session_hall(F.col("user_text"), F.col("assistant_text")))


def question_halls(question: Column) -> Column:
    low = F.lower(question)
    out = None
    for hall, words in QUESTION_SIGNALS.items():
        value = F.array(*map(F.lit, TARGETS[hall]))
        out = F.when(_count(low, words) > 0, value) if out is None else out.when(_count(low, words) > 0, value)
    return out.otherwise(F.array(F.lit(GENERAL)))


def two_pass(rows: DataFrame, queries: DataFrame, halls: list[str], keywords: list[str], k: int = 50, weight: float = 0.30, key: str = "id") -> DataFrame:
    """The k nearest rows (embedding, document, hall) of every question with their weighed distance, as *score*.

    The first pass finds the ten nearest rows of the questions' first hall, unless that is the general one; the second
    all rows. A row whose id is the question's own does not count.
    """
    near = nearest(rows, queries, k, key=key, others=True)
    first = halls[0] != GENERAL
    found = nearest(rows.where((F.col("hall") == halls[0]) & F.lit(first)), queries, PASS, key=key, others=True).select("qid", key, F.lit(FOUND).alias("__f"))
    hall = F.when(F.lit(first) & (F.col("hall") == halls[0]), FIRST).when(F.col("hall").isin(*halls), OTHER).otherwise(1.0)
    scored = near.join(found, ["qid", key], "left").join(rows.drop("embedding"), key)
    score = F.col("distance") * (1.0 - weight * overlap(F.col("document"), keywords)) * hall * F.coalesce("__f", F.lit(1.0))
    return scored.withColumn("score", score).drop("__f")
