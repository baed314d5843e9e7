"""A registry of names that learns from batch to batch, and the people that questions speak of.

Rows are (name, kind, alias array, confidence, source, ambiguous, seen); a name has one row. ``entities.lookup`` reads it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import entity_candidates
from .entities import NAME_CONTEXTS, WORD_CONTEXTS, classify, contexts, signals
from .names import known_names

SCHEMA = "name string, kind string, alias array<string>, confidence double, source string, ambiguous boolean, seen long"
#: What goes before what where sources differ on a name.
SOURCES = ("onboarding", "confirmed", "learned")
#: The least confidence of a person that is learned.
LEAST = 0.75


def _row(name: Column, kind: str, alias: Column, confidence: Column, source: str, seen: Column) -> list[Column]:
    return [name.alias("name"), F.lit(kind).alias("kind"), alias.cast("array<string>").alias("alias"), confidence.cast("double").alias("confidence"), F.lit(source).alias("source"), seen.cast("long").alias("seen")]


def flagged(rows: DataFrame, common: DataFrame) -> DataFrame:
    """The rows with *ambiguous*: whether a person's name is a common word (common: word), whatever the case."""
    words = common.select(F.lower("word").alias("__w")).distinct()
    met = rows.join(words, F.lower("name") == F.col("__w"), "left")
    ambiguous = F.col("__w").isNotNull() & (F.col("kind") == "person")
    return met.select("name", "kind", "alias", "confidence", "source", ambiguous.alias("ambiguous"), "seen")


def seeded(people: DataFrame, projects: DataFrame, common: DataFrame) -> DataFrame:
    """The registry of what a user tells: people (name, alias or null) and projects (name). An alias is a name of its own, too."""
    one, whole = F.lit(1.0), F.lit(0)
    named = people.where(F.trim("name") != "").select(F.trim("name").alias("n"), F.nullif(F.trim("alias"), F.lit("")).alias("a"))
    full = named.groupBy("n").agg(F.array_sort(F.collect_set("a")).alias("as"))
    rows = full.select(*_row(F.col("n"), "person", F.col("as"), one, "onboarding", whole))
    short = named.where("a IS NOT NULL").groupBy("a").agg(F.array_sort(F.collect_set("n")).alias("ns")).select(*_row(F.col("a"), "person", F.col("ns"), one, "onboarding", whole))
    work = projects.where("name <> ''").select("name").distinct().select(*_row(F.col("name"), "project", F.array(), one, "onboarding", whole))
    return merged([flagged(rows.unionByName(short).unionByName(work), common)])


def merged(parts: list[DataFrame]) -> DataFrame:
    """One row for each name: that of the first source in SOURCES, then the surest, then the kind by name; aliases of all its rows, how often it was seen in all."""
    every = reduce(lambda a, b: a.unionByName(b), parts)
    order = reduce(lambda c, i: c.when(F.col("source") == SOURCES[i], i), range(len(SOURCES)), F.when(F.lit(False), -1)).otherwise(len(SOURCES))
    first = F.min(F.struct(order.alias("o"), (-F.col("confidence")).alias("c"), "kind", "source", "ambiguous"))
    out = every.groupBy("name").agg(first.alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("alias", F.array().cast("array<string>")))))).alias("alias"), F.sum("seen").alias("seen"))
    return out.select("name", "r.kind", "alias", (-F.col("r.c")).alias("confidence"), "r.source", "r.ambiguous", "seen")


def learned(registry: DataFrame, docs: DataFrame, common: DataFrame, least: float = LEAST, key: str = "id", text: str = "document", **patterns) -> DataFrame:
    """The registry and the people that a batch of texts shows, if it doesn't know their name: their signals must make them sure enough.

    *patterns* go to ``entities.signals``. A batch whose names are all known leaves the registry as it is, so a batch may be
    taken in again.
    """
    unknown = entity_candidates(docs, text=text).join(registry.select(F.col("name").alias("word")), "word", "left_anti")
    told = classify(unknown, signals(docs, unknown, key, text, **patterns)).where((F.col("type") == "person") & (F.col("confidence") >= least))
    new = told.select(*_row(F.col("word"), "person", F.array(), F.col("confidence"), "learned", F.col("n")))
    return merged([registry, flagged(new, common)])


def confirmed(registry: DataFrame, people: DataFrame, common: DataFrame) -> DataFrame:
    """The registry with people (name) that were looked up and found right."""
    new = people.where("name <> ''").select("name").distinct().select(*_row(F.col("name"), "person", F.array(), F.lit(0.9), "confirmed", F.lit(0)))
    return merged([registry, flagged(new, common)])


def people_in(questions: DataFrame, registry: DataFrame) -> DataFrame:
    """(qid, name): the people whose name, or an alias of any number of words, stands in a question (qid, question), whatever the case.

    A name that is a common word counts where the question shows more signs of a name than of the word.
    """
    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}_]+"), 0)
    person = registry.where("kind = 'person'")
    forms = person.select(F.col("name").alias("canonical"), "ambiguous", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("alias", F.array().cast("array<string>"))))).alias("name"))
    # A form is ambiguous if it is an ambiguous name itself.
    vague = person.where("ambiguous").select(F.lower("name").alias("__v")).distinct()
    asked = questions.select("qid", "question", words(F.col("question")).alias("__w"))
    met = known_names(asked, "__w", "qid", forms.select("name", words(F.col("name")).alias("__g")).distinct(), "__g")
    told = met.join(vague, F.lower("name") == F.col("__v"), "left").join(questions.select("qid", F.lower("question").alias("__q")), "qid")
    low = F.lower("name")
    sure = F.col("__v").isNull() | (contexts(low, F.col("__q"), NAME_CONTEXTS) > contexts(low, F.col("__q"), WORD_CONTEXTS))
    return told.where(sure).select("qid", "name").join(forms.select("name", "canonical"), "name").select("qid", F.col("canonical").alias("name")).distinct()
