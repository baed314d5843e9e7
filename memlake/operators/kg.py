"""Temporal triples: (subject, predicate, object, valid_from, valid_to) with dates as ISO strings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entity_id, trigram_similarity
from ..session import shared_folder
from .entities import claims


def valid_at(t: str | None) -> Column:
    """Both ends count; open ends are unbounded; dates compare as strings."""
    if t is None:
        return F.lit(True)
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= t))


def named(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """With both names; a triple whose ends have no entity row is left out."""
    s = entities.select(F.col("id").alias("subject"), F.col("name").alias("subject_name"))
    o = entities.select(F.col("id").alias("object"), F.col("name").alias("object_name"))
    return triples.join(s, "subject").join(o, "object")


def query_entity(triples: DataFrame, entities: DataFrame, entity: str, as_of: str | None = None, direction: str = "both") -> DataFrame:
    """Facts about an entity; a fact that points at itself shows in both directions."""
    facts = triples.where(valid_at(as_of))
    columns = ["direction", "predicate", "other", "valid_from", "valid_to", "current"]
    parts = []
    for way, own, far in (("outgoing", "subject", "object"), ("incoming", "object", "subject")):
        if direction in (way, "both"):
            e = entities.select(F.col("id").alias(far), F.col("name").alias("other"))
            parts.append(facts.where(F.col(own) == entity).join(e, far).select(F.lit(way).alias("direction"), "predicate", "other", "valid_from", "valid_to", F.col("valid_to").isNull().alias("current")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select(*columns)


def query_relationship(triples: DataFrame, entities: DataFrame, subject: str | None = None, predicate: str | None = None, obj: str | None = None, as_of: str | None = None) -> DataFrame:
    facts = triples.where(valid_at(as_of))
    for column, value in (("subject", subject), ("predicate", predicate), ("object", obj)):
        facts = facts if value is None else facts.where(F.col(column) == value)
    return named(facts, entities)


def timeline(triples: DataFrame, entities: DataFrame, entity: str | None = None, limit: int = 100) -> DataFrame:
    facts = triples if entity is None else triples.where((F.col("subject") == entity) | (F.col("object") == entity))
    return named(facts, entities).orderBy(F.col("valid_from").asc_nulls_last(), "subject", "predicate", "object").limit(limit)


def stats(triples: DataFrame, entities: DataFrame) -> DataFrame:
    t = triples.agg(F.count("*").alias("triples"), F.count_if(F.col("valid_to").isNull()).alias("current"), F.count_if(F.col("valid_to").isNotNull()).alias("expired"), F.array_join(F.array_sort(F.collect_set("predicate")), ",").alias("predicates"))
    return entities.agg(F.count("*").alias("entities")).join(t)


def invalidate(triples: DataFrame, match: Column, ended: str) -> DataFrame:
    """Closes open triples that match."""
    return triples.withColumn("valid_to", F.when(match & F.col("valid_to").isNull(), F.lit(ended)).otherwise(F.col("valid_to")))


def add_triples(triples: DataFrame, new: DataFrame) -> DataFrame:
    """Appends new facts but those of which an equal open one is there; of equal new ones an open one is the one that counts.

    It begins with the earliest of them; without an open one the last to end is taken whole.
    """
    key = ["subject", "predicate", "object"]
    open_ = F.max(F.col("valid_to").isNull())
    last = F.max(F.struct(F.col("valid_to").alias("t"), F.col("valid_from").alias("f")))
    first = F.min(F.when(F.col("valid_to").isNull(), F.col("valid_from")))
    fresh = new.groupBy(*key).agg(F.when(open_, first).otherwise(last["f"]).alias("valid_from"), F.when(~open_, last["t"]).alias("valid_to"))
    return triples.unionByName(fresh.join(triples.where("valid_to is null").select(*key), key, "left_anti"))


def with_entities(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """The entities (id, name) with a row for every end of a triple that had none, named by its id."""
    ends = triples.select(F.explode(F.array("subject", "object")).alias("id")).where("id is not null").distinct()
    return entities.select("id", "name").unionByName(ends.join(entities, "id", "left_anti").select("id", F.col("id").alias("name")))


def triple_id(subject, predicate, obj, valid_from):
    """The id of a fact: its parts and a short digest that also covers its beginning."""
    parts = F.concat_ws("_", subject, predicate, obj)
    return F.concat(F.lit("t_"), parts, F.lit("_"), F.substring(F.sha2(F.concat(parts, F.coalesce(valid_from, F.lit(""))), 256), 1, 12))


def rename(triples: DataFrame, old: str, new: str) -> DataFrame:
    return triples.withColumns({c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c)) for c in ("subject", "object")})


def similar_names(entities: DataFrame, name: str, least: float = 0.3, limit: int = 10) -> DataFrame:
    score = trigram_similarity(F.col("name"), F.lit(name))
    return entities.withColumn("similarity", score).where(F.col("similarity") >= least).orderBy(F.col("similarity").desc(), "id").limit(limit)


def mismatches(claims: DataFrame, triples: DataFrame) -> DataFrame:
    """Claims whose subject and object are known under other predicates only."""
    t = triples.select("subject", "object", F.col("predicate").alias("known")).distinct()
    return claims.join(t, ["subject", "object"]).where(F.col("known") != F.col("predicate")).join(t.withColumnRenamed("known", "predicate"), ["subject", "object", "predicate"], "left_anti")


def stale(claims: DataFrame, triples: DataFrame, today: str) -> DataFrame:
    """Claims whose exact triple has ended before *today*."""
    ended = triples.groupBy("subject", "predicate", "object").agg(F.max(F.coalesce("valid_to", F.lit("9999-12-31"))).alias("valid_to")).where(F.col("valid_to") < today)
    return claims.join(ended, ["subject", "predicate", "object"])


def confusable(mentioned: DataFrame, registry: DataFrame, most: int = 2) -> DataFrame:
    """Registered names within a small edit distance of a mentioned one, of which the text says nothing itself.

    *mentioned* holds (name) or (id, name) for many texts. Names that can be that near share one of the keys of their
    deletions: all strings that up to *most* deletions leave. So pairs are found by equality of keys and checked then,
    once for each distinct name, however many texts mention it. What a text says itself is looked up only for texts of
    several names, as a name isn't near itself.
    """
    by = [c for c in mentioned.columns if c != "name"]
    keys = lambda x: reduce(lambda a, _: F.array_distinct(F.flatten(F.transform(a, lambda y: F.concat(F.array(y), F.transform(F.sequence(F.lit(1), F.greatest(F.length(y), F.lit(1))), lambda i: F.concat(F.substring(y, F.lit(1), i - 1), F.substring(y, i + 1, F.length(y)))))))), range(most), F.array(F.lower(x)))
    m = mentioned.select(*by, F.col("name").alias("mention"))
    r = registry.select(F.col("name").alias("candidate")).distinct()
    pairs = m.select("mention").distinct().select("mention", F.explode(keys("mention")).alias("__k")).join(r.select("candidate", F.explode(keys("candidate")).alias("__k")), "__k").drop("__k").distinct()
    near = pairs.withColumn("distance", F.levenshtein(F.lower("mention"), F.lower("candidate"))).where(F.col("distance").between(1, most))
    if not by:
        return near.join(m.select(F.col("mention").alias("candidate")).distinct(), "candidate", "left_anti").select("mention", "candidate", "distance")
    own = m.repartition(*by).distinct().withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    told = [own.where(c).join(near, "mention").select(*by, "mention", "candidate", "distance") for c in ("__n = 1", "__n > 1")]
    return told[0].unionByName(told[1].join(own.where("__n > 1").select(*by, F.col("mention").alias("candidate")), [*by, "candidate"], "left_anti").select(*told[0].columns))


def check_text(texts: DataFrame, triples: DataFrame, registry: DataFrame, today: str) -> DataFrame:
    """(id, kind, detail) of what texts (id, text) say against the graph or the registry (name); nothing found, no rows.

    Claims in either surface form are held against the open facts of the same ends (relationship_mismatch) and against
    exact facts closed before *today* (stale_fact); names near a mentioned one are told (similar_name). Ends are compared
    by the ids that their names make.
    """
    said = texts.select("id", F.explode(claims(F.col("text"))).alias("c")).select("id", "c.*").distinct()
    said = said.withColumns({"s": entity_id(F.col("subject")), "o": entity_id(F.col("object"))})
    facts = triples.select(F.col("subject").alias("s"), F.lower("predicate").alias("known"), F.col("object").alias("o"), "valid_to")
    met = said.join(facts, ["s", "o"])
    span = F.concat("subject", F.lit(" "), "predicate", F.lit(" "), "object")
    wrong = met.where("valid_to is null and known <> predicate").select("id", F.lit("relationship_mismatch").alias("kind"), F.concat(span, F.lit(": known is "), "known").alias("detail"))
    old = met.where(F.col("valid_to").isNotNull() & (F.col("known") == F.col("predicate")) & (F.col("valid_to") < today))
    old = old.select("id", F.lit("stale_fact").alias("kind"), F.concat(span, F.lit(": closed on "), "valid_to").alias("detail"))
    words = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_#-]+"), 0))).alias("low"))
    mentioned = words.join(registry.select(F.lower("name").alias("low"), "name"), "low").select("id", "name")
    alike = confusable(mentioned, registry).select("id", F.lit("similar_name").alias("kind"), F.concat("mention", F.lit(": did you mean "), "candidate", F.lit("? (edit distance "), "distance", F.lit(")")).alias("detail"))
    return wrong.unionByName(old).distinct().unionByName(alike)  # the last are distinct as they are


def add_entities(entities: DataFrame, new: DataFrame) -> DataFrame:
    """New rows (id, name, type, properties map) take the place of those of their id; equal ids among the new ones: the last name."""
    last = new.groupBy("id").agg(F.max(F.struct("name", "type", F.map_entries("properties").alias("p"))).alias("r")).select("id", "r.name", "r.type", F.map_from_entries("r.p").alias("properties"))
    return entities.join(last.select("id"), "id", "left_anti").select("id", "name", "type", "properties").unionByName(last)


def merge_entities(entities: DataFrame, triples: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with *source* gone into *target*: its name becomes an alias, the target's properties win, facts are renamed.

    Without either row entities stay as they are.
    """
    pair = entities.where(F.col("id").isin(source, target))
    own = F.max_by("properties", (F.col("id") == target).cast("int"))
    other = F.max_by("properties", (F.col("id") == source).cast("int"))
    kept = F.map_filter(other, lambda k, v: ~F.coalesce(F.map_contains_key(own, k), F.lit(False)))
    alias = F.array_sort(F.array_distinct(F.concat(F.flatten(F.collect_list(F.coalesce("alias", F.array().cast("array<string>")))), F.collect_list(F.when(F.col("id") == source, F.col("name"))))))
    name, kind = (F.max_by(c, (F.col("id") == target).cast("int")) for c in ("name", "type"))
    one = pair.groupBy().agg(F.count("*").alias("n"), name.alias("name"), kind.alias("type"), F.map_concat(F.coalesce(own, F.create_map().cast("map<string,string>")), F.coalesce(kept, F.create_map().cast("map<string,string>"))).alias("properties"), alias.alias("alias")).where("n = 2")
    merged = one.select(F.lit(target).alias("id"), "name", "type", "properties", "alias")
    ids = merged.select(F.explode(F.array(F.lit(source), F.lit(target))).alias("id"))
    return entities.join(ids, "id", "left_anti").select(*merged.columns).unionByName(merged), rename(triples, source, target)


def list_entities(entities: DataFrame, kind: str | None = None, limit: int = 100) -> DataFrame:
    """Entities by id, of one type if asked for."""
    rows = entities if kind is None else entities.where(F.col("type") == kind)
    return rows.orderBy("id").limit(limit)


def from_registry(registry: DataFrame) -> DataFrame:
    """Entities (id, name, type, description) of a registry (name, kind, canonical, relationship, contexts); entries that only point to another are skipped."""
    parts = F.array_compact(F.array(F.when(F.col("relationship") != "", F.concat(F.lit("relationship: "), "relationship")), F.when(F.size("contexts") > 0, F.concat(F.lit("context: "), F.array_join("contexts", ", ")))))
    own = registry.where("canonical is null or canonical = ''")
    return own.select(entity_id(F.col("name")).alias("id"), "name", F.col("kind").alias("type"), F.array_join(parts, "; ").alias("description"))


def extract_triples(drawers: DataFrame, done: DataFrame, extractor: Callable[[list[str]], list[list[dict]]]) -> tuple[DataFrame, DataFrame]:
    """Facts (subject, predicate, object, valid_from, source_drawer_id) of drawers not in *done* (id), and the ids done then.

    *extractor* gives for each text of a batch a list of dicts; those without subject, predicate and object are left
    out. Drawers without text are done without it. The two results come of one written table, so that each drawer is
    taken once.
    """
    shared_folder(drawers.sparkSession)
    fresh = drawers.select(F.col("id").cast("string").alias("id"), "document").join(done.select("id"), "id", "left_anti")

    def mapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t or "" for t in frame.document]
            some = [i for i, t in enumerate(texts) if t.strip()]
            found: list[list[dict]] = [[] for _ in texts]
            for i, facts in zip(some, extractor([texts[i] for i in some]) if some else []):
                good = [f for f in facts if isinstance(f, dict) and all(isinstance(f.get(k), str) and f[k].strip() for k in ("subject", "predicate", "object"))]
                found[i] = [{k: f.get(k) if isinstance(f.get(k), str) else None for k in ("subject", "predicate", "object", "valid_from")} for f in good]
            yield pd.DataFrame({"id": frame.id, "facts": found})

    held = fresh.mapInPandas(mapped, "id string, facts array<struct<subject:string,predicate:string,object:string,valid_from:string>>").checkpoint()
    facts_ = held.select(F.col("id").alias("source_drawer_id"), F.inline("facts")).select("subject", "predicate", "object", "valid_from", "source_drawer_id")
    return facts_, done.select("id").unionByName(held.select("id"))


#: The predicate and the object's field for each kind of relation a fact sheet may name.
RELATIONS = {"daughter": ("is_child_of", "parent"), "husband": ("is_partner_of", "partner"), "brother": ("is_sibling_of", "sibling"), "dog": ("is_pet_of", "owner")}
INTERESTS_SINCE = "2025-01-01"


def seed_triples(facts: DataFrame) -> DataFrame:
    """(subject, predicate, object, valid_from) of fact sheets (name, parent, partner, sibling, owner, relationship, birthday, interests).

    Objects are capitalised; a relation without its object leads to the name itself.
    """
    cap = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.expr("substring(__x, 2)")))
    none = F.lit(None).cast("string")
    row = lambda p, o, since: F.struct(F.lit(p).alias("predicate"), o.alias("o"), since.alias("valid_from"))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = [F.when(some("parent").isNotNull(), row("child_of", some("parent"), F.col("birthday"))), F.when(some("partner").isNotNull(), row("married_to", some("partner"), none))]
    rows += [F.when(F.col("relationship") == r, row(p, F.coalesce(some(field), F.col("name")), F.col("birthday") if r == "daughter" else none)) for r, (p, field) in RELATIONS.items()]
    likes = F.transform(F.coalesce("interests", F.array().cast("array<string>")), lambda x: F.struct(F.lit("loves").alias("predicate"), x.alias("o"), F.lit(INTERESTS_SINCE).alias("valid_from")))
    out = facts.select(F.col("name").alias("subject"), F.explode(F.concat(F.array_compact(F.array(*rows)), likes)).alias("f"))
    return out.select("subject", "f.predicate", F.col("f.o").alias("__x"), "f.valid_from").select("subject", "predicate", cap(F.col("__x")).alias("object"), "valid_from")
