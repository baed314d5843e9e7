"""What is told of files as they are taken in: room, names, pointers, wings of transcripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .collection import top
from .names import known_names
from .summary import NAME, NO_NAMES, WINDOW, WORD

#: Characters of a text in which keywords of rooms are counted; names told of a drawer.
LOOKED_AT, MOST_NAMES = 2000, 25
GENERAL = "general"


def _first(cases: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(c, F.lit(v)) for c, v in cases])


def _times(text: Column, word: str) -> Column:
    """How often a word stands in a text, without overlaps."""
    return (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)


def room_of(path: Column, content: Column, rooms: list[dict]) -> Column:
    """The room of a file by its relative path and content; *rooms* is a project's list (name, keywords), in order.

    The first folder that a name or keyword holds or is held by, from the outside in; else the file's stem the same way
    with names only; else the room whose keywords and name stand most often at the content's beginning, the first of
    equals; else the general room.
    """
    known = [(r["name"], [r["name"].lower(), *(k.lower() for k in r.get("keywords", []))]) for r in rooms]
    parts = F.split(F.replace(F.lower(path), F.lit("\\"), F.lit("/")), "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    near = lambda x, w: F.contains(x, F.lit(w)) | F.contains(F.lit(w), x)
    if not known:
        return F.lit(GENERAL)
    told = F.array_compact(F.transform(folders, lambda p: _first([(reduce(lambda a, b: a | b, [near(p, w) for w in words]), name) for name, words in known])))
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    by_stem = _first([(near(stem, words[0]), name) for name, words in known])
    low = F.lower(F.substring(content, 1, LOOKED_AT))
    scores = [(reduce(lambda a, b: a + b, [_times(low, w) for w in [*words[1:], words[0]]]), name) for name, words in known]
    best = reduce(lambda a, b: F.greatest(a, b), [s for s, _ in scores])
    by_words = _first([((s == best) & (best > 0), name) for s, name in scores])
    return F.coalesce(F.try_element_at(told, F.lit(1)), by_stem, by_words, F.lit(GENERAL))


def names_of(docs: DataFrame, known: DataFrame, key: str = "id", text: str = "document") -> DataFrame:
    """(key, entities): the names told of each text, in alphabetical order, joined by semicolons, at most 25.

    Known names (name), of any number of words, that stand in the text one word after another, case and all; and
    capitalised words met twice or more at the text's beginning that are no common ones. Texts without a name have none.
    """
    words = lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0))
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias("__t"), words(F.coalesce(text, F.lit(""))).alias("__w"))
    met = known_names(rows, "__w", key, known.where("name <> ''").select("name", words(F.col("name")).alias("__g")), "__g")
    begun = rows.select(key, F.explode(words(F.substring("__t", 1, WINDOW))).alias("name")).where(F.rlike("name", F.lit(NAME)) & (F.length("name") > 2) & ~F.col("name").isin(NO_NAMES))
    often = begun.groupBy(key, "name").agg(F.count("*").alias("n")).where("n >= 2").select(key, "name")
    kept = top(met.unionByName(often).distinct(), MOST_NAMES, [F.col("name")], [key])
    return kept.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("name")), ";").alias("entities"))


def pointers(line: Column) -> Column:
    """The drawer ids that an index text points to, each once, in order."""
    found = F.flatten(F.transform(F.regexp_extract_all(line, F.lit("→([\\p{L}\\p{N}_,]+)"), 1), lambda x: F.split(x, ",")))
    return F.array_distinct(F.filter(F.transform(found, strip), lambda x: x != ""))


def pointed_drawers(index: DataFrame, drawers: DataFrame, line: str = "text", key: str = "id") -> DataFrame:
    """Each index row (key, line) with the drawers it points to, in its order; pointers to nothing are left out."""
    each = index.select(F.col(key).alias("index_id"), F.posexplode(pointers(F.col(line))).alias("place", "drawer"))
    return each.join(drawers.select(F.col("id").cast("string").alias("drawer"), "document"), "drawer").select("index_id", "place", "drawer", "document")


def wing_of_transcript(path: Column) -> Column:
    """The wing of a transcript by its path: the last part of an encoded project folder, else a folder named so, else sessions."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    encoded = F.regexp_extract(p, r"/\.claude/projects/-([^/]+)", 1)
    last = F.element_at(F.split(encoded, "-"), -1)
    named = F.regexp_extract(p, r"-Projects-([^/]+?)(?:/|$)", 1)
    wing = F.when(last != "", last).when(named != "", named)
    return F.coalesce(F.concat(F.lit("wing_"), F.replace(F.lower(wing), F.lit(" "), F.lit("_"))), F.lit("wing_sessions"))


def regrouped(drawers: DataFrame, wing: str | None = None) -> DataFrame:
    """(source_file, drawer_ids, content): each source's drawers in order, as its index is made from; one source is one file."""
    rows = drawers if wing is None else drawers.where(F.col("wing") == wing)
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "id", "document")))
    joined = rows.groupBy(F.coalesce("source_file", F.lit("unknown")).alias("source_file")).agg(parts.alias("p"))
    return joined.select("source_file", F.transform("p", lambda x: x["id"]).alias("drawer_ids"), F.array_join(F.transform("p", lambda x: x["document"]), "\n\n").alias("content"))


def with_provenance(records: DataFrame, adapter: str, version: str, at: Column | None = None) -> DataFrame:
    """Records (source_file, chunk_index, document, ...) of an adapter, with their stamps and a fixed id, ready for upsert."""
    digest = F.substring(F.sha2(F.concat_ws("\0", F.lit(adapter), "source_file", F.col("chunk_index").cast("string")), 256), 1, 24)
    return records.withColumns({"id": F.concat(F.lit("drawer_"), F.lit(adapter), F.lit("_"), digest), "adapter_name": F.lit(adapter), "adapter_version": F.lit(version), "filed_at": F.current_timestamp() if at is None else at})


def latest(rows: DataFrame, key: str = "id", by: str = "filed_at") -> DataFrame:
    """One row for each key, the last by time."""
    w = Window.partitionBy(key).orderBy(F.col(by).desc_nulls_last())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
