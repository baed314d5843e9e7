"""Notes with people, topics and feelings as lines of text, and such lines taken apart again.

A file of notes is (source_file, emotional_arc, zettels, tunnels), as ``read`` gives it. Its text has a header
``number|people|date|title``, a line for its arc, one for each note ``id:people|topics|"quote"|weight|feelings|flags``, and
one for each tunnel between notes. What is empty has no part. Nested arrays stay in their row; nothing is exploded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, strip

NOTE = "struct<id: string, title: string, content: string, origin_label: string, notes: string, people: array<string>, topics: array<string>, emotional_weight: double, emotional_tone: array<string>, origin_moment: boolean, sensitivity: string, date_context: string>"
FILE = f"source_file string, emotional_arc string, zettels array<{NOTE}>, tunnels array<struct<`from`: string, `to`: string, label: string>>"

#: Codes of feelings; others are their first four letters.
FEELINGS = {
    "vulnerability": "vul", "vulnerable": "vul", "joy": "joy", "joyful": "joy", "fear": "fear", "mild_fear": "fear", "trust": "trust", "trust_building": "trust", "grief": "grief", "raw_grief": "grief",
    "wonder": "wonder", "philosophical_wonder": "wonder", "rage": "rage", "anger": "rage", "love": "love", "devotion": "love", "hope": "hope", "despair": "despair", "hopelessness": "despair", "peace": "peace",
    "relief": "relief", "humor": "humor", "dark_humor": "humor", "tenderness": "tender", "raw_honesty": "raw", "brutal_honesty": "raw", "self_doubt": "doubt", "anxiety": "anx", "exhaustion": "exhaust",
    "conviction": "convict", "quiet_passion": "passion", "warmth": "warmth", "curiosity": "curious", "gratitude": "grat", "frustration": "frust", "confusion": "confuse", "satisfaction": "satis",
    "excitement": "excite", "determination": "determ", "surprise": "surprise",
}
#: Words that make a quote weigh more; feelings of a note, people of a header, topics of a note.
MOVING = ["love", "fear", "remember", "soul", "feel", "stupid", "scared", "beautiful", "destroy", "respect", "trust", "consciousness", "alive", "forget", "waiting", "peace", "matter", "real", "guilt", "escape", "rest", "hope", "dream", "lost", "found"]
MOST_FEELINGS, MOST_PEOPLE, MOST_TOPICS = 3, 3, 2
NOBODY, NO_TOPIC, WEIGHT = "???", "misc", 0.5
#: Quotes in double marks, in single ones that stand apart, and what is said behind a verb of saying.
QUOTES = (r'"([^"]{8,55})"', r"(?:^|[\s(])'([^']{8,55})'(?:[\s.,;:!?)]|$)", r"(?i)(?:says?|said|articulates?|reveals?|admits?|confesses?|asks?):\s*[\"']?([^.!?]{10,55})[.!?]")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files of notes, one JSON object each."""
    return spark.read.schema(FILE).json(path, multiLine=True)


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _list(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def person_code(name: Column, codes: dict[str, str], skip: list[str]) -> Column:
    """The code of a person: null for names to be skipped, a known one (as it is, in lower case, or within the name), else the first three letters."""
    low = F.lower(name)
    inner = [F.when(F.contains(low, F.lit(k.lower())), F.lit(v)) for k, v in codes.items()]
    exact = [F.when(n == F.lit(k), F.lit(v)) for n in (name, low) for k, v in codes.items()]
    skipped = reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in skip], F.lit(False))
    return F.when(~skipped, F.coalesce(*exact, *inner, F.upper(F.substring(name, 1, 3))))


def _codes(people: Column, codes: dict[str, str], skip: list[str]) -> Column:
    """Distinct codes in order; one that stands for nobody if there is none."""
    found = F.array_sort(F.array_distinct(F.array_compact(F.transform(_list(people), lambda p: person_code(p, codes, skip)))))
    return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(NOBODY))))


def feelings(tones: Column) -> Column:
    """Codes of the first three different feelings."""
    known = F.create_map(*[F.lit(x) for pair in FEELINGS.items() for x in pair])
    codes = F.array_distinct(F.transform(_list(tones), lambda t: F.coalesce(F.try_element_at(known, t), F.substring(t, 1, 4))))
    return F.array_join(F.slice(codes, 1, MOST_FEELINGS), "+")


def flags(note: Column) -> Column:
    """Flags that a note's fields raise, in a fixed order."""
    notes, label = F.lower(_text(note["notes"])), F.lower(_text(note["origin_label"]))
    raised = [
        (F.coalesce(note["origin_moment"], F.lit(False)), "ORIGIN"),
        (F.startswith(F.upper(_text(note["sensitivity"])), F.lit("MAXIMUM")), "SENSITIVE"),
        (F.contains(notes, F.lit("foundational pillar")) | F.contains(notes, F.lit("core")), "CORE"),
        (F.contains(notes, F.lit("genesis")) | F.contains(label, F.lit("genesis")), "GENESIS"),
        (F.contains(notes, F.lit("pivot")), "PIVOT"),
    ]
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in raised])), "+")


def key_quote(note: Column) -> Column:
    """The quote of a note's texts that weighs most, the first of equals; else what its title says behind a dash; else empty."""
    every = F.concat_ws(" ", _text(note["content"]), _text(note["origin_label"]), _text(note["notes"]))

    def of(text: Column) -> Column:
        found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in QUOTES])
        return F.array_distinct(F.filter(F.transform(found, strip), lambda q: F.length(q) >= 8))

    def weight(q: Column) -> Column:
        low = F.lower(q)
        moving = reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in MOVING])
        opens = F.rlike(q, F.lit(r"^\p{Lu}")).cast("int") * 2 + moving * 2 + (F.length(q) > 20).cast("int")
        return opens - F.rlike(q, F.lit("^(The|This|She) ")).cast("int") * 2

    def best(quotes: Column) -> Column:
        placed = F.transform(quotes, lambda q, i: F.struct((-weight(q)).alias("w"), i.alias("i"), q.alias("q")))
        return F.array_min(placed)["q"]

    title = _text(note["title"])
    behind = F.substring(F.regexp_extract(title, r"(?s)^.*? - (.*)$", 1), 1, 45)
    return F.coalesce(let(let(every, of), best), behind)


def encoded_note(note: Column, codes: dict[str, str], skip: list[str]) -> Column:
    topics = F.array_join(F.slice(_list(note["topics"]), 1, MOST_TOPICS), "_")
    quote = let(key_quote(note), lambda q: F.when(q != "", F.concat(F.lit('"'), q, F.lit('"'))))
    parts = [
        F.concat(F.element_at(F.split(_text(note["id"]), "-"), -1), F.lit(":"), F.array_join(_codes(note["people"], codes, skip), "+")),
        F.when(F.size(_list(note["topics"])) > 0, topics).otherwise(NO_TOPIC),
        quote,
        F.coalesce(note["emotional_weight"], F.lit(WEIGHT)).cast("string"),
        F.nullif(feelings(note["emotional_tone"]), F.lit("")),
        F.nullif(flags(note), F.lit("")),
    ]
    return F.array_join(F.array_compact(F.array(*parts)), "|")


def encoded_tunnel(tunnel: Column) -> Column:
    last = lambda x: F.element_at(F.split(_text(x), "-"), -1)
    label = _text(tunnel["label"])
    short = F.when(F.contains(label, F.lit(":")), F.element_at(F.split(label, ":"), 1)).otherwise(F.substring(label, 1, 30))
    return F.concat(F.lit("T:"), last(tunnel["from"]), F.lit("<->"), last(tunnel["to"]), F.lit("|"), short)


def encode(files: DataFrame, codes: dict[str, str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """The files with *encoded*: header, arc, notes and tunnels, a line each. *codes* are of known names, *skip* of names left out."""
    codes, skip = codes or {}, skip or []
    source = F.coalesce("source_file", F.lit("unknown"))
    dashed = F.contains(source, F.lit("-"))
    number = F.when(dashed, F.element_at(F.split(source, "-"), 1)).otherwise("000")
    title = F.when(dashed, F.trim(F.regexp_extract(F.replace(source, F.lit(".txt"), F.lit("")), r"(?s)^[^-]*-(.*)$", 1))).otherwise(source)
    notes = F.coalesce("zettels", F.array().cast(f"array<{NOTE}>"))
    everyone = F.flatten(F.transform(notes, lambda z: _list(z["people"])))
    header = F.concat_ws("|", number, F.array_join(F.slice(_codes(everyone, codes, skip), 1, MOST_PEOPLE), "+"), F.coalesce(F.get(notes, F.lit(0))["date_context"], F.lit("unknown")), title)
    arc = F.when(_text(F.col("emotional_arc")) != "", F.concat(F.lit("ARC:"), "emotional_arc"))
    tunnels = F.coalesce("tunnels", F.array().cast("array<struct<`from`: string, `to`: string, label: string>>"))
    lines = F.concat(F.array_compact(F.array(header, arc)), F.transform(notes, lambda z: encoded_note(z, codes, skip)), F.transform(tunnels, encoded_tunnel))
    return files.withColumn("encoded", F.array_join(lines, "\n"))


def decode(rows: DataFrame, text: str = "encoded") -> DataFrame:
    """The rows with *header* (file, entities, date, title), *arc*, *notes* and *links*: lines by their kind; others are left out."""
    lines = F.split(strip(F.col(text)), "\n")
    kind = lambda x: F.when(F.startswith(x, F.lit("ARC:")), "arc").when(F.startswith(x, F.lit("T:")), "tunnel").when(F.contains(x, F.lit("|")), F.when(F.contains(F.element_at(F.split(x, r"\|"), 1), F.lit(":")), "note").otherwise("header")).otherwise("")
    of = lambda name: F.filter(lines, lambda x: kind(x) == name)
    parts = F.split(F.coalesce(F.try_element_at(of("header"), F.lit(-1)), F.lit("")), r"\|")
    header = F.struct(*[_text(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(("file", "entities", "date", "title"))])
    arc = F.coalesce(F.expr("substring(__a, 5)"), F.lit(""))
    return rows.withColumn("__a", F.try_element_at(of("arc"), F.lit(-1))).withColumns({"header": header, "arc": arc, "notes": of("note"), "links": of("tunnel")}).drop("__a")
