"""Names in texts: whether a capitalised word is a person or a project."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Signals of English texts, {name} stands for the candidate.
DIALOGUE = [r"^>\s*{name}[:\s]", r"^{name}:\s", r"^\[{name}\]", r'"{name}\s+said']
PERSON_VERBS = [
    r"\b{name}\s+said\b",
    r"\b{name}\s+asked\b",
    r"\b{name}\s+told\b",
    r"\b{name}\s+replied\b",
    r"\b{name}\s+laughed\b",
    r"\b{name}\s+smiled\b",
    r"\b{name}\s+cried\b",
    r"\b{name}\s+felt\b",
    r"\b{name}\s+thinks?\b",
    r"\b{name}\s+wants?\b",
    r"\b{name}\s+loves?\b",
    r"\b{name}\s+hates?\b",
    r"\b{name}\s+knows?\b",
    r"\b{name}\s+decided\b",
    r"\b{name}\s+pushed\b",
    r"\b{name}\s+wrote\b",
    r"\bhey\s+{name}\b",
    r"\bthanks?\s+{name}\b",
    r"\bhi\s+{name}\b",
    r"\bdear\s+{name}\b",
]
DIRECT = [r"\bhey\s+{name}\b|\bthanks?\s+{name}\b|\bhi\s+{name}\b"]
PRONOUNS = r"\b(she|her|hers|he|him|his|they|them|their)\b"
PROJECT_VERBS = [
    r"\bbuilding\s+{name}\b",
    r"\bbuilt\s+{name}\b",
    r"\bship(?:ping|ped)?\s+{name}\b",
    r"\blaunch(?:ing|ed)?\s+{name}\b",
    r"\bdeploy(?:ing|ed)?\s+{name}\b",
    r"\binstall(?:ing|ed)?\s+{name}\b",
    r"\bthe\s+{name}\s+architecture\b",
    r"\bthe\s+{name}\s+pipeline\b",
    r"\bthe\s+{name}\s+system\b",
    r"\bthe\s+{name}\s+repo\b",
    r"\b{name}\s+v\d+\b",
    r"\b{name}\.py\b",
    r"\b{name}-core\b",
    r"\b{name}-local\b",
    r"\bimport\s+{name}\b",
    r"\bpip\s+install\s+{name}\b",
]
VERSIONED = [r"\b{name}[-v]\w+"]
CODE = [r"\b{name}\.(py|js|ts|yaml|yml|json|sh)\b"]
#: Signals by kind; the other locale's lists can take their place.
ENGLISH = {"dialogue": DIALOGUE, "action": PERSON_VERBS, "addressed": DIRECT, "verb": PROJECT_VERBS, "versioned": VERSIONED, "code": CODE}
#: Points a match gives.
POINTS = {"dialogue": 3, "action": 2, "pronoun": 2, "addressed": 4, "verb": 2, "versioned": 3, "code": 3}
PERSON, PROJECT = ("dialogue", "action", "pronoun", "addressed"), ("verb", "versioned", "code")
#: Lines before and after a name in which a pronoun counts.
NEAR = 2
#: The report's length by type.
MOST = {"person": 15, "project": 10, "uncertain": 8}


def needed(template: str) -> list[str] | None:
    """Lower-case texts of which any match of a template holds one; None for a template with constructs that this doesn't know.

    Only what can't be left out counts: groups, classes and optional characters are skipped, the longest run of ASCII
    characters of each alternative is taken. So a text without them has no match, whatever else the template says.
    """
    gap, mark = "\0", 0xE000
    if re.search(r"\(\?[a-zA-Z-]*x", template):
        return None
    plain = re.sub(r"\\(?:[bBsSwWdDAzZ][?*+]?|[^a-zA-Z0-9][?*])", gap, template.replace("{name}", gap))
    plain = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: chr(mark + ord(m[1])), plain)
    for skipped in (r"\[[^\[\]]*\][?*+]?", r"\([^()]*\)[?*+]?", r"\.[?*+]?", r"[^|()\[\]{}?*+^$][?*]", r"[+^$]"):
        plain = re.sub(skipped, gap, plain)
    if re.search(r"[\\()\[\]{}?*]", plain):
        return None
    told = ["".join(chr(ord(c) - mark) if mark <= ord(c) < mark + 128 else c for c in x) for x in plain.split("|")]
    longest = [max(re.findall("[ -~]+", x), key=len, default="") for x in told]
    return [x.lower() for x in longest] if all(longest) else None


def signals(docs: DataFrame, names: DataFrame, key: str = "id", text: str = "document", patterns: dict[str, list[str]] = ENGLISH, lang: Column | None = None, languages: dict[str, tuple[dict[str, list[str]], str]] | None = None) -> DataFrame:
    """(word, one count for each kind of signal) over the documents that hold a name of *names* (word).

    Documents meet names by their own capitalised words, an equality join; the names of a document come together before
    its text is fetched, once, and patterns run over them within the row. A pronoun counts once for each line that holds
    the name. Names without a document have no row. With *languages* (tag: patterns by kind, pronouns) a text is read by
    the patterns of its tag *lang*; *patterns* are those of all others.
    """
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|[^\p{L}])(\p{Lu}\p{M}*[\p{Ll}\p{M}]+)"), 1))
    tag = F.lit("") if lang is None else F.coalesce(lang, F.lit(""))
    met = docs.select(key, F.explode(words).alias("word")).join(names.select("word").distinct(), "word").groupBy(key).agg(F.collect_set("word").alias("__names"))
    rows = met.join(docs.select(key, F.col(text).alias("__t"), tag.alias("__tag")), key)
    every = [(None, (patterns, PRONOUNS)), *(languages or {}).items()]

    flags_of = lambda kind: "(?imU)" if kind == "dialogue" else "(?iU)"

    def count(kind: str, i: int, template: str, word: Column) -> Column:
        head, *rest = template.split("{name}")
        parts = [F.lit(flags_of(kind) + head)]
        for r in rest:
            parts += [word, F.lit(r)]
        return F.when(F.col(f"__may_{kind}")[i], F.regexp_count("__t", F.concat(*parts))).otherwise(0)

    def by_tag(made: list[tuple[str | None, Column]]) -> Column:
        (_, otherwise), *others = made
        return reduce(lambda a, b: F.when(F.col("__tag") == b[0], b[1]).otherwise(a), others, otherwise)

    def kind_of(kind: str, word: Column) -> Column:
        return by_tag([(k, reduce(lambda a, b: a + b, [count(kind, i, t, word) for i, t in enumerate(own[kind])], F.lit(0))) for k, (own, _) in every])

    def may(kind: str) -> Column:
        """For each template of a kind whether it matches with any word for the name: patterns of a name are tried only then.

        What a match needs is looked for first, as plain text.
        """

        def generic(t: str) -> Column:
            met = F.rlike("__t", F.lit(flags_of(kind) + t.replace("{name}", r"[\p{L}\p{M}]+")))
            held = needed(t)
            return met if held is None else reduce(lambda a, b: a | b, [F.contains("__low", F.lit(x)) for x in held]) & met

        return by_tag([(k, F.array(*map(generic, own[kind])).cast("array<boolean>")) for k, (own, _) in every])

    lines = F.split("__t", "\n")
    flagged = lambda p: F.transform(lines, lambda x: F.rlike(x, F.lit("(?iU)" + p)))
    flags = by_tag([(k, flagged(p)) for k, (_, p) in every])
    near = F.transform("__p", lambda _, i: F.exists(F.slice(F.col("__p"), F.greatest(i - NEAR, F.lit(0)) + 1, F.least(i, F.lit(NEAR)) + NEAR + 1), lambda y: y))

    def pronouns(word: Column) -> Column:
        low = F.lower(word)
        return F.size(F.filter(F.arrays_zip("__l", "__near"), lambda x: x["__near"] & F.contains(x["__l"], low)))

    # Lower case as patterns take it whatever the case: these letters count as i and s there, the Kelvin sign is k already.
    rows = rows.withColumn("__low", F.lower(F.translate("__t", "\u0130\u0131\u017f", "iis")))
    told = rows.withColumns({"__p": flags} | {f"__may_{k}": may(k) for k in POINTS if k != "pronoun"}).withColumns({"__near": near, "__l": F.transform(lines, lambda x: F.lower(x))})
    each = told.select(F.explode(F.transform("__names", lambda w: F.struct(w.alias("word"), *[(pronouns(w) if k == "pronoun" else kind_of(k, w)).cast("long").alias(k) for k in POINTS]))).alias("s"))
    return each.select("s.*").groupBy("word").agg(*[F.sum(k).alias(k) for k in POINTS])


def classify(candidates: DataFrame, of: DataFrame) -> DataFrame:
    """(word, n, person_score, project_score, type, confidence) of candidates (word, n) with their signals.

    A person needs seven tenths of the points, five points and two kinds of signals; a project at most three tenths for
    a person. Without any signal confidence grows with the count up to 0.4.
    """
    rows = candidates.join(of, "word", "left").fillna(0, list(POINTS))
    total = lambda kinds: reduce(lambda a, b: a + b, [F.col(k) * POINTS[k] for k in kinds])
    kinds = reduce(lambda a, b: a + b, [(F.col(k) > 0).cast("int") for k in PERSON])
    rows = rows.select("word", "n", total(PERSON).alias("person_score"), total(PROJECT).alias("project_score"), kinds.alias("__kinds"))
    ratio = F.col("person_score") / (F.col("person_score") + F.col("project_score"))
    none = F.col("person_score") + F.col("project_score") == 0
    sure = (F.col("__kinds") >= 2) & (F.col("person_score") >= 5)
    kind = F.when(none, "uncertain").when((ratio >= 0.7) & sure, "person").when(ratio >= 0.7, "uncertain").when(ratio <= 0.3, "project").otherwise("uncertain")
    confidence = (
        F.when(none, F.least(F.lit(0.4), F.col("n") / 50))
        .when((ratio >= 0.7) & sure, F.least(F.lit(0.99), 0.5 + ratio * 0.5))
        .when(ratio >= 0.7, F.lit(0.4))
        .when(ratio <= 0.3, F.least(F.lit(0.99), 0.5 + (1 - ratio) * 0.5))
        .otherwise(0.5)
    )
    return rows.withColumn("type", kind).withColumn("confidence", F.floor(confidence * 100 + 0.5) / 100).drop("__kinds")


def report(classified: DataFrame) -> DataFrame:
    """The surest of each type: at most 15 people, 10 projects and 8 uncertain names, ties by count and name."""
    w = Window.partitionBy("type").orderBy(F.col("confidence").desc(), F.col("n").desc(), "word")
    most = F.create_map(*[F.lit(x) for pair in MOST.items() for x in pair])
    return classified.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most[F.col("type")])


#: Fixed values: "X is Y's role" and "Y's role is X", with the places of subject, role and object.
CLAIMS = {
    r"(?:^|[^\p{L}\p{N}_])([A-Z][\p{L}\p{N}_-]+)\s+is\s+([A-Z][\p{L}\p{N}_-]+)'s\s+([a-z]{3,20})(?:$|[^\p{L}\p{N}_])": (1, 3, 2),
    r"(?:^|[^\p{L}\p{N}_])([A-Z][\p{L}\p{N}_-]+)'s\s+([a-z]{3,20})\s+is\s+([A-Z][\p{L}\p{N}_-]+)": (3, 2, 1),
}


def claims(text: Column) -> Column:
    """Array of (subject, predicate, object) that a text states in either form, the first form's claims first."""
    def found(pattern: str, places: tuple[int, int, int]) -> Column:
        part = lambda m, i: F.regexp_extract(m, pattern, i)
        s, p, o = places
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.struct(part(m, s).alias("subject"), part(m, p).alias("predicate"), part(m, o).alias("object")))

    return F.concat(*[found(p, places) for p, places in CLAIMS.items()])


#: Contexts of a word that is a name, and of one that isn't.
NAME_CONTEXTS = [
    r"\b{name}\s+said\b",
    r"\b{name}\s+told\b",
    r"\b{name}\s+asked\b",
    r"\b{name}\s+laughed\b",
    r"\b{name}\s+smiled\b",
    r"\b{name}\s+was\b",
    r"\b{name}\s+is\b",
    r"\b{name}\s+called\b",
    r"\b{name}\s+texted\b",
    r"\bwith\s+{name}\b",
    r"\bsaw\s+{name}\b",
    r"\bcalled\s+{name}\b",
    r"\btook\s+{name}\b",
    r"\bpicked\s+up\s+{name}\b",
    r"\bdrop(?:ped)?\s+(?:off\s+)?{name}\b",
    r"\b{name}(?:'s|s')\b",
    r"\bhey\s+{name}\b",
    r"\bthanks?\s+{name}\b",
    r"^{name}[:\s]",
    r"\bmy\s+(?:son|daughter|kid|child|brother|sister|friend|partner|colleague|coworker)\s+{name}\b",
]
WORD_CONTEXTS = [
    r"\bhave\s+you\s+{name}\b",
    r"\bif\s+you\s+{name}\b",
    r"\b{name}\s+since\b",
    r"\b{name}\s+again\b",
    r"\bnot\s+{name}\b",
    r"\b{name}\s+more\b",
    r"\bwould\s+{name}\b",
    r"\bcould\s+{name}\b",
    r"\bwill\s+{name}\b",
    r"(?:the\s+)?{name}\s+(?:of|in|at|for|to)\b",
]


def contexts(word: Column, context: Column, templates: list[str]) -> Column:
    """How many of the templates a word (lower-cased, like its context) stands in."""

    def met(template: str) -> Column:
        head, tail = template.split("{name}")
        return F.rlike(context, F.concat(F.lit("(?U)" + head), F.lit(r"\Q"), word, F.lit(r"\E" + tail))).cast("int")

    return reduce(lambda a, b: a + b, [met(t) for t in templates])


def lookup(words: DataFrame, registry: DataFrame) -> DataFrame:
    """(word, type, confidence, source, name) for rows (word, context) and a registry (name, kind, alias array, confidence, source, ambiguous).

    Kinds go before each other: person, project, then anything confirmed. A person whose word is ambiguous is taken by
    its context: a name, or a concept where that has more signs; else the name stands. Words unknown have type "unknown".
    Names are joined by equality, whatever the case; within a kind the alphabet decides.
    """
    order = F.when(F.col("kind") == "person", 0).when(F.col("kind") == "project", 1).otherwise(2)
    forms = registry.select(F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("alias", F.array().cast("array<string>"))), lambda x: F.lower(x)))).alias("low"), F.struct(order.alias("o"), "name", "kind", "confidence", "source", "ambiguous").alias("r"))
    best = forms.groupBy("low").agg(F.min("r").alias("r"))
    low = F.lower("word")
    met = words.withColumn("low", low).join(best, "low", "left")
    context = F.lower(F.coalesce("context", F.lit("")))
    met = met.withColumn("__n", contexts(F.col("low"), context, NAME_CONTEXTS)).withColumn("__w", contexts(F.col("low"), context, WORD_CONTEXTS))
    unsure = F.coalesce((F.col("r.kind") == "person") & F.col("r.ambiguous"), F.lit(False)) & (context != "") & (F.col("__n") != F.col("__w"))
    name = unsure & (F.col("__n") > F.col("__w"))
    kind = F.when(unsure & ~name, "concept").otherwise(F.coalesce("r.kind", F.lit("unknown")))
    confidence = F.when(name, F.least(F.lit(0.95), 0.7 + F.col("__n") * 0.1)).when(unsure, F.least(F.lit(0.90), 0.7 + F.col("__w") * 0.1)).otherwise(F.coalesce("r.confidence", F.lit(0.0)))
    source = F.when(unsure & ~name, "context").otherwise(F.coalesce("r.source", F.lit("none")))
    return met.select("word", "context", kind.alias("type"), confidence.alias("confidence"), source.alias("source"), F.when(unsure, F.col("word")).otherwise(F.coalesce("r.name", "word")).alias("name"))
