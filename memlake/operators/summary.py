"""Short forms of texts: one-line summaries in a compact notation, and topic lines that point to drawers."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from heapq import nsmallest

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, strip
from .classify import QUOTES, actions
from .collection import top

#: Keywords and the code of the feeling they tell, in order of precedence.
FEELINGS = {
    "decided": "determ",
    "prefer": "convict",
    "worried": "anx",
    "excited": "excite",
    "frustrated": "frust",
    "confused": "confuse",
    "love": "love",
    "hate": "rage",
    "hope": "hope",
    "fear": "fear",
    "trust": "trust",
    "happy": "joy",
    "sad": "grief",
    "surprised": "surprise",
    "grateful": "grat",
    "curious": "curious",
    "wonder": "wonder",
    "anxious": "anx",
    "relieved": "relief",
    "satisf": "satis",
    "disappoint": "grief",
    "concern": "anx",
}
#: Keywords and the flag they set, in order of precedence.
FLAGS = {
    "decided": "DECISION",
    "chose": "DECISION",
    "switched": "DECISION",
    "migrated": "DECISION",
    "replaced": "DECISION",
    "instead of": "DECISION",
    "because": "DECISION",
    "founded": "ORIGIN",
    "created": "ORIGIN",
    "started": "ORIGIN",
    "born": "ORIGIN",
    "launched": "ORIGIN",
    "first time": "ORIGIN",
    "core": "CORE",
    "fundamental": "CORE",
    "essential": "CORE",
    "principle": "CORE",
    "belief": "CORE",
    "always": "CORE",
    "never forget": "CORE",
    "turning point": "PIVOT",
    "changed everything": "PIVOT",
    "realized": "PIVOT",
    "breakthrough": "PIVOT",
    "epiphany": "PIVOT",
    "api": "TECHNICAL",
    "database": "TECHNICAL",
    "architecture": "TECHNICAL",
    "deploy": "TECHNICAL",
    "infrastructure": "TECHNICAL",
    "algorithm": "TECHNICAL",
    "framework": "TECHNICAL",
    "server": "TECHNICAL",
    "config": "TECHNICAL",
}
#: Words that make a sentence weigh more.
DECISIVE = [
    "decided", "because", "instead", "prefer", "switched", "chose", "realized", "important", "key", "critical", "discovered", "learned", "conclusion",
    "solution", "reason", "why", "breakthrough", "insight",
]
#: Words that are no topics.
FILLER = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "about", "between", "through",
    "during", "before", "after", "above", "below", "up", "down", "out", "off", "over", "under", "again", "further", "then", "once", "here", "there",
    "when", "where", "why", "how", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own",
    "same", "so", "than", "too", "very", "just", "don", "now", "and", "but", "or", "if", "while", "that", "this", "these", "those", "it", "its", "i",
    "we", "you", "he", "she", "they", "me", "him", "her", "us", "them", "my", "your", "his", "our", "their", "what", "which", "who", "whom", "also",
    "much", "many", "like", "because", "since", "get", "got", "use", "used", "using", "make", "made", "thing", "things", "way", "well", "really",
    "want", "need",
]
#: Capitalised words that are no names.
NO_NAMES = [
    "The", "This", "That", "These", "Those", "When", "Where", "What", "Why", "Who", "Which", "How", "After", "Before", "Then", "Now", "Here", "There",
    "And", "But", "Or", "Yet", "So", "If", "Else", "Yes", "No", "Maybe", "Okay", "User", "Assistant", "System", "Tool", "Monday", "Tuesday",
    "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April", "May", "June", "July", "August", "September",
    "October", "November", "December",
]
#: Characters of a text that topic lines look at, and of one closet.
WINDOW, CLOSET = 5000, 1500
TOPIC_WORD = r"[a-zA-Z][a-zA-Z_-]{2,}"
#: Whole words of any script, and those that may be names; engines differ in what they take for a word's boundary.
WORD, NAME = r"[\p{L}\p{N}_]+", "^[A-Z][a-z]{1,19}$"
HEADER = r"(?m)^#{1,3}\s+(.{5,60})$"


def _codes(text: Column, words: dict[str, str], most: int = 3) -> Column:
    """The distinct codes of the keywords that the lower-cased text holds, in the table's order."""
    found = let(F.lower(text), lambda low: F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in words.items()]))
    return F.slice(F.array_distinct(F.array_compact(found)), 1, most)


def names(text: Column, known: dict[str, str] | None = None) -> Column:
    """Codes of known names in the text, else the first three letters of up to three capitalised words after the first word."""
    words = F.split(strip(text), r"\s+")
    clean = F.transform(F.filter(F.slice(words, 2, 1 << 30), lambda w: F.rlike(w, F.lit("[A-Z]"))), lambda w: F.regexp_replace(w, "[^a-zA-Z]", ""))
    name = lambda w: F.rlike(w, F.lit("^[A-Z][a-z]+$")) & ~F.lower(w).isin(FILLER)
    guessed = F.slice(F.array_distinct(F.transform(F.filter(clean, name), lambda w: F.upper(F.substring(w, 1, 3)))), 1, 3)
    told = {k.lower(): v for k, v in (known or {}).items() if not k.islower()}
    if not told:
        return guessed
    return let(_codes(text, told, len(told)), lambda c: F.when(F.size(c) > 0, F.slice(c, 1, 3)).otherwise(guessed))


def key_sentence(text: Column) -> Column:
    """The sentence with most decisive words, short ones preferred, the first among equals; cut to 55 characters. Else empty."""
    parts = F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda s: strip(s)), lambda s: F.length(s) > 10)

    def score(s: Column) -> Column:
        n = F.length(s)
        words = let(F.lower(s), lambda low: reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") * 2 for w in DECISIVE]))
        return words + F.when(n < 40, 2).when(n < 80, 1).when(n > 150, -2).otherwise(0)

    best = F.array_max(F.transform(parts, lambda s, i: F.struct(score(s).alias("score"), (-i).alias("i"), s.alias("s"))))["s"]
    return let(best, lambda b: F.when(F.length(b) > 55, F.concat(F.substring(b, 1, 52), F.lit("..."))).otherwise(F.coalesce(b, F.lit(""))))


def topics(text: Column, most: int = 3) -> Column:
    """The words of a text that weigh most, the first among equals.

    A word weighs its count, plus two for each time that it is capitalised and for each time that it holds an
    underscore, a hyphen or a later capital. A text is counted within its row, so neither words nor texts are shuffled.
    """
    word, marked, filler = re.compile(TOPIC_WORD), re.compile("[_-]|^.+[A-Z]"), frozenset(FILLER)

    def heaviest(t: str | None) -> list[str]:
        weights: dict[str, int] = {}  # in the order of the words' first places
        for w, n in Counter(word.findall(t or "")).items():
            low = w.lower()
            if low not in filler:
                weights[low] = weights.get(low, 0) + n * (1 + 2 * ("A" <= w[0] <= "Z") + 2 * bool(marked.search(w)))
        return nsmallest(most, weights, key=lambda w: -weights[w])

    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(heaviest)

    return F.pandas_udf(counted, "array<string>")(text)


def compress(docs: DataFrame, key: str = "id", text: str = "document", known: dict[str, str] | None = None) -> DataFrame:
    """Adds *summary*: names, topics, key sentence, feelings and flags of the text; a text without any gives ``0:???|misc``.

    Rows with a source_file or wing get a line before it: wing, room, occurred_at and the file's name. Null texts count as empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("__topics", topics(body))
    part = lambda x, sep, otherwise: let(x, lambda a: F.when(F.size(a) > 0, F.array_join(a, sep)).otherwise(otherwise))
    sentence = let(key_sentence(body), lambda s: F.when(s != "", F.concat(F.lit('"'), s, F.lit('"'))))
    fields = [
        F.concat(F.lit("0:"), part(names(body, known), "+", F.lit("???"))),
        part(F.col("__topics"), "_", F.lit("misc")),
        sentence,
        part(_codes(body, FEELINGS), "+", F.lit(None)),
        part(_codes(body, FLAGS), "+", F.lit(None)),
    ]
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    some = lambda x: F.when(x == "", F.lit("?")).otherwise(x)
    stem = F.regexp_replace(F.element_at(F.split(has("source_file"), "/"), -1), r"(?<=.)\.[^.]*$", "")
    head = F.when((has("source_file") != "") | (has("wing") != ""), F.concat_ws("|", some(has("wing")), some(has("room")), some(has("occurred_at")), some(stem)))
    return rows.withColumn("summary", F.concat_ws("\n", head, F.concat_ws("|", *fields))).drop("__topics")


def estimated_tokens(text: Column) -> Column:
    """About 1.3 a word, at least one."""
    words = let(strip(text), lambda t: F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+"))))
    return F.greatest(F.lit(1), F.floor(words * 1.3).cast("int"))


def compression_totals(compressed: DataFrame, text: str = "document") -> DataFrame:
    """(n, original_tokens, summary_tokens, original_chars, summary_chars) over all rows."""
    pairs = [(text, "original"), ("summary", "summary")]
    sums = [F.sum(estimated_tokens(F.col(c))).alias(f"{n}_tokens") for c, n in pairs] + [F.sum(F.length(c)).cast("long").alias(f"{n}_chars") for c, n in pairs]
    return compressed.agg(F.count("*").alias("n"), *sums)


def topic_lines(docs: DataFrame, key: str = "id", text: str = "document", drawers: str = "drawer_ids") -> DataFrame:
    """(key, position, line): what a text is about, the names in it and its first three drawers.

    Topics are phrases of work done and headings, lower-cased and distinct, at most 12; then up to three quotes; a text
    without any has one line of its wing, room and file. Names are the five most frequent capitalised words met twice or
    more, the first among equals. All this looks at the first 5,000 characters, as the feature says.
    """
    rows = docs.withColumn("__t", F.substring(F.coalesce(F.col(text), F.lit("")), 1, WINDOW))
    words = rows.select(key, F.posexplode(F.regexp_extract_all("__t", F.lit(WORD), 0)).alias("i", "w")).where(F.rlike("w", F.lit(NAME)) & ~F.col("w").isin(NO_NAMES))
    frequent = top(words.groupBy(key, "w").agg(F.count("*").alias("n"), F.min("i").alias("i")).where("n >= 2"), 5, [F.col("n").desc(), F.col("i")], [key])
    named = frequent.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "w"))), lambda t: t["w"]), ";").alias("__names"))
    heads = F.transform(F.regexp_extract_all("__t", F.lit(HEADER), 1), lambda x: F.lower(strip(x)))
    about = F.slice(F.array_distinct(F.concat(actions(F.col("__t")), heads)), 1, 12)
    said = F.transform(F.slice(F.regexp_extract_all("__t", F.lit(QUOTES), 1), 1, 3), lambda q: F.concat(F.lit('"'), q, F.lit('"')))
    stem = F.substring(F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"(?<=.)\.[^.]*$", ""), 1, 40)
    all_of = let(F.concat(about, said), lambda a: F.when(F.size(a) > 0, a).otherwise(F.array(F.concat_ws("/", "wing", "room", stem))))
    tail = F.concat(F.lit("|"), F.coalesce("__names", F.lit("")), F.lit("|→"), F.array_join(F.slice(F.col(drawers).cast("array<string>"), 1, 3), ","))
    return rows.join(named, key, "left").select(key, F.posexplode(F.transform(all_of, lambda x: F.concat(x, tail))).alias("position", "line"))


def closets(lines: DataFrame, key: str = "id", size: int = CLOSET) -> DataFrame:
    """(key, closet, text): lines packed in order into texts of at most *size* characters, none split.

    A text's lines are few (16 at most), so that one fold over them as an array gives each line its closet.
    """
    of = F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"])
    start = F.struct(F.lit(0).alias("used"), F.lit(1).alias("closet"), F.array().cast("array<int>").alias("numbers"))

    def put(a: Column, line: Column) -> Column:
        n = F.length(line) + 1
        full = (a["used"] > 0) & (a["used"] + n > size)
        number = a["closet"] + full.cast("int")
        return F.struct(F.when(full, n).otherwise(a["used"] + n).alias("used"), number.alias("closet"), F.array_append(a["numbers"], number).alias("numbers"))

    folded = lines.groupBy(key).agg(of.alias("__l")).withColumn("__n", F.aggregate("__l", start, put)["numbers"])
    rows = folded.select(key, F.posexplode(F.arrays_zip("__n", "__l")).alias("i", "x")).select(key, "i", F.col("x.__n").alias("closet"), F.col("x.__l").alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(key, "closet").agg(text.alias("text"))
