"""Memories in texts: segments, prose without code, types by markers, corrected by sentiment and resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .classify import MARKERS, marker_scores

#: Words of good and of bad feeling.
POSITIVE = [
    "pride", "proud", "joy", "happy", "love", "loving", "beautiful", "amazing", "wonderful", "incredible", "fantastic", "brilliant", "perfect", "excited", "thrilled", "grateful",
    "warm", "breakthrough", "success", "works", "working", "solved", "fixed", "nailed", "heart", "hug", "precious", "adore",
]
NEGATIVE = [
    "bug", "error", "crash", "crashing", "crashed", "fail", "failed", "failing", "failure", "broken", "broke", "breaking", "breaks", "issue", "problem", "wrong", "stuck", "blocked",
    "unable", "impossible", "missing", "terrible", "horrible", "awful", "worse", "worst", "panic", "disaster", "mess",
]

#: Signs that a problem is solved.
RESOLVED = [r"\bfixed\b", r"\bsolved\b", r"\bresolved\b", r"\bpatched\b", r"\bgot it working\b", r"\bit works\b", r"\bnailed it\b", r"\bfigured (it )?out\b", r"\bthe (fix|answer|solution)\b"]

#: How a line of code begins; a line of few letters is one, too.
CODE = [
    r"[\$#]\s",
    r"(cd|source|echo|export|pip|npm|git|python|bash|curl|wget|mkdir|rm|cp|mv|ls|cat|grep|find|chmod|sudo|brew|docker)\s",
    r"```",
    r"(import|from|def|class|function|const|let|var|return)\s",
    r"[A-Z_]{2,}=",
    r"\|",
    r"[-]{2,}",
    r"[{}\[\]]\s*$",
    r"(if|for|while|try|except|elif|else:)\b",
    r"\w+\.\w+\(",
    r"\w+ = \w+\.\w+",
]

#: How a line begins that opens a speaker's turn; so many turns make a text a dialogue.
TURN = r"[^\S\n]*(?:>[^\S\n]+\S|(?i:Human|User|Q)[^\S\n]*:|(?i:Assistant|AI|A|Claude|ChatGPT)[^\S\n]*:)"
TURNS = 3
#: Lines of a group, where a text of more than LONG lines has no paragraphs; the shortest segment.
GROUP, LONG, SHORTEST = 25, 20, 20


def segments(text: Column) -> Column:
    """Speaker turns if there are enough, else paragraphs, else groups of lines of a long block.

    Only the last two are trimmed; white space is that of ASCII.
    """
    turns = F.regexp_count(F.concat(F.lit("\n"), text), F.lit(rf"\n{TURN}"))
    trimmed = lambda parts: F.filter(F.transform(parts, strip), lambda x: x != "")
    blocks, lines = trimmed(F.split(text, "\n\n")), F.split(text, "\n")
    groups = trimmed(F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / GROUP).cast("int")), lambda i: F.array_join(F.slice(lines, i * GROUP + 1, GROUP), "\n")))
    return F.when(turns >= TURNS, F.split(text, rf"\n(?={TURN})")).when((F.size(blocks) <= 1) & (F.size(lines) > LONG), groups).otherwise(blocks)


def prose(segment: Column) -> Column:
    """The segment without fenced blocks and lines of code; all of it if nothing else is left."""
    bare = F.regexp_replace(segment, r"(?s)(?<![^\n])[^\S\n]*```[^\n]*+.*?(?:\n[^\S\n]*```[^\n]*+|\z)", "")
    code = "^(" + "|".join(CODE) + ")"

    def kept(line: Column) -> Column:
        x = strip(line)
        few = (F.length(x) > 10) & (F.length(F.regexp_replace(x, r"[^\p{L}]", "")) / F.length(x) < 0.4)
        return (x == "") | ~(F.rlike(x, F.lit(code)) | few)

    out = strip(F.array_join(F.filter(F.split(bare, "\n"), kept), "\n"))
    return F.when(out == "", segment).otherwise(out)


def sentiment(text: Column) -> Column:
    """1, 0 or -1: whether more distinct words of good or of bad feeling stand in the text."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), 0)
    held = lambda known: F.size(F.array_intersect(words, F.array(*map(F.lit, known))))
    return F.sign(held(POSITIVE) - held(NEGATIVE)).cast("int")


def resolved(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.rlike(low, F.lit(p)) for p in RESOLVED])


def extract(docs: DataFrame, least: float = 0.3, key: str = "id", text: str = "document") -> DataFrame:
    """(key, chunk_index, content, memory_type, confidence) of the segments that hold a memory, numbered within their text.

    The type with most marker matches in the segment's prose wins, the first declared of equals; matches plus a bonus
    for length, over 5, give the confidence. Solved problems are milestones, or feelings if they sound glad.
    """
    parts = docs.select(key, F.posexplode(segments(F.col(text))).alias("__i", "__s")).where(F.length(strip(F.col("__s"))) >= SHORTEST)
    prosed = parts.withColumn("__p", prose(F.col("__s")))
    scored = prosed.withColumns({f"__{k}": s for k, s in marker_scores(F.col("__p")).items()})
    best = F.greatest(*[F.col(f"__{k}") for k in MARKERS])
    kind = reduce(lambda out, k: out.when(F.col(f"__{k}") == F.col("__best"), F.lit(k)), list(MARKERS)[1:], F.when(F.col(f"__{next(iter(MARKERS))}") == F.col("__best"), F.lit(next(iter(MARKERS)))))
    bonus = F.when(F.length("__s") > 500, 2).when(F.length("__s") > 200, 1).otherwise(0)
    confidence = F.least(F.lit(1.0), (F.col("__best") + bonus) / 5.0)
    found = scored.withColumn("__best", best).where("__best > 0").withColumn("confidence", confidence).where(F.col("confidence") >= least)
    found = found.withColumn("__k", kind).withColumn("__g", sentiment(F.col("__p")))
    problem, glad = F.col("__k") == "problem", F.col("__g") > 0
    settled = (
        F.when(problem & resolved(F.col("__p")), F.when((F.col("__emotional") > 0) & glad, "emotional").otherwise("milestone"))
        .when(problem & glad & (F.col("__milestone") > 0), "milestone")
        .when(problem & glad & (F.col("__emotional") > 0), "emotional")
        .otherwise(F.col("__k"))
    )
    number = (F.row_number().over(Window.partitionBy(key).orderBy("__i")) - 1).alias("chunk_index")
    return found.select(key, number, strip(F.col("__s")).alias("content"), settled.alias("memory_type"), "confidence")
