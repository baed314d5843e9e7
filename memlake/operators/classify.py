"""Keyword and pattern classification of texts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Keywords by hall, in order of priority.
HALLS = {
    "emotions": ["scared", "afraid", "worried", "happy", "sad", "love", "hate", "feel", "cry", "tears"],
    "consciousness": ["consciousness", "conscious", "aware", "real", "genuine", "soul", "exist", "alive"],
    "memory": ["memory", "remember", "forget", "recall", "archive", "palace", "store"],
    "technical": ["code", "python", "script", "bug", "error", "function", "api", "database", "server"],
    "identity": ["identity", "name", "who am i", "persona", "self"],
    "family": ["family", "kids", "children", "daughter", "son", "parent", "mother", "father"],
    "creative": ["game", "gameplay", "player", "app", "design", "art", "music", "story"],
}

#: Keywords by conversation topic, in order of priority.
TOPICS = {
    "technical": ["code", "python", "function", "bug", "error", "api", "database", "server", "deploy", "git", "test", "debug", "refactor"],
    "architecture": ["architecture", "design", "pattern", "structure", "schema", "interface", "module", "component", "service", "layer"],
    "planning": ["plan", "roadmap", "milestone", "deadline", "priority", "sprint", "backlog", "scope", "requirement", "spec"],
    "decisions": ["decided", "chose", "picked", "switched", "migrated", "replaced", "trade-off", "alternative", "option", "approach"],
    "problems": ["problem", "issue", "broken", "failed", "crash", "stuck", "workaround", "fix", "solved", "resolved"],
}

#: Patterns of memory types, matched in lower case.
MARKERS = {
    "decision": [
        r"\blet'?s (use|go with|try|pick|choose|switch to)\b",
        r"\bwe (should|decided|chose|went with|picked|settled on)\b",
        r"\bi'?m going (to|with)\b",
        r"\bbetter (to|than|approach|option|choice)\b",
        r"\binstead of\b",
        r"\brather than\b",
        r"\bthe reason (is|was|being)\b",
        r"\bbecause\b",
        r"\btrade-?off\b",
        r"\bpros and cons\b",
        r"\bover\b.*\bbecause\b",
        r"\barchitecture\b",
        r"\bapproach\b",
        r"\bstrategy\b",
        r"\bpattern\b",
        r"\bstack\b",
        r"\bframework\b",
        r"\binfrastructure\b",
        r"\bset (it |this )?to\b",
        r"\bconfigure\b",
        r"\bdefault\b",
    ],
    "preference": [
        r"\bi prefer\b",
        r"\balways use\b",
        r"\bnever use\b",
        r"\bdon'?t (ever |like to )?(use|do|mock|stub|import)\b",
        r"\bi like (to|when|how)\b",
        r"\bi hate (when|how|it when)\b",
        r"\bplease (always|never|don'?t)\b",
        r"\bmy (rule|preference|style|convention) is\b",
        r"\bwe (always|never)\b",
        r"\bfunctional\b.*\bstyle\b",
        r"\bimperative\b",
        r"\bsnake_?case\b",
        r"\bcamel_?case\b",
        r"\btabs\b.*\bspaces\b",
        r"\bspaces\b.*\btabs\b",
        r"\buse\b.*\binstead of\b",
    ],
    "milestone": [
        r"\bit works\b",
        r"\bit worked\b",
        r"\bgot it working\b",
        r"\bfixed\b",
        r"\bsolved\b",
        r"\bbreakthrough\b",
        r"\bfigured (it )?out\b",
        r"\bnailed it\b",
        r"\bcracked (it|the)\b",
        r"\bfinally\b",
        r"\bfirst time\b",
        r"\bfirst ever\b",
        r"\bnever (done|been|had) before\b",
        r"\bdiscovered\b",
        r"\brealized\b",
        r"\bfound (out|that)\b",
        r"\bturns out\b",
        r"\bthe key (is|was|insight)\b",
        r"\bthe trick (is|was)\b",
        r"\bnow i (understand|see|get it)\b",
        r"\bbuilt\b",
        r"\bcreated\b",
        r"\bimplemented\b",
        r"\bshipped\b",
        r"\blaunched\b",
        r"\bdeployed\b",
        r"\breleased\b",
        r"\bprototype\b",
        r"\bproof of concept\b",
        r"\bdemo\b",
        r"\bversion \d",
        r"\bv\d+\.\d+",
        r"\d+x (compression|faster|slower|better|improvement|reduction)",
        r"\d+% (reduction|improvement|faster|better|smaller)",
    ],
    "problem": [
        r"\b(bug|error|crash|fail|broke|broken|issue|problem)\b",
        r"\bdoesn'?t work\b",
        r"\bnot working\b",
        r"\bwon'?t\b.*\bwork\b",
        r"\bkeeps? (failing|crashing|breaking|erroring)\b",
        r"\broot cause\b",
        r"\bthe (problem|issue|bug) (is|was)\b",
        r"\bturns out\b.*\b(was|because|due to)\b",
        r"\bthe fix (is|was)\b",
        r"\bworkaround\b",
        r"\bthat'?s why\b",
        r"\bthe reason it\b",
        r"\bfixed (it |the |by )\b",
        r"\bsolution (is|was)\b",
        r"\bresolved\b",
        r"\bpatched\b",
        r"\bthe answer (is|was)\b",
        r"\b(had|need) to\b.*\binstead\b",
    ],
    "emotional": [
        r"\blove\b",
        r"\bscared\b",
        r"\bafraid\b",
        r"\bproud\b",
        r"\bhurt\b",
        r"\bhappy\b",
        r"\bsad\b",
        r"\bcry\b",
        r"\bcrying\b",
        r"\bmiss\b",
        r"\bsorry\b",
        r"\bgrateful\b",
        r"\bangry\b",
        r"\bworried\b",
        r"\blonely\b",
        r"\bbeautiful\b",
        r"\bamazing\b",
        r"\bwonderful\b",
        r"i feel",
        r"i'm scared",
        r"i love you",
        r"i'm sorry",
        r"i can't",
        r"i wish",
        r"i miss",
        r"i need",
        r"never told anyone",
        r"nobody knows",
        r"\*[^*]+\*",
    ],
}

#: Expressions of preference, concern and memory in a user's turns.
PREFERENCES = [
    r"i(?:'ve been| have been) having (?:trouble|issues?|problems?) with ([^,\.!?]{5,80})",
    r"i(?:'ve been| have been) feeling ([^,\.!?]{5,60})",
    r"i(?:'ve been| have been) (?:struggling|dealing) with ([^,\.!?]{5,80})",
    r"i(?:'ve been| have been) (?:worried|concerned) about ([^,\.!?]{5,80})",
    r"i(?:'m| am) (?:worried|concerned) about ([^,\.!?]{5,80})",
    r"i prefer ([^,\.!?]{5,60})",
    r"i usually ([^,\.!?]{5,60})",
    r"i(?:'ve been| have been) (?:trying|attempting) to ([^,\.!?]{5,80})",
    r"i(?:'ve been| have been) (?:considering|thinking about) ([^,\.!?]{5,80})",
    r"lately[,\s]+(?:i've been|i have been|i'm|i am) ([^,\.!?]{5,80})",
    r"recently[,\s]+(?:i've been|i have been|i'm|i am) ([^,\.!?]{5,80})",
    r"i(?:'ve been| have been) (?:working on|focused on|interested in) ([^,\.!?]{5,80})",
    r"i want to ([^,\.!?]{5,60})",
    r"i(?:'m| am) looking (?:to|for) ([^,\.!?]{5,60})",
    r"i(?:'m| am) thinking (?:about|of) ([^,\.!?]{5,60})",
    r"i(?:'ve been| have been) (?:noticing|experiencing) ([^,\.!?]{5,80})",
    r"i (?:still )?remember (?:the |my )?([^,\.!?]{5,80})",
    r"i used to ([^,\.!?]{5,60})",
    r"when i was (?:in high school|in college|young|a kid|growing up)[,\s]+([^,\.!?]{5,80})",
    r"growing up[,\s]+([^,\.!?]{5,80})",
    r"((?:happy|fond|good|positive) (?:high school|college|childhood|school) (?:experience|memory|memories|time)[^,\.!?]{0,60})",
]
MOST_PREFERENCES = 12

#: Fixed value: phrases of work done.
ACTIONS = r"(?i)((?:built|fixed|wrote|added|pushed|tested|created|decided|migrated|reviewed|deployed|configured|removed|updated)\s+[A-Za-z0-9_\s]{3,40})"
QUOTES = r'"([^"]{15,150})"'


def keyword_class(text: Column, sets: dict[str, list[str]], otherwise: str) -> Column:
    """The set with most keywords in the lower-cased text; equal scores go to the set declared first, none to *otherwise*."""
    low = F.lower(text)
    scores = {k: reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words]) for k, words in sets.items()}
    best = F.greatest(*scores.values())
    out = F.when(best == 0, F.lit(otherwise))
    for k, s in scores.items():
        out = out.when(s == best, F.lit(k))
    return out


def literal_of(pattern: str) -> str:
    """The longest literal run that every match of a simple pattern holds; the empty text if there is none."""
    plain = re.sub(r"\\[bd]|\\\*", "\0", pattern)
    while (inner := re.sub(r"\([^()]*\)\??|\[[^\]]*\][+*?]?", "\0", plain)) != plain:
        plain = inner
    plain = re.sub(r".[?*]|[.+]", "\0", plain)
    return max(plain.split("\0"), key=len) if "|" not in plain else ""


def _counted(low: Column, pattern: str) -> Column:
    """How often a pattern matches; it is tried only where its literal stands."""
    word = literal_of(pattern)
    count = F.regexp_count(low, F.lit(pattern))
    return F.when(F.contains(low, F.lit(word)), count).otherwise(0) if word else count


def marker_scores(text: Column) -> dict[str, Column]:
    """For each memory type how often its markers match."""
    low = F.lower(text)
    return {k: reduce(lambda a, b: a + b, [_counted(low, p) for p in patterns]) for k, patterns in MARKERS.items()}


def memory_types(df: DataFrame, text: str = "document", least: float = 0.3) -> DataFrame:
    """Adds the scores, the best type (declared order among equals) and its confidence: markers plus a length bonus, over 5."""
    scores = marker_scores(F.col(text))
    out = df.withColumns({f"{k}_score": s for k, s in scores.items()})
    best = F.greatest(*[F.col(f"{k}_score") for k in scores])
    bonus = F.when(F.length(text) > 500, 2).when(F.length(text) > 200, 1).otherwise(0)
    kind = F.when(best == 0, F.lit(None).cast("string"))
    for k in scores:
        kind = kind.when(F.col(f"{k}_score") == best, F.lit(k))
    confidence = F.when(best > 0, F.least(F.lit(1.0), (best + bonus) / 5.0)).otherwise(0.0)
    return out.withColumn("confidence", confidence).withColumn("memory_type", F.when(confidence >= least, kind))


def preferences(text: Column) -> Column:
    """Distinct expressions in order of patterns, trimmed, at most 12 (the feature's own bound)."""
    low = F.lower(text)
    found = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), 1) for p in PREFERENCES]))
    clean = F.transform(found, lambda x: F.regexp_replace(strip(x), r"[.,;!? ]+$", ""))
    return F.slice(F.array_distinct(F.filter(clean, lambda x: F.length(x).between(5, 80))), 1, MOST_PREFERENCES)


def entity_candidates(docs: DataFrame, least: int = 3, key: str | None = None, text: str = "document") -> DataFrame:
    """Capitalised words of two letters or more and how often they occur, by document or over all."""
    words = docs.select(*([key] if key else []), F.explode(F.regexp_extract_all(text, F.lit(r"(?:^|[^\p{L}])(\p{Lu}\p{Ll}+)"), 1)).alias("word"))
    return words.groupBy(*([key] if key else []), "word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def themes(messages: DataFrame, key: str, text: str, stop: list[str], most: int = 3) -> DataFrame:
    """The most frequent words of four letters or more for each key; equal counts go by the alphabet."""
    from .collection import top

    words = messages.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)).alias("word"))
    kept = words.where((F.length("word") >= 4) & F.rlike("word", F.lit(r"^\p{L}+$")) & ~F.col("word").isin(stop))
    return top(kept.groupBy(key, "word").agg(F.count("*").alias("n")), most, [F.col("n").desc(), F.col("word")], [key])


def actions(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ACTIONS), 1), lambda x: F.lower(strip(x))))


def quotes(text: Column) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit(QUOTES), 1), 1, 3)
