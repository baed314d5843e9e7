"""Column functions on text: tokens, ids, previews, clean-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode letters, digits and the underscore, two or more; the same class works in every engine used here.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def r6(x: Column) -> Column:
    """Rounds to six digits by floor, which engines agree on."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def strip(text: Column) -> Column:
    """Without white space at both ends; trim() alone knows spaces only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def short_hash(n: int, *parts: Column) -> Column:
    return F.substring(F.sha2(F.concat(*parts), 256), 1, n)


def entity_id(name: Column) -> Column:
    """Graph id of a name: lower case, spaces to underscores, no apostrophes."""
    return F.regexp_replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), "'", "")


def entity_slug(name: Column) -> Column:
    """Store id of a name: quotes go, other runs become one underscore."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(name), "['\"]", ""), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def tunnel_id(wing_a: Column, room_a: Column, wing_b: Column, room_b: Column) -> Column:
    """Undirected id of a pair of endpoints."""
    a, b = F.concat_ws("/", wing_a, room_a), F.concat_ws("/", wing_b, room_b)
    return F.substring(F.sha2(F.concat(F.least(a, b), F.lit("↔"), F.greatest(a, b)), 256), 1, 16)


def overlap(text: Column, keywords: list[str]) -> Column:
    """Fraction of keywords that are substrings of the lower-cased text; repeated keywords count again."""
    if not keywords:
        return F.lit(0.0)
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(k)).cast("int") for k in keywords]) / F.lit(float(len(keywords)))


def trigrams(name: Column) -> Column:
    """Distinct character triples of a lower-cased name with two marks before and one after."""
    padded = F.concat(F.lit("  "), F.lower(name), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


# --- named clean-up steps --------------------------------------------------------------------------------------------


def newline_normalise(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n")


def line_trim(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: strip(x)), "\n")


def blank_drop(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: F.length(strip(x)) > 0), "\n")


def line_join_spaces(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: strip(x)), lambda x: F.length(x) > 0), " ")


def blank_collapse(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def utf8_replace_invalid(raw: Column) -> Column:
    return F.make_valid_utf8(raw.cast("string"))


TRANSFORMATIONS = {
    "utf8_replace_invalid": utf8_replace_invalid,
    "newline_normalize": newline_normalise,
    "whitespace_trim": strip,
    "whitespace_collapse_internal": blank_collapse,
    "line_trim": line_trim,
    "line_join_spaces": line_join_spaces,
    "blank_line_drop": blank_drop,
}


def transform_by_names(text: Column, names: list[str]) -> Column:
    unknown = [n for n in names if n not in TRANSFORMATIONS]
    if unknown:
        raise KeyError(f"unknown transformations: {unknown}")
    return reduce(lambda x, n: TRANSFORMATIONS[n](x), names, text)


# --- noise of tool transcripts ---------------------------------------------------------------------------------------

#: Tags and line beginnings that are removed.
NOISE_TAGS = ("system-reminder", "command-message", "command-name", "task-notification", "user-prompt-submit-hook", "hook_output")
NOISE_PREFIXES = (
    "CURRENT TIME:",
    "VERIFIED FACTS (do not contradict)",
    "AGENT SPECIALIZATION:",
    "Checking verified facts...",
    "Injecting timestamp...",
    "Starting background pipeline...",
    "Checking emotional weights...",
    "Auto-save reminder...",
    "Checking pipeline...",
)
HOOKS = ("Stop", "PreCompact", "PreToolUse", "PostToolUse", "UserPromptSubmit", "Notification", "SessionStart", "SessionEnd")


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in ".()[]+*?^$|{}\\" else c for c in s)


def strip_noise(text: Column, banners: tuple[str, ...] = ()) -> Column:
    """Removes tagged blocks (within a paragraph), noise lines, hook lines and fold marks; *banners* adds line beginnings."""
    for tag in NOISE_TAGS:
        text = F.regexp_replace(text, rf"(?m)^(?:> )?<{tag}(?:\s[^>]*)?>(?:(?!\n\s*\n)[\s\S])*?</{tag}>[ \t]*\n?", "")
    lines = "|".join([*map(_quoted, NOISE_PREFIXES + banners), rf"Ran [0-9]+ (?:{'|'.join(HOOKS)}) hook", r"…\s*\+[0-9]+ lines"])
    text = F.regexp_replace(text, rf"(?m)^(?:> )?(?:{lines})[^\n]*\n?", "")
    text = F.regexp_replace(text, r"\s*\[[0-9]+\s+tokens?\]\s*\(ctrl\+o to expand\)", "")
    return strip(F.regexp_replace(text, "\n{4,}", "\n\n\n"))


# --- queries and answers ---------------------------------------------------------------------------------------------

#: Lengths up to which a query is taken as it is, is not trimmed, and below which a part is no query.
SAFE_QUERY, LONGEST_QUERY, SHORTEST_QUERY = 200, 250, 10
_ENDS = "[.!?。！？\n]+"


def _last(parts: Column) -> Column:
    return F.try_element_at(parts, F.lit(-1))


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _unwrapped(x: Column) -> Column:
    return F.when(F.rlike(x, F.lit(r"""(?s)^(["']).*\1$""")) & (F.length(x) >= 2), strip(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(x)


def unquoted(x: Column) -> Column:
    """Without wrapping quotes (up to four layers), then without one that is left at either end."""
    x = F.aggregate(F.array(*map(F.lit, range(4))), strip(x), lambda y, _: _unwrapped(y))
    return strip(F.regexp_replace(strip(F.regexp_replace(x, r"""^["']""", "")), r"""["']$""", ""))


def _trimmed(x: Column) -> Column:
    def cut(y: Column) -> Column:
        parts = F.filter(F.transform(F.split(y, _ENDS), unquoted), lambda p: F.length(p).between(SHORTEST_QUERY, LONGEST_QUERY))
        return F.when(F.length(y) <= LONGEST_QUERY, y).otherwise(F.coalesce(_last(parts), strip(F.right(y, F.lit(LONGEST_QUERY)))))

    return let(unquoted(x), cut)


def sanitize_query(raw: Column) -> Column:
    """struct(clean_query, method): short ones as they are, else the last question, else the last part, else the end."""
    made = lambda x, method: F.struct(x.alias("clean_query"), F.lit(method).alias("method"))

    def chosen(v: Column) -> Column:
        q, question, tail = v["q"], v["question"], v["tail"]
        return (
            F.when(F.length(q) <= SAFE_QUERY, made(q, "passthrough"))
            .when(F.length(question) >= SHORTEST_QUERY, F.when(F.length(question) > LONGEST_QUERY, made(_trimmed(question), "question_extraction")).otherwise(made(question, "question_extraction")))
            .when(tail.isNotNull(), made(tail, "tail_sentence"))
            .otherwise(made(strip(F.right(q, F.lit(LONGEST_QUERY))), "tail_truncation"))
        )

    def parts(q: Column) -> Column:
        def of(lines: Column) -> Column:
            question = _last(F.filter(lines, lambda s: F.rlike(s, F.lit(r"""[?？]\s*["']?\s*$"""))))
            tail = _last(F.filter(F.transform(F.filter(lines, lambda s: F.length(s) >= SHORTEST_QUERY), _trimmed), lambda s: F.length(s) >= SHORTEST_QUERY))
            return F.struct(q.alias("q"), question.alias("question"), tail.alias("tail"))

        return let(F.filter(F.transform(F.split(q, "\n"), strip), lambda s: F.length(s) > 0), of)

    return let(let(strip(F.coalesce(raw, F.lit(""))), parts), chosen)


#: Characters of words and white space of any script, as \b and \s know those of ASCII only.
_WORD, _SPACE = r"[\p{L}\p{N}_]", r"[\s\x1c-\x1f\x85\p{Z}]"


def normalised_answer(answer: Column) -> Column:
    """Without commas, articles and ASCII punctuation, one space between words, lower case."""
    articles = rf"(?<!{_WORD})(?:a|an|the|and)(?!{_WORD})"
    words = F.regexp_replace(F.regexp_replace(F.replace(answer, F.lit(","), F.lit("")), articles, " "), f"{_SPACE}+", " ")
    return F.trim(F.lower(F.regexp_replace(words, r"[!-/:-@\[-`{-~]", "")))
