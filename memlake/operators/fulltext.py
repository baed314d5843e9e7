"""Full-text match with AND, OR, NOT, phrases and stems, ranked by cover density, on positional postings.

Words are runs of letters, digits and underscores, lower-cased; stop words have a position but aren't kept. Stems are those
of the first step of Porter's rules (plural, past, gerund, final y), not of the later ones.

A question is words and "phrases" that must all be met, ``-`` before one that must not, and ``or`` between such groups;
stop words in it count for distances within a phrase only. A text matches if one of the groups does; a group without
anything to be met matches nothing. A cover is a shortest stretch of positions that holds all of a matched group, and
that no other cover lies within. Each adds a tenth over one plus its positions that hold none of the question's words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .collection import top
from .lexical import PIECE, Index, alike, asked_of, for_all, write_index

WORD = r"[\p{L}\p{N}_]+"

#: Words of English too common to be kept.
STOP = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she",
    "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further",
    "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
]

#: The stemmer: (pattern, groups that stay, text put behind), tried one after another on words of a to z. The same in all engines used here.
STEMS = [
    (r"^(.*(?:ss|i))es$", 1, ""),
    (r"^(.*[^s])s$", 1, ""),
    (r"^(.*[aeiouy][^aeiou].*ee)d$", 1, ""),
    (r"^(.*(?:at|iz)|.*[aeiouy].*bl)(?:ed|ing)$", 1, "e"),
    (r"^(.*[aeiouy].*)(?:(b)b|(d)d|(f)f|(g)g|(m)m)(?:ed|ing)$", 6, ""),
    (r"^(.*[aeiouy].*)(?:(n)n|(p)p|(r)r|(t)t)(?:ed|ing)$", 5, ""),
    (r"^(.*[aeiouy].*[^e]|.*[aiouy])ed$", 1, ""),
    (r"^(.*[aeiouy].*)ing$", 1, ""),
    (r"^(.*[aeiouy].*)y$", 1, "i"),
]
#: Words of fewer letters stay as they are.
SHORT = 3
#: Words whose stems a task keeps.
KNOWN = 200_000


def stem_rules(put: str) -> list[tuple[str, str]]:
    """The stemmer as replacements; *put* is how an engine writes a group's number."""
    return [(p, "".join(put.format(i) for i in range(1, n + 1)) + tail) for p, n, tail in STEMS]


_RULES = [(re.compile(pattern), put) for pattern, put in stem_rules("\\g<{}>")]


def stem(word: str) -> str:
    if word[-1:] in ("s", "d", "g", "y") and len(word) >= SHORT and word.isascii() and word.isalpha():  # no rule ends in another letter
        for pattern, put in _RULES:
            word = pattern.sub(put, word)
    return word


def stem_column(word: Column) -> Column:
    plain = F.rlike(word, F.lit(r"^[a-z]{3,}$"))
    return F.when(plain, reduce(lambda w, rule: F.regexp_replace(w, *rule), stem_rules("$" + "{}"), word)).otherwise(word)


def postings(docs: DataFrame, key: str = "id", text: str = "document") -> DataFrame:
    """(term, key, positions, dl, first) for every distinct lexeme of every text, positions from 1; one row with a null term for a text without any."""
    id_type = docs.schema[key].dataType.simpleString()
    word = regex.compile(WORD)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop, known = set(STOP), {}
        for batch in batches:
            index, terms, positions, lengths, firsts = [], [], [], [], []
            held = 0
            for i, t in enumerate(batch.column(1)):
                words = word.findall((t.as_py() or "").lower())
                found: dict[str, list[int]] = {}
                for at, w in enumerate(words, 1):
                    if w not in stop:
                        if w not in known:
                            if len(known) > KNOWN:
                                known.clear()
                            known[w] = stem(w)
                        found.setdefault(known[w], []).append(at)
                n = max(1, len(found))
                index += [i] * n
                terms += list(found) or [None]
                positions += list(found.values()) or [[]]
                lengths += [len(words)] * n
                firsts += [True] + [False] * (n - 1)
                held += len(words) + 1
                if held >= PIECE or i == batch.num_rows - 1:
                    arrays = [pa.array(terms, pa.string()), batch.column(0).take(pa.array(index, pa.int64())), pa.array(positions, pa.list_(pa.int32())), pa.array(lengths, pa.int64()), pa.array(firsts, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["term", key, "positions", "dl", "first"])
                    index, terms, positions, lengths, firsts, held = [], [], [], [], [], 0

    return docs.select(key, text).mapInArrow(counted, f"term string, `{key}` {id_type}, positions array<int>, dl long, first boolean")


def build(docs: DataFrame, folder: str, key: str = "id", text: str = "document") -> None:
    """Writes the index of all texts below *folder*; ``lexical.load`` reads it."""
    write_index(postings(docs, key, text), docs, folder, text)


def parsed(queries: DataFrame) -> DataFrame:
    """(qid, grp, item, negated, offset, term, size, span) of every question (qid, question): the lexemes of its words and phrases.

    *offset* is a lexeme's place behind the first one of its phrase, *size* the phrase's number of lexemes, *span* its
    last offset.
    """
    # A quote that isn't closed ends the question.
    parts = F.regexp_extract_all(F.lower("question"), F.lit(r'-?"[^"]*"?|[^\s"]+'), F.lit(0))
    split = queries.select("qid", F.posexplode(parts).alias("item", "__part"))
    group = F.count_if(F.col("__part") == "or").over(Window.partitionBy("qid").orderBy("item"))
    items = split.select("qid", group.alias("grp"), "item", F.rlike("__part", F.lit("^-.")).alias("negated"), F.col("__part")).where("__part <> 'or'")
    words = F.regexp_extract_all("__part", F.lit(WORD), F.lit(0))
    placed = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("w"))), lambda x: ~x["w"].isin(STOP))
    kept = items.withColumn("__l", placed).where(F.size("__l") > 0)
    first, last = F.col("__l")[0]["at"], F.element_at("__l", -1)["at"]
    each = kept.select("qid", "grp", "item", "negated", F.size("__l").alias("size"), (last - first).alias("span"), first.alias("__first"), F.explode("__l").alias("__x"))
    return each.select("qid", "grp", "item", "negated", (F.col("__x.at") - F.col("__first")).alias("offset"), stem_column(F.col("__x.w")).alias("term"), "size", "span")


def covers(groups: list[list[list[tuple[int, int]]]]) -> list[tuple[int, int]]:
    """The shortest stretches that hold an occurrence (start, end) of every item of a group, without those that hold another."""
    found = []
    for items in groups:
        last: list[int | None] = [None] * len(items)
        before = 0
        for end, start, i in sorted((e, s, i) for i, own in enumerate(items) for s, e in own):
            last[i] = start if last[i] is None else max(last[i], start)
            if None not in last and min(last) > before:
                before = min(last)
                found.append((before, end))
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(found), key=lambda c: (-c[0], c[1])):
        if not out or b < out[-1][1]:
            out.append((a, b))
    return out[::-1]


def density(found: list[tuple[int, int]], positions: list[int]) -> float:
    """A tenth for each cover over one plus its positions that hold none of the sorted *positions*."""
    from bisect import bisect_left, bisect_right

    return sum(0.1 / (1 + b - a + 1 - (bisect_right(positions, b) - bisect_left(positions, a))) for a, b in found)


def match(index: Index, queries: DataFrame, key: str = "id", among: DataFrame | None = None) -> DataFrame:
    """(qid, key, covers, density) of the texts that match a question (qid, question); *among* restricts the texts."""
    forms, same = alike(queries.select("qid", "question"), "question")
    return for_all(_matched(index, forms, key, among), same)


def _matched(index: Index, queries: DataFrame, key: str, among: DataFrame | None) -> DataFrame:
    """Questions of different words matched. Postings are dealt by text once, before they meet the questions; what follows stays there."""
    asked = parsed(queries)
    hit, _, few = asked_of(index, asked)
    if among is not None:
        hit = hit.join(among.select(key), key, "left_semi")
    terms = F.broadcast(asked) if few else asked
    met = hit.select("term", key, "positions").repartition(key).join(terms, "term")
    starts = F.transform("positions", lambda p: p - F.col("offset"))
    # A phrase is met where the shifted positions of all its lexemes agree; rows of one text and phrase are as few as its lexemes.
    items = met.groupBy("qid", "grp", "item", "negated", "size", "span", key).agg(F.collect_list(starts).alias("__s"), F.flatten(F.collect_list("positions")).alias("positions")).where(F.size("__s") == F.col("size"))
    agreed = F.aggregate(F.slice("__s", 2, F.lit(1 << 30)), F.col("__s")[0], lambda a, b: F.array_intersect(a, b))
    items = items.withColumn("starts", agreed).where(F.size("starts") > 0)
    wanted = asked.groupBy("qid", "grp").agg(F.count_distinct(F.when(~F.col("negated"), F.col("item"))).alias("wanted")).where("wanted > 0")
    said = F.collect_list(F.when(~F.col("negated"), F.struct("starts", "span")))
    groups = items.groupBy("qid", "grp", key).agg(said.alias("items"), F.count_if("negated").alias("barred"), F.flatten(F.collect_list(F.when(~F.col("negated"), F.col("positions")))).alias("positions"))
    good = (F.col("barred") == 0) & (F.size("items") == F.col("wanted"))
    judged = groups.join(F.broadcast(wanted) if few else wanted, ["qid", "grp"])
    texts = judged.groupBy("qid", key).agg(F.collect_list(F.when(good, F.col("items"))).alias("groups"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions")).where(F.size("groups") > 0)
    types = f"qid {texts.schema['qid'].dataType.simpleString()}, `{key}` {texts.schema[key].dataType.simpleString()}"

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, scores = [], []
            for groups, positions in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = covers([[[(s, s + i["span"]) for s in i["starts"]] for i in items] for items in groups])
                n.append(len(found))
                scores.append(density(found, positions))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(scores, pa.float64())], names=["qid", key, "covers", "density"])

    return texts.mapInArrow(ranked, f"{types}, covers long, density double")


def search(index: Index, queries: DataFrame, k: int, key: str = "id", among: DataFrame | None = None) -> DataFrame:
    """(qid, key, covers, density, rank): the k best matches of every question by density, rounded to six digits, then by key."""
    forms, same = alike(queries.select("qid", "question"), "question")
    return for_all(top(_matched(index, forms, key, among), k, [F.floor(F.col("density") * 1e6 + 0.5).desc(), F.col(key)], ["qid"]), same)
