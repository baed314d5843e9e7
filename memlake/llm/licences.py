"""Licence scan over a positional index of rare words (operator 3).

The templates are indexed once: word -> (template, place). Each file is a query against this index. Its licence words are
ranked by inverse document frequency over the whole corpus and looked up from the rarest on:

1. The postings count, for each template, its words that the file holds. Only a template that the file covers can stand.
2. The rarest of its words opens a covered template: each place in the file less the place in the template is a start.
   Every further word, still from the rarest on, keeps the starts at which it stands in its place, until none is left.
3. What is left is verified word by word. A base phrase stands at every start so found, since all its words are
   mandatory. A notice stands if all its key phrases stand in order, with at most GAP words between neighbours.

The score is 1 with a label. Without one it is the greatest share of a template's weight (the sum of its words' inverse
document frequencies) that stands in place about one start, if that is at least HALF, and else 0.

Null and empty texts have no words, no labels and score 0. Ties between words of one frequency go by the word; between
notices of one label none matters. Rows repeat as often as they come. Texts are read whole; time is linear in their
words. An empty table gives no rows. Columns are taken by position, so others may have any names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: For each further label, notices as lists of mandatory key phrases, in the order in which they stand.
NOTICES = {
    "agpl-3": [["gnu affero general public license", "version 3"]],
    "apache-2": [["licensed under the apache license version 2 0"]],
    "bsd": [["redistribution and use in source and binary forms", "with or without modification", "are permitted"], ["under the bsd license"]],
    "cc-by": [["creative commons attribution", "international license"]],
    "cc-by-nc": [["creative commons attribution noncommercial"]],
    "gpl-2": [["gnu general public license", "version 2"]],
    "gpl-3": [["gnu general public license", "version 3"]],
    "isc": [["permission to use copy modify and or distribute this software", "with or without fee"]],
    "lgpl": [["gnu lesser general public license"]],
    "mit": [["permission is hereby granted free of charge", "to any person obtaining a copy"]],
    "mpl-2": [["mozilla public license", "version 2 0"], ["mozilla public license v 2 0"]],
    "unlicense": [["this is free and unencumbered software", "released into the public domain"]],
}

#: Words that may stand between two key phrases of a notice.
GAP = 12
#: The least share of a template's weight that counts without a label, and of how many rare words it is taken.
HALF = 0.5
RARE = 4
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs outside ASCII punctuation and space."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Index:
    """Postings of the template words. Every key phrase is a template; templates in order make notices."""

    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, list[list[str]]] = NOTICES):
        self.base = {tuple(words_of(p)): label for p, label in base.items()}
        self.notices = [(label, [tuple(words_of(p)) for p in parts]) for label, many in sorted(notices.items()) for parts in many]
        self.phrases = list(dict.fromkeys([*self.base, *(p for _, parts in self.notices for p in parts)]))
        self.number = {p: k for k, p in enumerate(self.phrases)}
        self.vocabulary = frozenset(w for p in self.phrases for w in p)
        self.kinds = [len(set(p)) for p in self.phrases]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, phrase in enumerate(self.phrases):
            for place, word in enumerate(phrase):
                self.postings[word].append((k, place))

    def weigh(self, idf: dict[bytes, float]) -> None:
        """Takes the inverse document frequencies of the vocabulary."""
        self.idf = idf
        self.rank = {w: i for i, w in enumerate(sorted(self.vocabulary, key=lambda w: (-idf.get(w, 0.0), w)))}
        self.weight = [sum(idf.get(w, 0.0) for w in p) or 1.0 for p in self.phrases]

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first, last, base labels, labels, score."""
        words = words_of(text)
        rare = sorted(self.vocabulary.intersection(words), key=self.rank.__getitem__)
        hits: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
        for word in rare:
            for k, place in self.postings[word]:
                hits[k].setdefault(word, []).append(place)
        covered = [k for k, own in hits.items() if len(own) == self.kinds[k]]
        partly = [k for k, own in hits.items() if sum(self.idf.get(w, 0.0) * len(p) for w, p in own.items()) >= HALF * self.weight[k]]
        needed = {w for k in {*covered, *partly} for w in hits[k]}
        places: dict[bytes, list[int]] = defaultdict(list)
        if needed:
            for at, word in enumerate(words):
                if word in needed:
                    places[word].append(at)
        found = {k: starts for k in covered if (starts := self._starts(k, hits[k], places, words))}
        starts, base, labels = [], set(), set()
        for phrase, label in self.base.items():
            if own := found.get(self.number[phrase]):
                starts += own
                base.add(label)
        for label, parts in self.notices:
            if label not in labels and self._in_order(parts, found):
                labels.add(label)
        score = 1.0 if base or labels else max((self._share(k, hits[k], places) for k in partly), default=0.0)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score

    def _starts(self, k: int, own: dict[bytes, list[int]], places: dict[bytes, list[int]], words: list[bytes]) -> list[int]:
        """Where a covered template stands: its words' postings intersected by relative position, the rarest first."""
        starts: set[int] | None = None
        for word, offsets in own.items():
            for offset in offsets:
                begun = {at - offset for at in places[word]}
                starts = begun if starts is None else starts & begun
            if not starts:
                return []
        phrase = self.phrases[k]
        return sorted(s for s in starts if s >= 0 and tuple(words[s : s + len(phrase)]) == phrase)

    def _share(self, k: int, own: dict[bytes, list[int]], places: dict[bytes, list[int]]) -> float:
        """The greatest share of the template's weight that stands about one start, by its RARE rarest words, if HALF or more."""
        votes: dict[int, float] = defaultdict(float)
        for word in list(own)[:RARE]:
            for offset in own[word]:
                for at in places[word]:
                    votes[at - offset] += self.idf.get(word, 0.0)
        share = max(votes.values()) / self.weight[k]
        return min(share, 0.99) if share >= HALF else 0.0

    def _in_order(self, parts: list[tuple], found: dict[int, list[int]]) -> bool:
        """True if all parts stand in order with at most GAP words between neighbours; starts are in ascending order."""
        ends: list[int] | None = None
        for part in parts:
            starts = found.get(self.number[part], [])
            if ends is not None:  # the nearest end at or before a start decides
                starts = [s for s in starts if (i := bisect_right(ends, s)) and s - ends[i - 1] <= GAP]
            if not starts:
                return False
            ends = [s + len(part) for s in starts]
        return True


def document_frequency(docs: DataFrame, text_col: str, index: Index) -> tuple[int, dict[bytes, int]]:
    """Number of documents and, for each template word, of those that hold it, over all documents.

    The vocabulary bounds what reaches the driver: one array of counts per partition is summed before.
    """
    vocabulary = sorted(index.vocabulary)
    place = {w: i for i, w in enumerate(vocabulary)}
    n = len(vocabulary)

    def counted(texts: list[str | None]) -> list:
        counts = [0] * (n + 1)
        for text in texts:
            counts[n] += 1
            for w in index.vocabulary.intersection(words_of(text)):
                counts[place[w]] += 1
        rows = [(i, c) for i, c in enumerate(counts) if c] or [(n, 0)]
        return [[[{"word": i, "n": c} for i, c in rows]] + [None] * (len(texts) - 1)]

    per_slice = map_texts(docs, [], text_col, counted, [("counts", "array<struct<word:int,n:long>>")])
    rows = per_slice.select(F.inline("counts")).groupBy("word").agg(F.sum("n").alias("n")).collect()
    totals = {r["word"]: r["n"] for r in rows}
    return totals.get(n, 0), {w: totals.get(i, 0) for w, i in place.items()}


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, places of base phrases, labels and a score from 0 to 1."""
    index = Index()
    n, df = document_frequency(docs, text_col, index)
    idf = {w: math.log((n + 1) / (c + 1)) + 1e-3 for w, c in df.items()}
    index.weigh(idf)

    def scanned(texts: list[str | None]) -> list:
        return [list(x) for x in zip(*map(index.scan, texts))]

    fields = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]
    return map_texts(docs, [id_col], text_col, scanned, fields)
