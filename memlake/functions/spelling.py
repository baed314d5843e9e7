"""Spelling of what people write: rules of what is left alone, and a pluggable corrector; without one, texts stay as they are."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The shortest word that is looked at, and how far a correction may be from a word of up to seven letters, or a longer one.
SHORTEST, SHORT_WORD, NEAR, NEARER = 4, 7, 2, 3
#: Tokens that are left alone: numbers, joined names, shouts, terms with marks, addresses, code and pictures.
LEFT = [r"\d", r"[A-Z][a-z]+[A-Z]", r"^[A-Z_@#$%^&*()+=\[\]{}|<>?.:/\\]+$", r"[-_]", r"(?i:https?://|www\.|/Users/|~/|\.[a-z]{2,4}$)", r"[`*_#{}\[\]\\]"]
_LEFT = re.compile("|".join(f"(?:{p})" for p in LEFT))
_ENDS = ".,!?;:'\")"


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def is_left_alone(token: str, known: frozenset[str], words: frozenset[str]) -> bool:
    low = token.lower()
    return len(token) < SHORTEST or token[0].isupper() or low in known or low in words or _LEFT.search(token) is not None


def corrected_text(text: str, speller: Callable[[str], str], known: frozenset[str], words: frozenset[str]) -> str:
    """The text with its words corrected, white space and marks as they were; corrections that lead far away are not taken."""

    def fixed(m: re.Match) -> str:
        token = m[0].rstrip(_ENDS)
        if not token or is_left_alone(token, known, words):
            return m[0]
        new = speller(token)
        return (new if distance(token, new) <= (NEAR if len(token) <= SHORT_WORD else NEARER) else token) + m[0][len(token) :]

    return re.sub(r"\S+", fixed, text)


def corrected(df: DataFrame, text: str = "text", speller: Callable[[str], str] | None = None, known: Iterable[str] = (), words: Iterable[str] = ()) -> DataFrame:
    """The rows with *text* corrected, in Arrow batches. *known* names and dictionary *words* are left alone."""
    if speller is None:
        return df
    names, dictionary = frozenset(k.lower() for k in known), frozenset(w.lower() for w in words)

    @F.pandas_udf("string")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else corrected_text(t, speller, names, dictionary))

    return df.withColumn(text, made(F.col(text)))
