"""Checks of names and contents: on the driver for a single value, as columns for many."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

#: The longest name and content; what a name consists of, and that it begins and ends with a letter or digit.
LONGEST_NAME, LONGEST_CONTENT = 128, 100_000
NAME = r"^(?:[\p{L}\p{N}]|[\p{L}\p{N}][\p{L}\p{N}_ .'-]{0,126}[\p{L}\p{N}])$"
#: The bounds of a page and of a list of hits.
FEWEST, MOST = 1, 100


def _refused(value: Column, longest: int, path: bool, shape: bool) -> Column:
    """Why a trimmed value is refused; null if it is good."""
    why = F.when(F.coalesce(value, F.lit("")) == "", "empty").when(F.length(value) > longest, "too long")
    if path:
        why = why.when(F.contains(value, F.lit("..")) | F.contains(value, F.lit("/")) | F.contains(value, F.lit("\\")), "path characters")
    why = why.when(F.contains(value, F.lit("\0")), "null bytes")
    return why.when(~F.rlike(value, F.lit(NAME)), "characters") if shape else why


def name_fault(value: Column) -> Column:
    """Why a wing's, room's or entity's name is refused: empty, too long, path characters, null bytes, characters."""
    return let(strip(value), lambda x: _refused(x, LONGEST_NAME, True, True))


def value_fault(value: Column) -> Column:
    """Why an end of a fact is refused; these may hold any marks."""
    return let(strip(value), lambda x: _refused(x, LONGEST_NAME, False, False))


def content_fault(value: Column) -> Column:
    """Why a content is refused. Its length counts with white space."""
    return F.when(~F.rlike(F.coalesce(value, F.lit("")), F.lit(r"\S")), "empty").when(F.length(value) > LONGEST_CONTENT, "too long").when(F.contains(value, F.lit("\0")), "null bytes")


def checked_name(value: object, field: str = "name") -> str:
    """The trimmed name, or ValueError with the reason that name_fault would give."""
    import regex

    text = value.strip() if isinstance(value, str) else ""
    rules = [
        ("empty", not text),
        ("too long", len(text) > LONGEST_NAME),
        ("path characters", ".." in text or "/" in text or "\\" in text),
        ("null bytes", "\0" in text),
        ("characters", not regex.match(NAME, text)),
    ]
    for why, broken in rules:
        if broken:
            raise ValueError(f"{field}: {why}")
    return text


def optional_name(value: str | None, field: str = "name") -> str | None:
    """None for no name or a blank one, else as checked_name."""
    return checked_name(value, field) if value is not None and value.strip() else None


def page(limit: int, offset: int = 0) -> tuple[int, int]:
    """Limit and offset within their bounds."""
    return max(FEWEST, min(limit, MOST)), max(0, offset)
