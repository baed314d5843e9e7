"""Column functions on dates held as ISO strings, and relative-time phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrase, days back (the number in the phrase times this, or this), tolerance in days; the first match counts.
PHRASES = (
    (r"([0-9]+)\s+days?\s+ago", 1, True, 2),
    (r"a\s+couple\s+(?:of\s+)?days?\s+ago", 2, False, 2),
    (r"yesterday", 1, False, 1),
    (r"a\s+week\s+ago", 7, False, 3),
    (r"([0-9]+)\s+weeks?\s+ago", 7, True, 5),
    (r"last\s+week", 7, False, 3),
    (r"a\s+month\s+ago", 30, False, 7),
    (r"([0-9]+)\s+months?\s+ago", 30, True, 10),
    (r"last\s+month", 30, False, 7),
    (r"last\s+year", 365, False, 30),
    (r"a\s+year\s+ago", 365, False, 30),
    (r"recently", 14, False, 14),
)


def _valid(text: Column, pattern: str) -> Column:
    return F.date_format(F.try_to_date(text, pattern), "yyyy-MM-dd")


def date_from_name(path: Column) -> Column:
    """ISO date in a file name, else 8 digits that no digit touches; null if there is none or it is no date."""
    name = F.element_at(F.split(path, "/"), -1)
    iso = F.regexp_extract(name, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    compact = F.regexp_extract(name, r"(?:^|[^0-9])([0-9]{8})(?:[^0-9]|$)", 1)
    return F.coalesce(_valid(iso, "yyyy-MM-dd"), _valid(compact, "yyyyMMdd"))


def date_from_text(text: Column, within: int = 5000) -> Column:
    """Earliest valid ISO date among the first characters (the window is the feature)."""
    found = F.regexp_extract_all(F.substring(text, 1, within), F.lit(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), 0)
    return F.array_min(F.filter(found, lambda d: F.try_to_date(d, "yyyy-MM-dd").isNotNull()))


def date_from_json_line(line: Column) -> Column:
    """Date of the first of several keys of a JSON line: ISO text, or epoch seconds or milliseconds (UTC)."""
    keys = ("timestamp", "created_at", "create_time", "date", "time", "ts")
    raw = F.coalesce(*[F.get_json_object(line, f"$.{k}") for k in keys])
    number = raw.try_cast("double")
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"), _valid(F.substring(raw, 1, 10), "yyyy-MM-dd"))


def resolve_occurred_at(path: Column, first_line: Column, filed_at: Column, today: Column) -> Column:
    """File name, else first JSON line, else filing date, else today."""
    return F.coalesce(date_from_name(path), date_from_json_line(first_line), _valid(F.substring(filed_at, 1, 10), "yyyy-MM-dd"), today)


def relative_days(question: Column) -> Column:
    """struct(days, tolerance) of the first phrase that occurs, or null."""
    low, out = F.lower(question), None
    for pattern, days, counted, tolerance in PHRASES:
        n = F.regexp_extract(low, pattern, 1).try_cast("int") * days if counted else F.lit(days)
        value = F.struct(n.cast("int").alias("days"), F.lit(tolerance).alias("tolerance"))
        out = F.when(F.rlike(low, F.lit(pattern)), value) if out is None else out.when(F.rlike(low, F.lit(pattern)), value)
    return out


def temporal_factor(question_date: Column, doc_date: Column, days: Column, tolerance: Column, most: float = 0.40) -> Column:
    """1 - most within the tolerance of the target day, rising in a line to 1 at three times the tolerance."""
    off = F.abs(F.datediff(doc_date, F.date_sub(question_date, days)))
    return F.when(off <= tolerance, F.lit(1.0 - most)).when(off <= tolerance * 3, F.lit(1.0) - most * (F.lit(1.0) - (off - tolerance) / (tolerance * 2))).otherwise(F.lit(1.0))
