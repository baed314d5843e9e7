"""Known names in texts, whatever the number of names and of their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


#: Names up to which they are broadcast, by count; more are joined by shuffles.
BROADCAST_NAMES = 100_000


def known_names(texts: DataFrame, words: str, key: str, names: DataFrame, form: str) -> DataFrame:
    """(key, name) for each text (key, *words* array) in which the words of a name (name, *form* array) stand one after another.

    Texts meet names by their first two words, or by the one they have: an equality join of each text's distinct words
    and pairs of words, so its rows don't grow with the names' length. Up to BROADCAST_NAMES names go to the texts; so
    only what is met is shuffled, not all words. Names of three words or more are looked for in the text itself,
    which is fetched once for all names. Names without a word are met nowhere.
    """
    pairs = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
    starts = texts.select(key, F.explode(F.array_distinct(F.concat(words, pairs))).alias("__s"))
    forms = names.where(F.size(form) > 0).select("name", _joined(F.slice(form, 1, 2)).alias("__s"), F.size(form).alias("__n"), _joined(F.col(form)).alias("__f")).distinct()
    if forms.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        forms = F.broadcast(forms)
    met = starts.join(forms, "__s").groupBy(key).agg(F.collect_set(F.struct("name", F.when(F.col("__n") > 2, F.col("__f")).alias("__f"))).alias("__names"))
    spaced = texts.select(key, F.concat(F.lit(" "), _joined(F.col(words)), F.lit(" ")).alias("__t"))
    stands = lambda n: n["__f"].isNull() | F.contains("__t", F.concat(F.lit(" "), n["__f"], F.lit(" ")))
    return spaced.join(met, key).select(key, F.explode(F.filter("__names", stands)).alias("__x")).select(key, F.col("__x.name").alias("name")).distinct()
