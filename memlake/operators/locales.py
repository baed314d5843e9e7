"""Names and their signals by language: each text is read once, with the patterns of its own row's language.

A locale is data: patterns of one-word and of several-word names, words that are no names, and signals. English, German,
French and Spanish are here; others come from files by ``load``. What lies within a word is a letter, mark, digit or
underscore of any script, so that names that end in a combining mark are met whole.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .entities import CODE, ENGLISH, PRONOUNS, VERSIONED

INSIDE = r"\p{L}\p{M}\p{N}_"
WORD = rf"[{INSIDE}]+"
SPACE = r"[ \t\n\x0B\f\r]+"


class Locale(NamedTuple):
    candidate: str
    phrase: str
    stop: tuple[str, ...]
    pronouns: str
    signals: dict[str, list[str]]


def _alternatives(words: list[str]) -> str:
    return r"\b(" + "|".join(words) + r")\b"


def _locale(upper: str, lower: str, stop: str, pronouns: list[str], said: str, verbs: list[str], greetings: list[str], before: list[str]) -> Locale:
    """A locale of an alphabet with capitals; *verbs* follow a person's name, *greetings* and *before* stand in front of a name."""
    cap = f"[{upper}][{lower}]"
    spaced = lambda x: x.replace(" ", r"\s+")
    signals = {
        "dialogue": [r"^>\s*{name}[:\s]", r"^{name}:\s", r"^\[{name}\]", r'"{name}\s+' + spaced(said)],
        "action": [r"\b{name}\s+" + spaced(v) + r"\b" for v in verbs],
        "addressed": ["|".join(r"\b" + spaced(g) + r"\s+{name}\b" for g in greetings)],
        "verb": [r"\b" + spaced(v) + r"\s+{name}\b" for v in before] + [r"\b{name}\s+v\d+\b", r"\b{name}\.py\b"],
        "versioned": VERSIONED,
        "code": CODE,
    }
    return Locale(cap + "{1,19}", f"{cap}+(?:{SPACE}{cap}+)+", tuple(stop.split()), _alternatives(pronouns), signals)


#: Common words that begin sentences; a project's own list can take their place.
_EN_STOP = "the this that these those and or but if when where what which who how why a an in on at to from by with for of as is are was were be it its he she they we you i my your our their not no yes all some any each there here then than so do does did has have had will would can could should may"
_DE_STOP = "der die das ein eine eines einer einem einen den dem des und oder aber denn weil wenn als ob auch noch schon sehr viel nur nicht mehr kann wird hat ist sind war waren sein haben wurde mit von zu für auf in an um über nach durch bei aus seit vor ich du er sie es wir ihr wer was wann wo wie warum so dann jetzt hier dort da ja nein"
_FR_STOP = "le la les un une des de du au aux en et ou mais donc or ni car que qui ce cette ces son sa ses mon ma mes ton ta tes leur leurs nous vous il elle ils elles on ne pas plus très bien aussi avec pour dans sur par est sont être avoir comme tout tous toute toutes je tu quand où comment pourquoi oui non"
_ES_STOP = "el la los las un una unos unas de del al en con por para su sus mi mis tu tus es son está están fue ser estar haber sido como pero más muy también todo todos toda todas este esta estos estas ese esa esos esas que quien cual donde cuando porque aunque sin yo él ella ellos ellas se lo le les y o no sí"

LOCALES = {
    "en": Locale("[A-Z][a-z]{1,19}", f"[A-Z][a-z]+(?:{SPACE}[A-Z][a-z]+)+", tuple(_EN_STOP.split()), PRONOUNS, ENGLISH),
    # Pronouns, verbs of saying and doing, forms of address, words before a project.
    "de": _locale(
        "A-ZÄÖÜ", "a-zäöüß", _DE_STOP,
        ["er", "sie", "es", "ihn", "ihm", "ihr", "sein", "ihre", "ihnen"],
        "sagte",
        ["sagte", "fragte", "antwortete", "erzählte", "lachte", "lächelte", "weinte", "fühlte", "denkt", "will", "liebt", "hasst", "weiß", "entschied", "schrieb"],
        ["hallo", "hi", "hey", "danke", "servus", "lieber", "liebe", "sehr geehrter", "sehr geehrte"],
        ["baue", "gebaut", "starte", "gestartet", "deploye", "installiert", "import", "pip install"],
    ),
    "fr": _locale(
        "A-ZÀÂÄÇÉÈÊËÎÏÔÖÙÛÜŸÆŒ", "a-zàâäçéèêëîïôöùûüÿæœ", _FR_STOP,
        ["il", "elle", "lui", "ils", "elles", "leur", "leurs", "eux", "se"],
        "a dit",
        ["a dit", "a demandé", "a répondu", "a raconté", "a ri", "a souri", "a pleuré", "a senti", "pense", "veut", "aime", "déteste", "sait", "a décidé", "a écrit"],
        ["bonjour", "salut", "merci", "cher", "chère", "monsieur", "madame", "hey", "hi"],
        ["construit", "lancé", "déployé", "installé", "l'architecture", "le pipeline", "le système", "le projet", "le dépôt", "import", "pip install"],
    ),
    "es": _locale(
        "A-ZÁÉÍÓÚÑÜ", "a-záéíóúñü", _ES_STOP,
        ["él", "ella", "ellos", "ellas", "lo", "la", "le", "les", "se"],
        "dijo",
        ["dijo", "preguntó", "respondió", "contó", "rió", "sonrió", "lloró", "sintió", "piensa", "quiere", "ama", "odia", "sabe", "decidió", "escribió"],
        ["hola", "hey", "hi", "gracias", "querido", "querida", "estimado", "estimada", "don", "doña", "señor", "señora"],
        ["construyo", "construí", "armé", "lancé", "desplegué", "instalé", "la arquitectura", "el pipeline", "el sistema", "el proyecto", "el repositorio", "import", "pip install"],
    ),
}


def load(spark: SparkSession, path: str) -> dict[str, Locale]:
    """Locales of JSON files, one a language: ``lang`` and ``entity`` with candidate_pattern, multi_word_pattern, stopwords,
    pronoun_patterns, dialogue_patterns, person_verb_patterns, direct_address_pattern and project_verb_patterns. Files
    without a pattern of names are left out.
    """
    lists = ", ".join(f"{n}: array<string>" for n in ("stopwords", "pronoun_patterns", "dialogue_patterns", "person_verb_patterns", "project_verb_patterns"))
    schema = f"lang string, entity struct<candidate_pattern: string, multi_word_pattern: string, direct_address_pattern: string, {lists}>"
    found = {}
    for r in spark.read.schema(schema).json(path, multiLine=True).where("lang IS NOT NULL AND entity.candidate_pattern IS NOT NULL").collect():  # one small row for each language
        e = r["entity"]
        signals = {"dialogue": e["dialogue_patterns"] or [], "action": e["person_verb_patterns"] or [], "addressed": [p for p in [e["direct_address_pattern"]] if p], "verb": e["project_verb_patterns"] or [], "versioned": VERSIONED, "code": CODE}
        phrase = e["multi_word_pattern"] or f"(?:{e['candidate_pattern']})(?:{SPACE}(?:{e['candidate_pattern']}))+"
        found[r["lang"].lower()] = Locale(e["candidate_pattern"], phrase, tuple(w.lower() for w in e["stopwords"] or []), "|".join(e["pronoun_patterns"] or ["(?!)"]), signals)
    return found


def table(spark: SparkSession, locales: dict[str, Locale] = LOCALES) -> DataFrame:
    """(lang, candidate, phrase, stop): a row for each language."""
    return spark.createDataFrame([(k, v.candidate, v.phrase, list(v.stop)) for k, v in locales.items()], "lang string, candidate string, phrase string, stop array<string>")


def language_of(lang: Column, locales: dict[str, Locale], otherwise: str = "en") -> Column:
    """The locale of a language tag, whatever its case: the tag's own, that of its first part, else *otherwise*."""
    low = F.lower(F.trim(lang))
    known = F.array(*[F.lit(k) for k in locales])
    part = F.element_at(F.split(low, "[-_]"), 1)
    return F.when(F.array_contains(known, low), low).when(F.array_contains(known, part), part).otherwise(F.lit(otherwise))


def names_in(text: Column, candidate: Column, phrase: Column, stop: Column) -> Column:
    """All names of a text, one and several words long, as often as they stand there."""
    words = F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.rlike(w, F.concat(F.lit("^(?:"), candidate, F.lit(")$"))) & ~F.array_contains(stop, F.lower(w)))
    bounded = F.concat(F.lit(f"(?<![{INSIDE}])("), phrase, F.lit(f")(?![{INSIDE}])"))
    phrases = F.filter(F.regexp_extract_all(text, bounded, F.lit(1)), lambda p: ~F.arrays_overlap(F.split(F.lower(p), SPACE), stop))
    return F.concat(words, phrases)


def candidates(docs: DataFrame, locales: dict[str, Locale] = LOCALES, least: int = 3, lang: str = "lang", text: str = "document") -> DataFrame:
    """(lang, word, n): names that stand *least* times or more in the texts of a language; other languages count as English."""
    rows = docs.select(language_of(F.col(lang), locales).alias("lang"), F.coalesce(text, F.lit("")).alias("__t"))
    met = rows.join(F.broadcast(table(docs.sparkSession, locales)), "lang")
    words = met.select("lang", F.explode(names_in(F.col("__t"), F.col("candidate"), F.col("phrase"), F.col("stop"))).alias("word"))
    return words.groupBy("lang", "word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
