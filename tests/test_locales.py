"""Names and signals by language."""

import json

import pytest
from pyspark.sql import functions as F

from memlake.operators import entities, locales

DOCS = "id long, lang string, document string"


def test_names_of_every_language(spark):
    docs = spark.createDataFrame(
        [
            (1, "de", "Gestern kam Jürgen Müller.\nund Jürgen Müller ging; Jürgen\tMüller! ÄußerstX Der Jörg"),
            (2, "de-AT", "Zoë Jürgen"),
            (3, "FR", "Éloïse Œuvrard, Éloïse Œuvrard et Éloïse Œuvrard. Le Éloïse"),
            (4, "es", "Íñigo Íñigo Íñigo"),
            (5, None, "Anna Lena Meier Anna2 The Anna"),
            (6, "xx", "Anna Anná Anna"),
            (7, "en", None),
        ],
        DOCS,
    )
    got = {(r.lang, r.word): r.n for r in locales.candidates(docs, least=1).collect()}
    assert got["de", "Jürgen Müller"] == 2 and got["de", "Jürgen\tMüller"] == 1 and got["de", "Jürgen"] == 4 and got["de", "Jörg"] == 1
    assert ("de", "ÄußerstX") not in got and ("de", "Der Jörg") not in got and ("de", "Zoë") not in got
    assert got["fr", "Éloïse Œuvrard"] == 3 and got["fr", "Éloïse"] == 4 and ("fr", "Le Éloïse") not in got
    assert got["es", "Íñigo Íñigo Íñigo"] == 1 and got["es", "Íñigo"] == 3
    assert got["en", "Anna Lena Meier"] == 1 and got["en", "Anna"] == 4  # not Anna2, nor one with a mark behind it
    assert {r.word for r in locales.candidates(docs).collect()} == {"Jürgen", "Müller", "Éloïse", "Œuvrard", "Éloïse Œuvrard", "Íñigo", "Anna"}


def test_locales_from_files_with_marks(spark, tmp_path):
    section = {"candidate_pattern": "[\\u0900-\\u097F]{2,20}", "person_verb_patterns": ["\\b{name}\\s+ने\\s+कहा\\b"], "pronoun_patterns": ["\\bवह\\b"], "stopwords": ["यह"], "boundary_chars": "\\w\\u0900-\\u097F"}
    (tmp_path / "hi.json").write_text(json.dumps({"lang": "hi", "entity": section}, ensure_ascii=False))
    (tmp_path / "none.json").write_text(json.dumps({"lang": "zz", "cli": {"a": "b"}}))
    known = locales.LOCALES | locales.load(spark, str(tmp_path))
    assert known.keys() == {*locales.LOCALES, "hi"}
    docs = spark.createDataFrame([(1, "hi", "अनीता ने कहा यह अनीता।\nवह गई अनीता"), (2, "en", "Anita said so")], DOCS)
    got = {(r.lang, r.word): r.n for r in locales.candidates(docs, known, least=1).collect()}
    assert got["hi", "अनीता"] == 3 and ("hi", "अनीत") not in got and ("hi", "यह") not in got and got["en", "Anita"] == 1


def test_each_text_is_read_by_its_own_language(spark):
    docs = spark.createDataFrame([(1, "de", "Marta sagte ja.\nhallo Marta"), (2, "en", "Marta sagte ja. Marta said no"), (3, "fr", "Marta a dit oui"), (4, None, "Marta sagte\n> Marta: x")], DOCS)
    by = {k: (v.signals, v.pronouns) for k, v in locales.LOCALES.items() if k != "en"}
    r = entities.signals(docs, spark.createDataFrame([("Marta",)], "word string"), lang=F.col("lang"), languages=by).first()
    assert (r.action, r.addressed, r.dialogue) == (3, 1, 1)


def test_a_text_of_many_names_is_fetched_once(spark):
    names = [f"Na{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(50)]
    docs = spark.createDataFrame([(i, "en", " said so. ".join(names) + " said") for i in range(20)], DOCS).repartition(4)
    of = entities.signals(docs, spark.createDataFrame([(n,) for n in names], "word string"))
    assert {r.action for r in of.collect()} == {20} and of.count() == 50
    plan = of._jdf.queryExecution().optimizedPlan().toString()
    joined = [x for x in plan.splitlines() if "__t" in x and "Join" in x]
    assert "collect_set" in plan and not joined  # names come together before the text is joined


@pytest.mark.parametrize("tag,want", [("DE", "de"), ("de-AT", "de"), ("pt_BR", "en"), (None, "en"), (" fr ", "fr")])
def test_tags(spark, tag, want):
    df = spark.createDataFrame([(tag,)], "t string").select(locales.language_of(F.col("t"), locales.LOCALES).alias("l"))
    assert df.first().l == want
