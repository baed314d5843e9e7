"""Names of any length, the registry, reranking, answers, and what a walk over conversations takes."""

import json
import random
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from memlake.operators import context, ingest, lexical, metrics, registry, search
from memlake.sources import chats, projects

LONG = ["Anna", "Anna Lena", "Anna Lena Maria", "The Great Hall of the Old City Museum", "One Two Three Four Five Six", "One Two Three", "One Two Four"]


def test_names_of_up_to_eight_words(spark):
    docs = spark.createDataFrame([(1, "x One Two Three Four Five Six y"), (2, "the Great Hall of the Old City Museum"), (3, "The, Great (Hall) of the Old City Museum! Anna Lena"), (4, "One Two Four Anna LenaMaria"), (5, None)], "id long, document string")
    known = spark.createDataFrame([(n,) for n in LONG] + [("",), (None,), ("...",)], "name string")
    got = {r.id: set(r.entities.split(";")) for r in ingest.names_of(docs, known).collect()}
    assert got[1] == {"One Two Three", "One Two Three Four Five Six"} and 2 not in got and 5 not in got
    assert got[3] == {"The Great Hall of the Old City Museum", "Anna", "Anna Lena"} and got[4] == {"One Two Four", "Anna"}


def test_names_of_questions(spark):
    asked = spark.createDataFrame([(1, "who built the GREAT hall of the old city museum?"), (2, "one two three four five"), (3, "")], "qid long, question string")
    known = spark.createDataFrame([(n,) for n in LONG], "name string")
    got = [(r.qid, r.name) for r in context.question_names(asked, known).orderBy("qid", "place").collect()]
    assert got == [(1, "The Great Hall of the Old City Museum"), (2, "One Two Three")]


def test_names_against_brute_force(spark):
    r = random.Random(4)
    word = lambda: r.choice("abc")
    texts = [(i, " ".join(word() for _ in range(r.randrange(12)))) for i in range(60)]
    names = sorted({" ".join(word() for _ in range(r.randrange(1, 9))) for _ in range(60)})
    known = spark.createDataFrame([(n, n.split(" ")) for n in names], "name string, form array<string>")
    docs = spark.createDataFrame([(i, t.split(" ") if t else []) for i, t in texts], "id long, words array<string>")
    from memlake.operators.names import known_names

    got = {(x.id, x.name) for x in known_names(docs, "words", "id", known, "form").collect()}
    assert got == {(i, n) for i, t in texts for n in names if f" {n} " in f" {t} "}


def test_a_registry_learns_and_keeps_what_it_was_told(spark):
    common = spark.createDataFrame([("Will",)], "word string")
    people = spark.createDataFrame([("Maxwell Smart", "Max"), ("Will", None), (" ", None)], "name string, alias string")
    known = registry.seeded(people, spark.createDataFrame([("Orbit",), ("",)], "name string"), common)
    rows = {r.name: r for r in known.collect()}
    assert rows.keys() == {"Maxwell Smart", "Max", "Will", "Orbit"} and rows["Max"].alias == ["Maxwell Smart"] and rows["Will"].ambiguous and rows["Orbit"].kind == "project"
    said = "Riley said hi. Riley: yes\nRiley: no\nThanks Riley, she knows.\nWill said so. Will: a\nWill: b\nOrbit said x. Orbit said y. Orbit said z"
    batch = spark.createDataFrame([(1, said)], "id long, document string")
    one = registry.learned(known, batch, common)
    assert {r.name: r.source for r in one.collect()} == {"Maxwell Smart": "onboarding", "Max": "onboarding", "Will": "onboarding", "Orbit": "onboarding", "Riley": "learned"}
    assert sorted(registry.learned(one, batch, common).collect()) == sorted(one.collect())  # a batch taken in again
    sure = registry.confirmed(one, spark.createDataFrame([("Riley",), ("Max",)], "name string"), common)
    assert {r.name: (r.source, r.confidence) for r in sure.collect()}["Riley"] == ("confirmed", 0.9) and sure.where("name = 'Max'").first().source == "onboarding"
    asked = spark.createDataFrame([(1, "what did max say"), (2, "I will go, will you"), (3, "Will said no"), (4, "MAXWELL SMART's desk"), (5, None)], "qid long, question string")
    got = {(r.qid, r.name) for r in registry.people_in(asked, known).collect()}
    assert got == {(1, "Max"), (1, "Maxwell Smart"), (3, "Will"), (4, "Max"), (4, "Maxwell Smart")}


def hits_of(spark):
    rows = [(q, i, f"text {i} {'blue' if i == 3 else ''} {'sky' if i > 1 else ''}", i + 1, "w") for q in (1, 2) for i in range(5)]
    return spark.createDataFrame(rows, "qid long, id long, document string, rank int, wing string"), spark.createDataFrame([(1, "Blue sky"), (2, None)], "qid long, question string")


def test_rerank(spark):
    hits, asked = hits_of(spark)
    got = search.rerank(hits, asked)
    assert set(got.columns) == {*hits.columns, "reranked"}
    assert [r.id for r in got.where("qid = 1").orderBy("rank").collect()] == [3, 2, 4, 0, 1]
    assert [(r.id, r["rank"]) for r in got.where("qid = 2").orderBy("rank").collect()] == [(i, i + 1) for i in range(5)]


@pytest.mark.parametrize("fault", ["raises", "short", "nan"])
def test_a_scorer_that_fails_leaves_the_order_of_its_question(spark, fault):
    hits, asked = hits_of(spark)

    def scorer(question, texts):
        if question:
            if fault == "raises":
                raise RuntimeError("no model")
            return [1.0] if fault == "short" else [float("nan")] * len(texts)
        return list(range(len(texts)))

    got = search.rerank(hits, asked, scorer)
    assert [(r.id, r.reranked) for r in got.where("qid = 1").orderBy("rank").collect()] == [(i, False) for i in range(5)]
    assert [(r.id, r.reranked) for r in got.where("qid = 2").orderBy("rank").collect()] == [(4 - i, True) for i in range(5)]


def test_search_falls_back_to_vectors_when_the_index_is_gone(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"word{i} sky", [float(i), 1.0]) for i in range(6)], "id long, document string, embedding array<double>")
    asked = spark.createDataFrame([(1, "sky", [1.0, 1.0])], "qid long, question string, embedding array<double>")
    lexical.build(rows, str(tmp_path / "index"))
    index = lexical.load(spark, str(tmp_path / "index"))
    assert {r.search_method for r in search.routed_search(rows, asked, index, 3, scorer=search.overlap_scores).collect()} == {"hybrid+rerank"}
    broken = index._replace(postings=index.postings.drop("term"))
    got = search.routed_search(rows, asked, broken, 3).collect()
    assert len(got) == 3 and {r.search_method for r in got} == {"vector"}


def f1(a, b):
    """As the metric words it, in plain Python for ASCII."""
    import re

    def words(s):
        s = re.sub(r"\b(a|an|the|and)\b", " ", s.replace(",", ""))
        return "".join(c for c in " ".join(s.split()) if c not in string.punctuation).lower().split()

    x, y = words(a), words(b)
    if not x or not y:
        return float(x == y)
    same = sum((Counter(x) & Counter(y)).values())
    return 2 * same / (len(x) + len(y)) if same else 0.0


def test_answer_f1(spark):
    r = random.Random(7)
    parts = ["the", "The", "an", "cat", "cat's", "1,000", "-", "!", "dog", " ", "\n", "a", "x,y"]
    pairs = [(i, " ".join(r.choice(parts) for _ in range(r.randrange(8))), " ".join(r.choice(parts) for _ in range(r.randrange(8)))) for i in range(400)]
    got = {x.k: x.f1 for x in metrics.answer_f1(spark.createDataFrame(pairs + [(900, None, "")], "k long, x string, y string"), "x", "y", ["k"]).collect()}
    assert got.pop(900) == 1.0
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(f1(a, b), 9) for k, a, b in pairs}


def test_a_walk_takes_conversations_only(spark, tmp_path):
    for name in ("a.txt", "b.MD", "c.json", "d.jsonl", "e.py", "f.meta.json", "node_modules/g.txt", "sub/h.txt", "i"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("> q\n> r\n> s\n")
    found = {r.source_file.rsplit("/", 1)[1] for r in chats.conversation_files(spark, str(tmp_path)).collect()}
    assert found == {"a.txt", "b.MD", "c.json", "d.jsonl", "h.txt"}
    assert chats.normalise(spark, str(tmp_path)).count() == 5


def test_audit_log_hides_texts(spark, tmp_path):
    ops = spark.createDataFrame([("add", {"document": "secret text", "wing": "w"}, "ok")], "op string, params map<string,string>, result string")
    projects.audit_log(ops, str(tmp_path / "log"))
    projects.audit_log(ops, str(tmp_path / "log"))
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert rows == [{"op": "add", "params": {"document": "<11 chars>", "wing": "w"}, "result": "ok"}] * 2


def test_sessions_of_evidence(spark):
    df = spark.createDataFrame([(["D3:7", "D12:1", "x", "D3:9"],)], "e array<string>")
    assert df.select(metrics.evidence_sessions(F.col("e")).alias("s")).first().s == ["session_3", "session_12"]
