"""Benchmark files, collections, adapters, extraction with a tracker, spelling."""

import json

import pytest
from pyspark.sql import functions as F

from memlake.functions import spelling
from memlake.operators import haystack, kg
from memlake.sources import benchmarks, collections


def put(path, data):
    path.write_text(json.dumps(data))
    return str(path)


def test_session_memory(spark, tmp_path):
    entry = {
        "question_id": "q1", "question": "where?", "question_date": "2023/01/15 (Sun) 10:20", "answer_session_ids": ["s2"], "haystack_session_ids": ["s1", "s2", "s3"], "haystack_dates": ["2023/01/01 (Sun) 01:00", "2023/01/02 (Mon) 01:00", "x"],
        "haystack_sessions": [[{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}, {"role": "user", "content": "c"}], [{"role": "user", "content": "d"}], [{"role": "assistant", "content": "only"}]],
    }
    asked, hay = benchmarks.session_memory(spark, put(tmp_path / "a.json", [entry]))
    assert asked.collect() == [("q1", "where?", "2023-01-15", ["s2"])]
    assert [(r.corpus_id, r.position, r.document, r.full_text, r.occurred_at) for r in hay.orderBy("position").collect()] == [("s1", 0, "a\nc", "a\nb\nc", "2023-01-01"), ("s2", 1, "d", "d", "2023-01-02")]


def test_dialogs(spark, tmp_path):
    entry = {"sample_id": "c1", "conversation": {"session_1": [{"speaker": "A", "dia_id": "D1:1", "text": "hi"}], "session_1_date_time": "May", "session_2": [{"speaker": "B", "text": "yo"}]}, "qa": [{"question": "q?", "answer": "x", "category": 2, "evidence": ["D1:1"]}, {"question": "r?", "category": 1}]}
    asked, hay = benchmarks.dialogs(spark, put(tmp_path / "b.json", [entry]))
    assert {r.qid: (r.question, r.evidence) for r in asked.collect()} == {"c1/0": ("q?", ["D1:1"]), "c1/1": ("r?", None)}
    assert [(r.corpus_id, r.document) for r in hay.where("qid = 'c1/0'").orderBy("position").collect()] == [("D1:1", 'A said, "hi"'), ("D2:?", 'B said, "yo"')]


def test_dialogs_of_any_number_of_sessions(spark, tmp_path):
    many = {f"session_{i}": [{"speaker": "A", "dia_id": f"D{i}:{k}", "text": "x"} for k in range(3)] for i in range(1, 61)} | {"session_60_date_time": "June", "speaker_a": "A", "session_x": "no"}
    _, hay = benchmarks.dialogs(spark, put(tmp_path / "b.json", [{"sample_id": "c", "conversation": many, "qa": [{"question": "q"}]}]))
    rows = hay.orderBy("position").collect()
    assert [r.corpus_id for r in rows] == [f"D{i}:{k}" for i in range(1, 61) for k in range(3)] and [r.position for r in rows] == list(range(180))
    assert rows[-1].date == "June" and rows[-1].session == 60 and rows[0].date is None


def test_evidence_and_multiple_choice(spark, tmp_path):
    item = {"question": "q", "conversations": [{"messages": [{"speaker": "u", "text": "one"}]}, {"messages": [{"speaker": "a", "text": "two"}]}], "message_evidences": [{"text": "two"}]}
    asked, hay = benchmarks.evidence(spark, put(tmp_path / "e.json", {"evidence_items": [item, item]}))
    assert asked.count() == 2 and asked.first().evidence == ["two"]
    assert [(r.corpus_id, r.document) for r in hay.where("qid = 'e.json/1'").orderBy("position").collect()] == [("msg_0", "one"), ("msg_1", "two")]
    qa = {"question": "w?", "choices": {"A": "x"}, "ground_truth": "A", "target_step_id": [[0, 1]]}
    data = {"movie": [{"message_list": [{"sid": 7, "user": "u", "assistant": "a", "time": "t"}], "QA": qa}], "food": [{"message_list": [{"user": "no"}], "QA": qa}], "roles": [{"message_list": [[{"user_message": "v"}], [{"mid": 9, "assistant_message": "b"}]], "QA": qa}, {"message_list": [], "QA": qa}]}
    asked, hay = benchmarks.multiple_choice(spark, put(tmp_path / "m.json", data))
    assert sorted((r.qid, r.answer, r.targets) for r in asked.collect()) == [("m.json/movie/0", "A", [[0, 1]]), ("m.json/roles/0", "A", [[0, 1]])]
    assert sorted((r.qid, r.corpus_id, r.document) for r in hay.collect()) == [("m.json/movie/0", "7", "[t] [User] u [Assistant] a"), ("m.json/roles/0", "0", "[User] v [Assistant] "), ("m.json/roles/0", "9", "[User]  [Assistant] b")]


def test_collections(spark, tmp_path):
    root = str(tmp_path / "root")
    assert collections.listed(spark, root) == []
    assert collections.create(spark, root, "one", "id long, document string").count() == 0
    spark.createDataFrame([(1, "x")], "id long, document string").write.mode("append").parquet(f"{root}/one")
    assert collections.create(spark, root, "one", "id long").first().document == "x" and collections.listed(spark, root) == ["one"]
    assert collections.delete(spark, root, "one") and not collections.delete(spark, root, "one")
    with pytest.raises(LookupError):
        collections.get(spark, root, "one")
    with pytest.raises(ValueError, match="path"):
        collections.create(spark, root, "../x", "id long")


def test_adapters(spark, tmp_path):
    class Lines(collections.Adapter):
        name = "lines"
        version = "3"

        def files(self, session):
            return session.createDataFrame([("a", 1.0, "x\ny"), ("b", 2.0, "z")], "source_file string, mtime double, content string")

        def records(self, files):
            return files.select("source_file", F.posexplode(F.split("content", "\n")).alias("chunk_index", "document"))

    made = collections.adapter("lines")().drawers(spark)
    assert sorted(r.document for r in made.collect()) == ["x", "y", "z"] and {r.adapter_version for r in made.collect()} == {"3"}
    state = spark.createDataFrame([("a", 1.0, "3"), ("b", 2.0, "2")], "source_file string, mtime double, adapter_version string")
    assert [r.document for r in Lines().drawers(spark, state).collect()] == ["z"]
    with pytest.raises(LookupError):
        collections.adapter("none")


def test_known_entities(spark, tmp_path):
    path = put(tmp_path / "k.json", {"people": ["Ann", "", "Bob"], "projects": {"Vesper": {"x": 1}}})
    assert sorted(map(tuple, collections.known_entities(spark, path).collect())) == [("people", "Ann"), ("people", "Bob"), ("projects", "Vesper")]


def test_extraction_takes_each_drawer_once(spark):
    drawers = spark.createDataFrame([(1, "a b"), (2, " "), (3, None), (4, "c d")], "id long, document string").repartition(3)
    calls = spark.sparkContext.accumulator(0)

    def extractor(texts):
        calls.add(len(texts))
        return [[{"subject": t.split()[0], "predicate": "is", "object": t.split()[1], "valid_from": 3}, {"subject": "x"}, "odd"] for t in texts]

    none = spark.createDataFrame([], "id string")
    facts, done = kg.extract_triples(drawers, none, extractor)
    assert sorted((r.subject, r.object, r.valid_from, r.source_drawer_id) for r in facts.collect()) == [("a", "b", None, "1"), ("c", "d", None, "4")]
    assert sorted(r.id for r in done.collect()) == ["1", "2", "3", "4"] and calls.value == 2
    more, again = kg.extract_triples(drawers, done, extractor)
    assert more.count() == 0 and again.count() == 4 and calls.value == 2


def test_spelling(spark):
    right = {"recieve": "receive", "wierd": "weird", "qqqqqqq": "something", "teh": "the"}
    fix = lambda w: right.get(w, w)
    df = spark.createDataFrame([("Recieve recieve, wierd! teh qqqqqqq  http://wierd.com WIERD wierd2 my_wierd ann",), (None,)], "text string")
    assert [r.text for r in spelling.corrected(df, speller=fix, known=["Ann"]).collect()] == ["Recieve receive, weird! teh qqqqqqq  http://wierd.com WIERD wierd2 my_wierd ann", None]
    assert spelling.corrected(df).collect() == df.collect()
    assert [r.text for r in spelling.corrected(df, speller=fix, words=["recieve", "wierd"]).collect()] == [r.text for r in df.collect()]
    assert spelling.distance("kitten", "sitting") == 3 and spelling.distance("", "ab") == 2


def test_signals_of_a_question(spark):
    q = "What did Rachel and Bob say on 'the blue door' and \"a  key\", what about the key?"
    row = spark.range(1).select(haystack.keywords(F.lit(q)).alias("k"), haystack.phrases(F.lit(q)).alias("p"), haystack.names(F.lit(q)).alias("n"), haystack.predicates(F.lit(q)).alias("w"), haystack.asks_assistant(F.lit("So YOU SAID it")).alias("a")).first()
    assert row.k == ["rachel", "and", "bob", "say", "blue", "door", "and", "key", "key"] and row.p == ["the blue door", "a  key"]
    assert row.n == ["Rachel", "Bob"] and row.w == ["and", "say", "blue", "door", "and", "key", "key"] and row.a


def test_preferences_stand_behind_and_count_once(spark):
    hay = spark.createDataFrame([(1, "s1", 0, "I prefer tea in the morning", [1.0, 0.0], "2024-01-01"), (1, "s2", 1, "nothing", [0.9, 0.1], "2024-01-02"), (1, "s3", 2, "far", [0.0, 1.0], None)], "qid long, corpus_id string, position int, document string, embedding array<double>, occurred_at string")
    asked = spark.createDataFrame([(1, "what tea?", [1.0, 0.05], "2024-02-01")], "qid long, question string, embedding array<double>, asked_at string")
    assert haystack.with_preferences(hay).orderBy(F.col("position").desc()).first().document == "User has mentioned: tea in the morning"
    for mode in (haystack.hybrid, haystack.raw):
        assert [(r["rank"], r.corpus_id) for r in mode(hay, asked, 2).orderBy("rank").collect()] == [(1, "s1"), (2, "s2"), (3, "s3")]
