"""Collections that know their embedder; sessions written as files; rankings of dialogs by hand."""

import pytest
from pyspark.sql import functions as F

from memlake.operators import haystack, transcript
from memlake.sources import collections


def test_a_collection_keeps_its_embedder(spark, tmp_path):
    root = str(tmp_path)
    collections.create(spark, root, "notes", "id long, embedding array<float>", embedder="hashed-64")
    assert collections.get(spark, root, "notes", "hashed-64").count() == 0 and collections.get(spark, root, "notes").count() == 0
    with pytest.raises(ValueError, match="hashed-64"):
        collections.get(spark, root, "notes", "other")
    with pytest.raises(ValueError, match="hashed-64"):
        collections.create(spark, root, "notes", "id long", embedder="other")
    collections.create(spark, root, "plain", "id long")
    assert collections.get(spark, root, "plain", "any").count() == 0 and collections.listed(spark, root) == ["notes", "plain"]
    assert collections.delete(spark, root, "notes")
    assert collections.create(spark, root, "notes", "id long", embedder="other").count() == 0


def test_sessions_are_written_as_files(spark, tmp_path):
    lines = [("f.txt", i, t) for i, t in enumerate(["# start", *(f"line {i}" for i in range(12)), "# start", "> fix it now", *(f"more {i}" for i in range(11))])]
    df = spark.createDataFrame(lines, "source_file string, line_no int, line string").repartition(3)
    numbered = transcript.sessions(df, "^# start")
    names = transcript.session_names(numbered, [])
    for _ in range(2):
        transcript.write_sessions(numbered, names, str(tmp_path / "out"))
    got = {}
    for r in spark.read.text(str(tmp_path / "out")).select("value", "name", F.col("_metadata.file_path").alias("p")).collect():
        got.setdefault((r.name, r.p), []).append(r.value)
    assert sorted(got.values()) == sorted([[t for _, _, t in lines[:13]], [t for _, _, t in lines[13:]]])


def test_dialogs_by_rooms_and_sessions(spark):
    hay = [(1, f"s{i}", i, t, [1.0 - d, d], f"r{i % 4}") for i, (t, d) in enumerate([("painting of a lake", 0.3), ("nothing", 0.05), ("music and painting", 0.4), ("cars", 0.1), ("painting", 0.9), ("music", 0.2)])]
    df = spark.createDataFrame(hay, "qid long, corpus_id string, position int, document string, embedding array<double>, room string")
    asked = spark.createDataFrame([(1, "what painting did Anna make?", [1.0, 0.0])], "qid long, question string, embedding array<double>")
    told = df.select("qid", "corpus_id", "room", F.col("document").alias("summary"))
    ids = lambda x: [r.corpus_id for r in x.orderBy("rank").collect()]
    assert ids(haystack.dialog_sessions(df, told, asked, 2)) == ["s2", "s4"]  # of the three that hold painting the last two by name
    assert set(ids(haystack.dialog_rooms(df, told, asked, 6))) == {"s0", "s4", "s2", "s3"}
    none = spark.createDataFrame([(1, "xyzzy?", [1.0, 0.0])], "qid long, question string, embedding array<double>")
    assert len(ids(haystack.dialog_rooms(df, told, none, 6))) == 6
    assert ids(haystack.dialog_hybrid(df, asked, 2))[0] in ("s0", "s1")
