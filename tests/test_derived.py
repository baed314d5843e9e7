"""Derived tables, and the data source of records in batches and as a stream."""

import json
import os
import shutil
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from memlake.operators import derived, transcript
from memlake.session import shared_folder
from memlake.sources import records

ROWS = "id long, document string, other int"


def make(df):
    return df.select("id", F.upper("document").alias("said"))


def held(spark, path):
    return {r.id: r.said for r in derived.current(spark.read.parquet(path), "id").collect()}


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("part-*.parquet")}


def test_only_changed_partitions_are_written_again(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(i, f"t{i}", 0) for i in range(200)]
    df = spark.createDataFrame(rows, ROWS)
    assert derived.refresh(df, path, make, parts=20) == 200 and held(spark, path) == {i: f"T{i}" for i in range(200)}
    before = files(path)
    assert derived.refresh(df, path, make, parts=20) == 0 and files(path) == before
    changed = spark.createDataFrame([(i, "new" if i == 7 else t, o) for i, t, o in rows if i != 9] + [(500, "more", 0)], ROWS)
    assert derived.refresh(changed, path, make, parts=20) == 2
    assert held(spark, path) == {i: "NEW" if i == 7 else f"T{i}" for i in range(200) if i != 9} | {500: "MORE"}
    after = files(path)
    stayed = before.keys() & after.keys()
    assert len(stayed) >= len(before) * 0.8 and all(before[f] == after[f] for f in stayed)


def test_rows_that_all_go_and_odd_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    derived.refresh(spark.createDataFrame([(1, None, None), (2, "b", 1), (None, "no key", 1)], ROWS), path, make, parts=4)
    assert held(spark, path) == {1: None, 2: "B"}
    derived.refresh(spark.createDataFrame([], ROWS), path, make, parts=4)
    assert held(spark, path) == {}
    derived.refresh(spark.createDataFrame([(2, "c", 1)], ROWS), path, make, parts=4)
    assert held(spark, path) == {2: "C"}


def test_a_refresh_that_stops_is_repeated(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(i, f"t{i}", 0) for i in range(20)], ROWS)

    def fails(rows):
        return rows.select("id", F.when(F.col("id") == 13, F.raise_error(F.lit("stopped")).cast("string")).otherwise(F.upper("document")).alias("said"))

    with pytest.raises(Exception, match="stopped"):
        derived.refresh(df, path, fails)
    derived.refresh(df, path, make)
    assert len(held(spark, path)) == 20


def put(folder, name, text, when):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    os.utime(folder / name, (when, when))


@pytest.fixture
def source(spark):
    spark.dataSource.register(records.RecordSource)
    return lambda path, **more: spark.read.format("memlake_records").options(path=str(path), **more)


def test_batches(spark, source, tmp_path):
    folder = tmp_path / "in"
    long = "\n".join(f"line {i} of a text that is cut" for i in range(100))
    put(folder, "a.txt", long, 1000)
    put(folder, "b.txt", "too short", 1000)
    put(folder, "_hidden.txt", long, 1000)
    put(folder / "sub", "c.md", "x" * 60, 1001)
    rows = source(folder).load().collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.chunk_index):
        got.setdefault(r.source_file.rsplit("/", 1)[1], []).append(r.document)
    want = [p for p in (long[a:b].strip() for a, b in transcript.windows(long)) if len(p) >= 50]
    assert got == {"a.txt": want, "c.md": ["x" * 60]} and {r.mtime for r in rows} == {1000.0, 1001.0}
    assert source(folder, suffix=".md").load().count() == 1 and source(tmp_path / "none").load().count() == 0
    put(folder, "d.jsonl", json.dumps({"document": "y" * 60, "source_file": "own"}) + "\nbroken\n[1]\n" + json.dumps({"document": "z" * 55}), 1002)
    lines = source(folder, adapter="lines", suffix=".jsonl").load().collect()
    assert sorted((r.source_file.rsplit("/", 1)[-1], r.document[0]) for r in lines) == [("d.jsonl", "z"), ("own", "y")]
    with pytest.raises(Exception, match="no adapter"):
        source(folder, adapter="other").load().count()


def test_a_stream_goes_on_behind_its_offset(spark, source, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = spark.readStream.format("memlake_records").options(path=str(folder)).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(processingTime="200 milliseconds").start(out)
        query.processAllAvailable()
        query.stop()
        return sorted(r.document[0] for r in spark.read.parquet(out).collect())

    put(folder, "a.txt", "a" * 60, 1000)
    put(folder, "b.txt", "b" * 60, 1000)
    assert run() == ["a", "b"]
    put(folder, "c.txt", "c" * 60, 1000)  # of the same time, a later path
    put(folder, "d.txt", "d" * 60, 2000)
    put(folder, "e.txt", "e" * 60, time.time() + 500)  # not settled yet
    assert run() == ["a", "b", "c", "d"]
    assert run() == ["a", "b", "c", "d"]
    os.utime(folder / "e.txt", (3000, 3000))
    assert run() == ["a", "b", "c", "d", "e"]
    shutil.rmtree(tmp_path / "in")
    assert run() == ["a", "b", "c", "d", "e"]


class Context:
    def __init__(self, master):
        self.master = master
        self._jsc = self

    def sc(self):
        return self

    getCheckpointDir = sc

    def isDefined(self):
        return False


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "yarn", "spark://h:7077"])
def test_a_cluster_must_name_its_shared_folder(master):
    session = type("Session", (), {"sparkContext": Context(master), "conf": {}})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)
