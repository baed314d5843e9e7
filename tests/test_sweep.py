"""Sweeps of session logs: lost checkpoints, stopped batches, broken lines."""

import json
import shutil

import pytest

from memlake.streaming import sweep


def message(uuid, second, session="s"):
    return {"type": "user", "sessionId": session, "uuid": uuid, "timestamp": f"2024-01-01T00:00:{second:02d}Z", "message": {"role": "user", "content": uuid}}


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines))


def run(spark, tmp_path, state="state"):
    sweep.sweep_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / state)).awaitTermination()
    return sorted(r.uuid for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_a_lost_checkpoint_loses_and_doubles_nothing(spark, tmp_path):
    write(tmp_path / "in", "a.jsonl", [message("m1", 1)])
    assert run(spark, tmp_path) == ["m1"]
    write(tmp_path / "in", "b.jsonl", [message("m2", 2), message("m2b", 2)])
    assert run(spark, tmp_path) == ["m1", "m2", "m2b"]
    shutil.rmtree(tmp_path / "state")
    write(tmp_path / "in", "c.jsonl", [message("m3", 3), message("m2b", 2)])
    assert run(spark, tmp_path) == ["m1", "m2", "m2b", "m3"]
    assert run(spark, tmp_path, "other") == ["m1", "m2", "m2b", "m3"]


@pytest.mark.parametrize("lost", [False, True])
def test_a_batch_stopped_between_target_and_tips(spark, tmp_path, monkeypatch, lost):
    write(tmp_path / "in", "a.jsonl", [message("m1", 1), message("n1", 5, "t")])
    run(spark, tmp_path)
    write(tmp_path / "in", "b.jsonl", [message("m2", 2), message("m1", 1)])
    real = sweep.write_batch

    def stops(rows, path, *rest):
        if path.endswith(".tips"):
            raise RuntimeError("stopped")
        real(rows, path, *rest)

    monkeypatch.setattr(sweep, "write_batch", stops)
    with pytest.raises(Exception, match="stopped"):
        run(spark, tmp_path)
    monkeypatch.setattr(sweep, "write_batch", real)
    if lost:
        shutil.rmtree(tmp_path / "state")
    write(tmp_path / "in", "c.jsonl", [message("m3", 3)])
    assert run(spark, tmp_path) == ["m1", "m2", "m3", "n1"]
    assert run(spark, tmp_path, "other") == ["m1", "m2", "m3", "n1"]


def test_broken_lines_are_kept_apart_once(spark, tmp_path):
    write(tmp_path / "in", "a.jsonl", ["{broken", message("m1", 1), "", "{broken", '["no", "message"]'])
    assert run(spark, tmp_path) == ["m1"]
    write(tmp_path / "in", "b.jsonl", ["{broken", message("m2", 2)])
    assert run(spark, tmp_path) == ["m1", "m2"]
    broken = lambda: sorted((r.source_file.rsplit("/", 1)[-1], r.line) for r in spark.read.parquet(str(tmp_path / "out.broken")).collect())
    assert broken() == [("a.jsonl", "{broken"), ("b.jsonl", "{broken")]
    shutil.rmtree(tmp_path / "state")
    assert run(spark, tmp_path) == ["m1", "m2"] and broken() == [("a.jsonl", "{broken"), ("b.jsonl", "{broken")]


def test_rates_in_a_stream(spark, tmp_path):
    write(tmp_path / "in", "a.json", [{"k": "a", "t": "2024-01-01T00:00:05Z"}, {"k": "a", "t": "2024-01-01T00:00:59Z"}, {"k": "a", "t": "2024-01-01T00:01:00Z"}, {"k": "b", "t": "2024-01-01T00:00:00Z"}])
    write(tmp_path / "in", "b.json", [{"k": "a", "t": "2024-01-01T01:00:00Z"}])
    rows = spark.readStream.schema("k string, t timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    stream = sweep.rate_stream(rows, "k", "t").select("k", "w.start", "n").writeStream.format("memory").queryName("rates").outputMode("append")
    stream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.k, r.start.minute, r.n) for r in spark.table("rates").collect()) == [("a", 0, 2), ("a", 1, 1), ("b", 0, 1)]
