"""The jobs: twice over the same input, over growing input, stopped halfway, and from the command line."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from jobs import mine_documents, queries, sweep_conversations
from memlake.operators import classify
from tests.test_catalogue import DIR, plain

REPO = Path(__file__).resolve().parents[1]


def rows_of(df, columns=None):
    columns = columns or sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def files_of(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


@pytest.mark.parametrize("name", ["job1_mine_documents", "job2_sweep_conversations"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    before = dict(spark.conf.getAll)
    df = queries.queries()[name](spark, DIR)
    out = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in out.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr) == want
    assert dict(spark.conf.getAll) == before


SCHEMA = "n_chars long, text string, doc_id long, source string, lang string"


def test_mining_replaces_what_was_there(spark, tmp_path):
    source, out = str(tmp_path / "docs"), str(tmp_path / "out")
    long = "\n\n".join(f"paragraph {i} about the database server and its deploy" for i in range(80))
    rows = [(1, long, 1, "a/b", "en"), (1, None, 2, "a/b", "en"), (1, " \n", 3, None, None), (1, "x" * 60, 4, None, None), (1, "x" * 60, 4, None, None), (1, "short", 5, " ", "de")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(source)
    first = rows_of(mine_documents.run(spark, source, out))
    assert rows_of(mine_documents.run(spark, source, out)) == first
    made = mine_documents.run(spark, source, out).collect()
    assert {(r.doc_id, r.wing) for r in made} == {(1, "a/b"), (4, "unknown")}
    ids = [r.id for r in made if r.doc_id == 1]
    assert len(ids) > 4 and len(set(ids)) == len(ids) and len({r.id for r in made if r.doc_id == 4}) == 1
    assert all(len(r.document) <= 800 and r.id.startswith(f"drawer_{r.wing}_{r.room}_") for r in made)
    totals = {(r.wing, r.room, r.hall): (r.drawers, r.documents) for r in spark.read.parquet(f"{out}/status").collect()}
    assert totals["unknown", "general", None] == (2, 1) and sum(v[0] for k, v in totals.items() if k[2] is None) == len(made)
    spark.createDataFrame([(1, "y" * 70, 9, "c", "en")], SCHEMA).write.mode("overwrite").parquet(source)
    assert [r.doc_id for r in mine_documents.run(spark, source, out).collect()] == [9]
    assert not any("wing=unknown" in f for f in files_of(out))
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(source)
    assert mine_documents.run(spark, source, out).count() == 0


MESSAGES = "text string, role string, turn long, conv_id long, more int"


def put(spark, folder, rows, name):
    spark.createDataFrame(rows, MESSAGES).coalesce(1).write.parquet(str(folder / name))
    for p in (folder / name).glob("part-*.parquet"):
        (folder / "in").mkdir(exist_ok=True)
        shutil.copy(p, folder / "in" / f"{name}.parquet")


def swept(spark, folder, checkpoint="state", **more):
    return sweep_conversations.run(spark, str(folder / "in"), str(folder / "out"), str(folder / checkpoint), **more)


def test_sweeping_growing_input(spark, tmp_path):
    put(spark, tmp_path, [("hello", "user", 0, 1, 1), ("yes, deploy the server", "assistant", 1, 1, 1), (" ", "user", 2, 1, 1), ("sys", "system", 0, 2, 1), ("lost", "user", None, 2, 1), (None, "user", 3, 1, 1)], "a")
    first = rows_of(swept(spark, tmp_path))
    assert [r[4] for r in first].count(None) == 2 and len(first) == 6
    kept = files_of(tmp_path / "out")
    assert rows_of(swept(spark, tmp_path)) == first and files_of(tmp_path / "out") == kept  # nothing new, nothing touched
    put(spark, tmp_path, [("hello", "user", 0, 1, 1), ("changed", "assistant", 1, 1, 1), ("b", "user", 4, 1, 1), ("a", "user", 4, 1, 1), ("new", "user", 0, 3, 1), ("sys", "system", 0, 2, 1), ("lost", "user", None, 2, 1)], "b")
    again = swept(spark, tmp_path, files_per_batch=1)
    got = {r.id: r.document for r in again.where("reason IS NULL").collect()}
    assert got == {"sweep_1_0": "hello", "sweep_1_1": "yes, deploy the server", "sweep_1_4": "a", "sweep_3_0": "new"}
    assert again.count() == 8 and again.where("reason IS NOT NULL").count() == 4
    assert {k: v for k, v in files_of(tmp_path / "out").items() if k in kept} == kept  # what was written before stays as it was
    whole = rows_of(again)
    assert rows_of(swept(spark, tmp_path, checkpoint="another")) == whole  # all read again, nothing doubled


def test_a_sweep_that_stops_within_a_batch(spark, tmp_path, monkeypatch):
    put(spark, tmp_path, [("hello", "user", 0, 1, 1), ("", "user", 1, 1, 1)], "a")
    real, calls = sweep_conversations.add_batch, []

    def stops(rows, path, *rest):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        real(rows, path, *rest)

    monkeypatch.setattr(sweep_conversations, "add_batch", stops)
    with pytest.raises(Exception, match="stopped"):
        swept(spark, tmp_path)
    monkeypatch.setattr(sweep_conversations, "add_batch", real)
    got = swept(spark, tmp_path)
    assert rows_of(got, ["id", "reason"])[0][1] is not None and got.count() == 2 and got.where("id = 'sweep_1_0'").count() == 1


def test_an_empty_table(spark, tmp_path):
    put(spark, tmp_path, [], "a")
    (tmp_path / "in").mkdir(exist_ok=True)
    assert swept(spark, tmp_path).count() == 0 and sweep_conversations.written(spark, str(tmp_path / "none")).count() == 0


def test_command_lines(spark, tmp_path):
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"documents": "elsewhere", "output": str(tmp_path / "mined"), "size": 400}))
    env = os.environ | {"PYTHONPATH": f"{REPO}:{os.environ.get('PYTHONPATH', '')}", "PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"}
    run = subprocess.run([sys.executable, "-m", "jobs.mine_documents", "--config", str(config), "--documents", f"{DIR}/documents.parquet"], cwd=REPO, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0 and "wrote" in run.stderr
    made = spark.read.parquet(str(tmp_path / "mined" / "drawers"))
    assert made.count() and made.where("length(document) > 400").count() == 0 and set(made.select("room").distinct().toPandas()["room"]) <= {*classify.TOPICS, "general"}
    args = ["--conversations", f"{DIR}/conversations.parquet*", "--output", str(tmp_path / "swept"), "--checkpoint", str(tmp_path / "state")]
    run = subprocess.run([sys.executable, "-m", "jobs.sweep_conversations", *args], cwd=REPO, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0 and "messages" in run.stderr
    assert sweep_conversations.written(spark, str(tmp_path / "swept")).count() == spark.read.parquet(f"{DIR}/conversations.parquet").count()
