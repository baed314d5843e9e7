"""Checks, embedding, rooms of files, pointers, exports and stamps."""

import pytest
from pyspark.sql import functions as F

from memlake.functions import checks, embed
from memlake.operators import ingest
from memlake.sources import projects


@pytest.mark.parametrize(("value", "why"), [("", "empty"), ("  ", "empty"), (None, "empty"), (3, "empty"), ("a" * 129, "too long"), ("a/b", "path characters"), ("a..b", "path characters"), ("a\\b", "path characters"), ("a\0b", "null bytes"), ("_a", "characters"), ("a!", "characters"), ("(x)", "characters")])
def test_refused_names(spark, value, why):
    with pytest.raises(ValueError, match=why):
        checks.checked_name(value, "wing")
    if not isinstance(value, int):
        assert spark.createDataFrame([(value,)], "v string").select(checks.name_fault(F.col("v")).alias("f")).first().f == why


def test_good_names(spark):
    for value in ("a", " my wing ", "O'Neil-2 v1.0", "Ünïcode", "x" * 128):
        assert checks.checked_name(value) == value.strip()
        row = spark.createDataFrame([(value,)], "v string").select(checks.name_fault(F.col("v")).alias("f"), checks.value_fault(F.lit("a, (b): c")).alias("g"), checks.content_fault(F.repeat(F.lit("x"), 100_001)).alias("h")).first()
        assert (row.f, row.g, row.h) == (None, None, "too long")
    assert checks.optional_name("  ") is None and checks.optional_name(None) is None and checks.optional_name(" a ") == "a"
    assert [checks.page(*x) for x in ((0, -1), (7, 3), (1000, 0))] == [(1, 0), (7, 3), (100, 0)]


def test_embedding_is_the_same_everywhere_and_of_unit_length(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, "beta alpha alpha"), (3, None), (4, "")], "id long, document string").repartition(3)
    got = {r.id: r.embedding for r in embed.embed(df).collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-12 and not any(got[3]) and not any(got[4])
    ones = embed.embed(df, embedder=lambda texts: [[float(len(t)), 0.0] for t in texts], prefix="query: ")
    assert {r.id: r.embedding for r in ones.collect()}[3] == [1.0, 0.0]


ROOMS = [{"name": "backend", "keywords": ["api", "server"]}, {"name": "frontend", "keywords": ["ui"]}, {"name": "notes"}]


@pytest.mark.parametrize(
    ("path", "content", "room"),
    [
        ("src/api/x.py", "", "backend"),
        ("server\\UI\\x.py", "", "backend"),
        ("web-ui/x.py", "", "frontend"),
        ("notes.md", "", "notes"),
        ("zz/frontend_old.js", "", "frontend"),
        ("zz/q.txt", "ui ui api", "frontend"),
        ("zz/q.txt", "server ui", "backend"),
        ("zz/q.txt", "nothing", "general"),
        ("zz/q.txt", "x" * 2000 + "api", "general"),
        ("not/q9.txt", "", "notes"),
    ],
)
def test_room_of_a_file(spark, path, content, room):
    df = spark.createDataFrame([(path, content)], "path string, content string")
    assert df.select(ingest.room_of(F.col("path"), F.col("content"), ROOMS).alias("r")).first().r == room
    assert df.select(ingest.room_of(F.col("path"), F.col("content"), []).alias("r")).first().r == "general"


def test_pointers_and_transcript_wings(spark):
    df = spark.createDataFrame([("t|A|→d_1,d_2\nu||→d_2, d_3",), ("none",), (None,)], "line string")
    assert [r.p for r in df.select(ingest.pointers(F.col("line")).alias("p")).collect()] == [["d_1", "d_2"], [], None]
    paths = [("/h/.claude/projects/-home-me-dev-My App/s.jsonl", "wing_my_app"), ("/x/-Projects-Thing/a", "wing_thing"), ("/x/y", "wing_sessions"), ("", "wing_sessions")]
    rows = spark.createDataFrame(paths, "path string, want string").select(ingest.wing_of_transcript(F.col("path")).alias("w"), "want").collect()
    assert all(r.w == r.want for r in rows)


def test_export_with_index(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\nb\n", "w", "r", "f.md", None), (2, "c", "w", "q/s", None, "2024"), (3, "d", None, None, "", "x")], "id long, document string, wing string, room string, source_file string, filed_at string")
    projects.export_markdown(rows, str(tmp_path / "out"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out" / "wing=w" / "room=r"), wholetext=True).collect())
    assert text.rstrip("\n") == "## 1\n\n> a\n> b\n\n| Field | Value |\n|-------|-------|\n| Source | f.md |\n| Filed | unknown |\n| Added by | unknown |\n\n---"
    projects.export_index(rows, str(tmp_path / "index"), "2024-05-06")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "index"), wholetext=True).collect())
    assert text.rstrip("\n") == "# Export — 2024-05-06\n\n| Wing | Rooms | Drawers |\n|------|-------|---------|\n| [unknown](unknown/) | 1 | 1 |\n| [w](w/) | 2 | 2 |"


def test_provenance(spark):
    rows = spark.createDataFrame([("a.md", 0, "x"), ("a.md", 1, "y")], "source_file string, chunk_index int, document string")
    one, two = (ingest.with_provenance(rows, "files", v, F.lit(t)) for v, t in (("1", "2024-01-01"), ("2", "2024-02-01")))
    assert one.select("id").distinct().count() == 2
    kept = ingest.latest(one.unionByName(two)).collect()
    assert len(kept) == 2 and {r.adapter_version for r in kept} == {"2"} and {r.adapter_name for r in kept} == {"files"}
