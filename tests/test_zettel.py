"""Notes as lines, by hand; a project's rooms from its file."""

import json

import pytest

from memlake.operators import ingest, zettel
from memlake.sources import rooms

NOTES = {
    "source_file": "012-A walk - home.txt",
    "emotional_arc": "fear->peace",
    "zettels": [
        {"id": "z-1", "title": "T", "content": 'He wrote "this is only a test" and said: we love the real sea. ', "people": ["Ana", "Zoë", "Ana", "Old Bob", "a bot"], "topics": ["sea", "walk", "third"], "emotional_weight": 0.9, "emotional_tone": ["joyful", "joy", "mild_fear", "oddness", "hope"], "origin_moment": True, "sensitivity": "Maximum", "notes": "A foundational pillar; the pivot", "origin_label": "Genesis", "date_context": "May 1, 2024"},
        {"id": "plain", "title": "Start - the end of it"},
        {},
    ],
    "tunnels": [{"from": "z-1", "to": "z-22", "label": "sea: both"}, {"from": "a", "to": "b", "label": "x" * 40}],
}


def put(path, name, data):
    (path / name).write_text(json.dumps(data))


def test_a_file_of_notes(spark, tmp_path):
    put(tmp_path, "a.json", NOTES)
    row = zettel.decode(zettel.encode(zettel.read(spark, str(tmp_path)), {"Ana": "AN", "bob": "BB"}, ["bot"])).first()
    assert row.encoded.split("\n") == [
        "012|AN+BB+ZOË|May 1, 2024|A walk - home",
        "ARC:fear->peace",
        '1:AN+BB+ZOË|sea_walk|"we love the real sea"|0.9|joy+fear+oddn|ORIGIN+SENSITIVE+CORE+GENESIS+PIVOT',
        'plain:???|misc|"the end of it"|0.5',
        ":???|misc|0.5",
        "T:1<->22|sea",
        "T:a<->b|" + "x" * 30,
    ]
    assert tuple(row.header) == ("012", "AN+BB+ZOË", "May 1, 2024", "A walk - home") and row.arc == "fear->peace"
    assert row.notes == row.encoded.split("\n")[2:5] and row.links == row.encoded.split("\n")[5:]


def test_files_without_notes(spark, tmp_path):
    put(tmp_path, "b.json", {"source_file": "plain"})
    put(tmp_path, "c.json", {"zettels": [], "tunnels": None})
    got = {r.encoded for r in zettel.encode(zettel.read(spark, str(tmp_path))).collect()}
    assert got == {"000|???|unknown|plain", "000|???|unknown|unknown"}
    odd = spark.createDataFrame([("",), ("no bar",), ("a|b",), (None,)], "encoded string")
    rows = zettel.decode(odd).collect()
    assert [tuple(r.header) for r in rows] == [("", "", "", ""), ("", "", "", ""), ("a", "b", "", ""), ("", "", "", "")]


def test_rooms_of_a_project(spark, tmp_path):
    pytest.importorskip("yaml")
    folder = tmp_path / "proj"
    folder.mkdir()
    general = {"name": "general", "description": "All project files", "keywords": ["general"]}
    assert rooms.project_config(spark, str(folder)) == {"wing": "proj", "rooms": [general]}
    (folder / "rooms.yml").write_text("wing: own\nrooms:\n  - name: api\n    keywords: [server, 7]\n  - docs\n  - keywords: [x]\n")
    told = rooms.project_config(spark, str(folder))
    assert told == {"wing": "own", "rooms": [{"name": "api", "description": "", "keywords": ["server", "7"]}, {"name": "docs", "description": "", "keywords": []}]}
    df = spark.createDataFrame([("src/server/a.py", "x"), ("notes/docs.md", "y")], "path string, content string")
    assert [r[0] for r in df.select(ingest.room_of(df.path, df.content, told["rooms"])).collect()] == ["api", "docs"]
    (folder / "rooms.yaml").write_text("- a list")
    with pytest.raises(ValueError, match="no mapping"):
        rooms.project_config(spark, str(folder))
    (folder / "rooms.yaml").write_text("")
    assert rooms.project_config(spark, str(folder)) == {"wing": "proj", "rooms": [general]}
