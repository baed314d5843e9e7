"""Project walks, ignore rules, rooms, session names, closets."""

import random

from pyspark.sql import functions as F

from memlake.operators import collection, kg, metrics, search, summary, transcript
from memlake.sources import ignore, projects, rooms, stores

TOP = "*.log\nbuild/\n!keep.log\n/top.txt\ndocs/**/x.md\n# comment\n\\#odd\n[!a]z.py\n  \n"
SUB = "!deep.log\nsecret?.txt\nlocked/\n!locked/in.txt\n"
DROPPED = {"#odd", "a.log", "build/x.py", "bz.py", "docs/a/b/x.md", "docs/x.md", "sub/build/y.py", "sub/other.log", "sub/secret1.txt", "top.txt", "sub/locked/in.txt"}
KEPT = {"keep.log", "sub/top.txt", "sub/docs/x.md", "az.py", "sub/deep.log", "secret1.txt", "build2/x.py", "sub/secret12.txt"}


def test_ignore_rules(spark):
    of = ignore.rules(spark.createDataFrame([("", TOP), ("sub", SUB)], "base string, content string"))
    paths = spark.createDataFrame([(p,) for p in sorted(DROPPED | KEPT)] * 2, "path string")
    assert {r.path for r in ignore.ignored(paths, of).collect()} == DROPPED
    asked = {r.path for r in ignore.ignored(paths, of, ["/build/", "sub/other.log"]).collect()}
    assert asked == DROPPED - {"build/x.py", "sub/other.log"}
    assert ignore.ignored(paths, of.limit(0)).count() == 0
    assert ignore.ignored(paths.limit(0), of).count() == 0


def test_project_walk(spark, tmp_path):
    for name, text in {"pkg/__init__.py": "x", ".gitignore": "out/\n*.md\n", "out/a.py": "o", "readme.md": "r", "node_modules/m.js": "m", "b.bin": "b", "c.egg-info/d.txt": "d", "sub/_e.jsonl": "{}", "package-lock.json": "{}"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.txt").write_bytes(b"a\xff")
    (tmp_path / "link.txt").symlink_to(tmp_path / "bad.txt")

    def walk(**options):
        return {r.source_file[len(str(tmp_path)) + 1 :]: r.content for r in projects.project_files(spark, str(tmp_path), **options).collect()}

    assert walk() == {"pkg/__init__.py": "x", "sub/_e.jsonl": "{}", "bad.txt": "a�"}
    assert set(walk(respect_ignore=False)) == {"pkg/__init__.py", "sub/_e.jsonl", "bad.txt", "out/a.py", "readme.md"}
    assert set(walk(include=["out", "b.bin", "node_modules/m.js"])) == {"pkg/__init__.py", "sub/_e.jsonl", "bad.txt", "out/a.py", "b.bin", "node_modules/m.js"}


def test_rooms(spark):
    paths = spark.createDataFrame([(p,) for p in ["Front-End/a.js", "client/b.js", "my lib/docs/c.md", "zz/x.py", "node_modules/api/y.js", "top.md", "my lib/other/q.md"]], "path string")
    assert {(r.room, r.folder) for r in rooms.from_folders(paths).collect()} == {("frontend", "Front-End"), ("my_lib", "my lib"), ("documentation", "docs"), ("general", "")}
    assert [(r.room, r.n) for r in rooms.from_names(paths).collect()] == [("general", 0)]
    more = spark.createDataFrame([("a/test_api.py",), ("test-db.py",)], "path string")
    assert {(r.room, r.n) for r in rooms.from_names(more).collect()} == {("testing", 2), ("backend", 2)}


def test_session_names(spark):
    one = ["Start v1", "⏺ 9:05 AM Monday, March 3, 2025", "> git status", "> ok", "> Fix the  login, please!", "told by Ann"] + ["."] * 6
    two = ["Start v1", "> hello there all"] + ["."] * 9
    rows = [("a/my log.txt", i, x) for i, x in enumerate(one + two + ["Start v1", "short"])]
    lines = transcript.sessions(spark.createDataFrame(rows, "source_file string, line_no int, line string"), "^Start")
    got = {r.session: r.name for r in transcript.session_names(lines, ["Bob", "ann"]).collect()}
    assert got == {1: "my_log_2025-03-03_905AM_ann_Fix-the-login-please.txt", 2: "my_log_part02_unknown_hello-there-all.txt"}
    assert set(r.name for r in transcript.session_names(lines, []).collect()) == {"my_log_2025-03-03_905AM_unknown_Fix-the-login-please.txt", "my_log_part02_unknown_hello-there-all.txt"}


def test_closets_hold_every_line(spark):
    rng = random.Random(1)
    rows = [(d, i, "x" * rng.randrange(0, 60)) for d in range(40) for i in range(rng.randrange(1, 17))]
    got = {(r.id, r.closet): r.text for r in summary.closets(spark.createDataFrame(rows, "id int, position int, line string"), size=100).collect()}
    want, number, used = {}, 0, 0
    for d, i, line in rows:
        if i == 0:
            number, used = 1, 0
        elif used > 0 and used + len(line) + 1 > 100:
            number, used = number + 1, 0
        want.setdefault((d, number), []).append(line)
        used += len(line) + 1
    assert got == {k: "\n".join(v) for k, v in want.items()}


def test_summary_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "", "w"), (3, "Bob and Bobby met Ann", None)], "id int, document string, wing string")
    got = {r.id: r.summary for r in summary.compress(rows, known={"Ann": "ANX", "low": "LOW"}).collect()}
    assert got == {1: "0:???|misc", 2: "w|?|?|?\n0:???|misc", 3: '0:ANX|bob_bobby_ann|"Bob and Bobby met Ann"'}
    assert summary.compress(rows.limit(0)).count() == 0


def test_repair(spark):
    ids = spark.range(5)
    rows = ids.where("id <> 3").withColumn("document", F.when(F.col("id") != 1, "x"))
    bad = collection.unreadable(ids, rows)
    assert sorted(r.id for r in bad.collect()) == [1, 3]
    assert sorted(r.id for r in collection.prune(rows, bad).collect()) == [0, 2, 4]


def test_walk_of_a_store_that_only_spark_reads(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("x")
    (tmp_path / "b.bin").write_text("b")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.walk.link./p", f"file://{tmp_path}")
    got = {(r.source_file, r.content) for r in projects.project_files(spark, "viewfs://walk/p").collect()}
    assert got == {("viewfs://walk/p/a/x.py", "x")}


def test_copies(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "id int, document string")
    assert (stores.copy_new(rows, path, ["id"]), stores.copy_new(rows, path, ["id"])) == (2, 0)
    assert stores.copy_new(spark.createDataFrame([(2, "x"), (3, "d")], "id int, document string"), path, ["id"]) == 1
    old = stores.replace(spark.read.parquet(path).where("id <> 2"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 3]
    assert sorted(r.id for r in spark.read.parquet(old).collect()) == [1, 2, 3]
    assert stores.replace(spark.read.parquet(path), path, keep_old=False) is None
    assert [tuple(r) for r in stores.counts_agree(spark.read.parquet(old), spark.read.parquet(path), ["id"]).collect()] == [(2, 1, 0)]


def test_entities_of_the_graph(spark):
    of = spark.createDataFrame([("a", "A", "x", {"k": "1"}, ["al"]), ("b", "B", "y", {"k": "2", "m": "3"}, None), ("c", "C", "z", None, None)], "id string, name string, type string, properties map<string,string>, alias array<string>")
    t = spark.createDataFrame([("b", "knows", "b"), ("c", "knows", "a")], "subject string, predicate string, object string")
    merged, facts = kg.merge_entities(of, t, "b", "a")
    got = {r.id: (r.name, r.properties, r.alias) for r in merged.collect()}
    assert got == {"a": ("A", {"k": "1", "m": "3"}, ["B", "al"]), "c": ("C", None, None)}
    assert sorted(map(tuple, facts.collect())) == [("a", "knows", "a"), ("c", "knows", "a")]
    assert kg.merge_entities(of, t, "no", "a")[0].count() == 3
    new = spark.createDataFrame([("a", "A2", "x", {"q": "1"}), ("d", "D", "x", None)], "id string, name string, type string, properties map<string,string>")
    assert {(r.id, r.name) for r in kg.add_entities(of, new).collect()} == {("a", "A2"), ("b", "B"), ("c", "C"), ("d", "D")}
    sheets = spark.createDataFrame([("Max", "alice", "", None, None, "daughter", "2015-04-01", ["chess", "MUSIC"]), ("Rex", None, None, None, None, "dog", None, None)], "name string, parent string, partner string, sibling string, owner string, relationship string, birthday string, interests array<string>")
    assert sorted(map(tuple, kg.seed_triples(sheets).collect()), key=str) == [("Max", "child_of", "Alice", "2015-04-01"), ("Max", "is_child_of", "Alice", "2015-04-01"), ("Max", "loves", "Chess", "2025-01-01"), ("Max", "loves", "Music", "2025-01-01"), ("Rex", "is_pet_of", "Rex", None)]


def test_routes_and_reports(spark):
    rooms_ = spark.createDataFrame([(f"r{i}", "tea cup" if i == 4 else "tea" if i % 2 else "") for i in range(7)], "room string, summary string")
    assert [r.room for r in search.route_rooms(rooms_, ["tea", "cup"], 3).collect()] == ["r4", "r1", "r3"]
    assert sorted(r.room for r in search.route_rooms(rooms_, ["tea", "cup"]).collect()) == ["r1", "r4"]
    recalls = spark.createDataFrame([("a", 1.0), ("a", 0.5), ("b", 0.0)], "category string, recall double")
    assert {tuple(r) for r in metrics.recall_report(recalls).collect()} == {("a", 2, 0.75, 1, 1, 0), ("b", 1, 0.0, 0, 0, 1), (None, 3, 0.5, 1, 1, 1)}
