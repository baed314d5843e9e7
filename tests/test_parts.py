"""Sources, streams and operators without SQL form."""

import json
import random

import pytest
from pyspark.sql import functions as F

from memlake.functions import dates, text
from memlake.operators import classify, near_dup, transcript
from memlake.sources import chats, projects
from memlake.streaming import sweep


def write(folder, name, lines):
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def message(kind, content, n, session="s1"):
    return {"type": kind, "uuid": f"u{n}", "sessionId": session, "timestamp": f"2024-01-01T00:00:{n:02d}Z", "message": {"role": kind, "content": content}}


def test_session_logs(spark, tmp_path):
    tool = [{"type": "tool_result", "content": "result"}]
    write(tmp_path, "a.jsonl", [message("user", "hello", 1), message("assistant", [{"type": "text", "text": "one"}], 2), message("user", tool, 3), message("assistant", "two", 4), "broken {", {"type": "progress"}, message("user", "bye", 5)])
    rows = chats.lines(spark, str(tmp_path))
    turns = [(r.role, r.text) for r in chats.session_turns(rows).orderBy("position").collect()]
    assert turns == [("user", "hello"), ("assistant", "one\n→ result\ntwo"), ("user", "bye")]
    kept = chats.sweep_records(rows).collect()
    assert sorted(r.uuid for r in kept) == ["u1", "u2", "u4", "u5"]
    doc = chats.transcripts(chats.session_turns(rows)).first().document
    assert doc == "> hello\none\n→ result\ntwo\n\n> bye\n"


def test_exports(spark, tmp_path):
    for name, data in {
        "web": [{"chat_messages": [{"sender": "human", "text": "q"}, {"sender": "assistant", "content": [{"type": "text", "text": "a"}]}]}],
        "tree": {"mapping": {"r": {"parent": None, "message": None, "children": ["x"]}, "x": {"parent": "r", "message": {"author": {"role": "user"}, "content": {"parts": ["q"]}}, "children": ["y", "z"]}, "y": {"parent": "x", "message": {"author": {"role": "assistant"}, "content": {"parts": ["a"]}}, "children": ["r"]}, "z": {"parent": "x", "message": {"author": {"role": "assistant"}, "content": {"parts": ["no"]}}, "children": []}}},
        "channel": [{"type": "message", "user": "A[1]", "text": "hi"}, {"type": "message", "user": "B", "text": "yo"}, {"type": "message", "user": "C", "text": "all"}, {"type": "join", "user": "D"}],
    }.items():
        (tmp_path / name).mkdir()
        write(tmp_path / name, "f.json", [data])
    get = lambda f, name: [(r.role, r.text) for r in f(chats.files(spark, str(tmp_path / name))).orderBy("position").collect()]
    assert get(chats.web_export, "web") == [("user", "q"), ("assistant", "a")]
    assert get(chats.tree_export, "tree") == [("user", "q"), ("assistant", "a")]
    assert get(chats.channel_export, "channel") == [("user", "[A_1_] hi"), ("assistant", "[B] yo"), ("user", "[C] all")]


def test_event_log(spark, tmp_path):
    write(tmp_path, "c.jsonl", [{"type": "session_meta"}, {"type": "event_msg", "payload": {"type": "user_message", "message": "q"}}, {"type": "event_msg", "payload": {"type": "agent_message", "message": "a"}}, {"type": "event_msg", "payload": {"type": "token_count"}}])
    assert [(r.role, r.text) for r in chats.event_log_turns(chats.lines(spark, str(tmp_path))).orderBy("position").collect()] == [("user", "q"), ("assistant", "a")]


def test_projects_and_export(spark, tmp_path):
    (tmp_path / "p" / "node_modules").mkdir(parents=True)
    (tmp_path / "p" / "a.md").write_text("text")
    (tmp_path / "p" / "b.bin").write_text("no")
    (tmp_path / "p" / "node_modules" / "c.md").write_text("no")
    (tmp_path / "p" / "2024-05-06.md").write_text("intro\n## one\nx\n## two\ny")
    files = projects.project_files(spark, str(tmp_path / "p"))
    assert files.count() == 2
    assert [r.entry for r in projects.diary_entries(files, "w").orderBy("position").collect()] == ["intro", "## one\nx", "## two\ny"]
    projects.export_markdown(spark.createDataFrame([(1, "a\nb", "w/1", None)], "id long, document string, wing string, room string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "wing=w_1" / "room=general")).first().value == "## 1"
    eav = spark.createDataFrame([(1, "chroma:document", "d", None, None, None), (1, "n", None, 3, None, None)], "id long, key string, string_value string, int_value long, float_value double, bool_value boolean")
    row = projects.pivot_store(eav).first()
    assert (row.document, row.metadata) == ("d", {"n": "3"})


def test_sweep_stream(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "a.jsonl", [message("user", "x", 5), message("assistant", "y", 6)])
    sweep.sweep_stream(spark, source, target, state).awaitTermination()
    write(tmp_path / "in", "b.jsonl", [message("user", "late", 1), message("assistant", "y", 6), message("user", "same time", 6) | {"uuid": "u7"}, message("user", "z", 9)])
    sweep.sweep_stream(spark, source, target, state).awaitTermination()
    assert sorted(r.uuid for r in spark.read.parquet(target).collect()) == ["u5", "u6", "u7", "u9"]


def test_save_every(spark, tmp_path):
    (tmp_path / "m").mkdir()
    write(tmp_path / "m", "a.json", [{"session_id": "s", "role": "user"}] * 7 + [{"session_id": "t", "role": "user"}])
    stream = sweep.save_every(spark.readStream.schema("session_id string, role string").json(str(tmp_path / "m")), 3)
    stream.writeStream.format("memory").queryName("saves").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.session_id, r.saves) for r in spark.table("saves").collect()] == [("s", 2)]


def _windows(text, size, overlap):
    """Every place of a window's second half looked at, one by one."""
    out, start = [], 0
    while len(text) - start > size:
        half = range(start + size // 2 + 1, start + size)
        blank = [p for p in half if text[p : p + 2] == "\n\n" and p + 2 <= start + size]
        line = [p for p in half if text[p] == "\n"]
        end = max(blank, default=max(line, default=start + size))
        out.append((start, end))
        start = end - overlap
    return [*out, (start, len(text))]


def test_windows_against_brute_force():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b", " ", "\n", "\n\n", "cc cc"]) for _ in range(rng.randrange(120)))
        size = rng.randrange(5, 60)
        overlap = rng.randrange(0, (size - 1) // 2 + 1)
        if 2 * overlap < size:
            assert list(transcript.windows(text, size, overlap)) == _windows(text, size, overlap)
    with pytest.raises(ValueError, match="overlap"):
        list(transcript.windows("abc", 10, 5))


def test_chunks_and_greedy(spark):
    long = ("word " * 300).strip() + "\n\n" + "tail " * 100
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, None), (4, "")], "id long, document string")
    want = [long.strip()[a:b].strip() for a, b in _windows(long.strip(), 800, 100)]
    assert [(r.id, r.chunk_index, r.chunk) for r in transcript.fixed_chunks(docs).orderBy("chunk_index").collect()] == [(1, i, p) for i, p in enumerate(want)]
    rows = spark.createDataFrame([("f", 1, "a" * 50, [1.0, 0.0]), ("f", 2, "b" * 40, [0.99, 0.01]), ("f", 3, "c" * 30, [0.0, 1.0]), ("f", 4, "x", [0.5, 0.5]), ("f", 5, "z" * 30, [0.0, 0.0])], "source_file string, id long, document string, embedding array<double>")
    assert {r.id: r.kept for r in near_dup.greedy(rows).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_text_functions(spark):
    row = spark.range(1).select(
        text.strip_noise(F.lit("a\n<system-reminder>x\ny</system-reminder>\nCURRENT TIME: now\nRan 2 Stop hooks\nb [3 tokens] (ctrl+o to expand)")).alias("n"),
        text.entity_slug(F.lit("O'Brien & Co.")).alias("s"),
        text.entity_id(F.lit("O'Brien Co")).alias("i"),
        dates.date_from_name(F.lit("x/20240231_2024-02-30.md")).alias("d"),
        dates.date_from_name(F.lit("x/log_20240229.md")).alias("e"),
        classify.keyword_class(F.lit("the code is alive and real"), classify.HALLS, "general").alias("h"),
    ).first()
    assert (row.n, row.s, row.i, row.d, row.e, row.h) == ("a\nb", "obrien_co", "obrien_co", None, "2024-02-29", "consciousness")


def test_sanitize_query(spark):
    def clean(q):
        r = spark.range(1).select(text.sanitize_query(F.lit(q)).alias("c")).first().c
        return r.clean_query, r.method

    assert clean("  short?  ") == ("short?", "passthrough")
    assert clean(None) == ("", "passthrough")
    assert clean("x " * 150 + "\nWhat is \"it\" called?\nthanks") == ('What is "it" called?', "question_extraction")
    assert clean("word " * 60 + "\n'\"the last line here\"'") == ("the last line here", "tail_sentence")
    assert clean("ab\n" * 90)[1] == "tail_truncation"
    row = spark.range(1).select(text.normalised_answer(F.lit("The cat, and a Dog's  tail.")).alias("a")).first()
    assert row.a == "the cat dogs tail"


def test_registry_lookup(spark):
    from memlake.operators import entities

    registry = spark.createDataFrame(
        [("Grace", "person", ["Gracie"], 1.0, "told", True), ("Max", "person", None, 1.0, "told", False), ("max", "project", [], 1.0, "told", False), ("Vesper", "project", [], 1.0, "told", False), ("Ada", "language", [], 0.8, "cache", False)],
        "name string, kind string, alias array<string>, confidence double, source string, ambiguous boolean",
    )
    asked = [("grace", "I saw Grace, and Grace said hi"), ("grace", "the grace of it"), ("grace", "grace"), ("gracie", None), ("MAX", "x"), ("vesper", ""), ("ada", None), ("c++", "no"), (None, None)]
    got = [(r.word, r.type, round(r.confidence, 2), r.name) for r in entities.lookup(spark.createDataFrame(asked, "word string, context string"), registry).collect()]
    want = [("grace", "person", 0.9, "grace"), ("grace", "concept", 0.8, "grace"), ("grace", "person", 1.0, "Grace"), ("gracie", "person", 1.0, "Grace"), ("MAX", "person", 1.0, "Max"), ("vesper", "project", 1.0, "Vesper"), ("ada", "language", 0.8, "Ada"), ("c++", "unknown", 0.0, "c++"), (None, "unknown", 0.0, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_tools_in_session_logs(spark, tmp_path):
    use = lambda i, name, **k: {"type": "tool_use", "id": f"t{i}", "name": name, "input": k}
    result = lambda i, content: {"type": "tool_result", "tool_use_id": f"t{i}", "content": content}
    calls = [use(1, "Bash", command="ls"), use(2, "Read", file_path="a.py", offset=3, limit=4), use(3, "Grep", pattern="x", glob="*.py"), use(4, "Other", a=1), use(5, "Edit", file_path="b")]
    results = [result(1, "\n".join(map(str, range(45)))), result(2, "never"), result(3, [{"type": "text", "text": "\n".join("m" * 25)}]), result(4, "y" * 3000), result(9, "[not json")]
    write(tmp_path, "a.jsonl", [message("user", "go", 1), message("assistant", calls, 2), message("user", results, 3), message("assistant", "done", 4)])
    text = [r.text for r in chats.session_turns(chats.lines(spark, str(tmp_path))).orderBy("position").collect()][1]
    bash = [f"→ {i}" for i in range(20)] + ["→ ... [5 lines omitted] ..."] + [f"→ {i}" for i in range(25, 45)]
    grep = ["→ m"] * 20 + ["→ ... [5 more matches]"]
    heads = ["[Bash] ls", "[Read a.py:3-7]", "[Grep] x in *.py", '[Other] {"a":1}', "[Edit b]"]
    assert text.split("\n") == heads + bash + grep + ["→ " + "y" * 2048 + "... [truncated, 3000 chars]", "→ [not json", "done"]


def test_normalise(spark, tmp_path):
    write(tmp_path, "log.jsonl", [message("user", "q", 1), message("assistant", "a", 2)])
    write(tmp_path, "events.jsonl", [{"type": "session_meta"}, {"type": "event_msg", "payload": {"type": "user_message", "message": "q"}}, {"type": "event_msg", "payload": {"type": "agent_message", "message": "a"}}])
    write(tmp_path, "web.json", [[{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]])
    write(tmp_path, "other.json", [{"x": 1}])
    write(tmp_path, "quoted.txt", ["> a", "> b", "> c", "[1]"])
    (tmp_path / "empty.txt").write_text("")
    got = {r.source_file.rsplit("/", 1)[1]: r.document for r in chats.normalise(spark, str(tmp_path)).collect()}
    assert {got[k] for k in ("log.jsonl", "events.jsonl", "web.json")} == {"> q\na\n"}
    assert "empty.txt" not in got or got["empty.txt"] == ""
    assert got["other.json"] == '{"x": 1}' and got["quoted.txt"] == "> a\n> b\n> c\n[1]"


def test_answers_of_any_script(spark):
    import re
    import string
    from memlake.plans import catalogue

    def plain(x):
        x = " ".join(re.sub(r"\b(a|an|the|and)\b", " ", x.replace(",", "")).split())
        return "".join(c for c in x if c not in string.punctuation).lower().strip()

    told = ["aé the éa an", "The naïve a-ñ and\u00a0the\u2003Ü", "и a и", "2a a2 _a a_"]
    got = spark.createDataFrame([(x,) for x in told], "x string").select("x", text.normalised_answer(F.col("x")).alias("a")).collect()
    assert [r.a for r in got] == [plain(r.x) for r in got]
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()}
    rows = catalogue.QUERIES["answer_normalise"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(turns) and any(not x.isascii() for x in turns.values())
    assert all(r.answer == plain(turns[r.conv_id, r.turn]) for r in rows)


def test_sanitize_every_document(spark):
    import re
    from memlake.plans import catalogue

    def unquoted(x):
        x = x.strip()
        while len(x) >= 2 and x[0] in "'\"" and x[0] == x[-1]:
            x = x[1:-1].strip()
        x = x[1:].strip() if x[:1] in ("'", '"') else x
        return x[:-1].strip() if x[-1:] in ("'", '"') else x

    def trimmed(x):
        x = unquoted(x)
        parts = [p for p in map(unquoted, re.split(r"[.!?。！？\n]+", x)) if 10 <= len(p) <= 250]
        return x if len(x) <= 250 else parts[-1] if parts else x[-250:].strip()

    def plain(q):
        q = (q or "").strip()
        if len(q) <= 200:
            return q, "passthrough"
        lines = [x.strip() for x in q.split("\n") if x.strip()]
        asked = [x for x in lines if re.search(r"[?？]\s*[\"']?\s*$", x)]
        if asked and len(asked[-1]) >= 10:
            return trimmed(asked[-1]) if len(asked[-1]) > 250 else asked[-1], "question_extraction"
        tails = [x for x in (trimmed(x) for x in lines if len(x) >= 10) if len(x) >= 10]
        return (tails[-1], "tail_sentence") if tails else (q[-250:].strip(), "tail_truncation")

    made = ["say. " * 60 + "'What is \"it\" called?'", "word " * 60 + "\nIs it here?\nNo.", "\"" + "A talk. " * 40 + "\"", "'It''s' " * 60]
    got = spark.createDataFrame([(x,) for x in made], "x string").select("x", text.sanitize_query(F.col("x")).alias("c")).collect()
    assert [tuple(r.c) for r in got] == [plain(r.x) for r in got]
    held = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = catalogue.QUERIES["query_sanitize"](spark, "/root/testdata/sf0.01").collect()
    assert {r.id for r in rows} == set(held) and any(i % 2 and re.search("[\"'?？]", x or "") for i, x in held.items())
    assert [r.id for r in rows if (r.clean_query, r.method) != plain(held[r.id])] == []


def test_queries_over_whole_tables(spark):
    from memlake.plans import catalogue
    from memlake.plans.tables import read

    d = "/root/testdata/sf0.001"
    run = lambda name: catalogue.QUERIES[name](spark, d)
    n = read(spark, d, "documents").count()
    assert run("neighbour_expand").count() == run("tunnel_symmetric_ids").count() == n
    last = {r.user_id: r.ts for r in read(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("ts")).collect()}
    assert {r.session_id: r.cursor for r in run("session_cursor").collect()} == last


def test_odd_files_end_nothing(spark, tmp_path):
    odd = [{"mapping": {"a": 1, "b": {"parent": None, "message": [1], "children": 5}}}, [{"role": ["x"], "content": "q"}, {"role": "user", "content": {"text": 3}}], {"messages": "no"}, [{"type": "message", "user": 3, "text": None}], 7, None, {"mapping": []}]
    for i, data in enumerate(odd):
        write(tmp_path, f"odd{i}.json", [data])
    write(tmp_path, "broken.jsonl", ["{", "["])
    write(tmp_path, "half.jsonl", ["{", message("user", "q", 1), message("assistant", "a", 2)])
    write(tmp_path, "good.json", [[{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]])
    write(tmp_path, "channel.json", [[{"type": "message", "user": "A", "text": "hi"}, {"type": "message", "user": "B", "text": "yo"}]])
    read = {r.source_file.rsplit("/", 1)[-1]: r.document for r in chats.normalise(spark, str(tmp_path)).collect()}
    assert len(read) == 11 and read["good.json"] == read["half.jsonl"] == "> q\na\n"
    assert read["channel.json"] == "> [A] hi\n[B] yo\n" + chats.FOOTER
    assert [r.source_file.rsplit("/", 1)[-1] for r in chats.broken_files(chats.files(spark, str(tmp_path))).collect()] == ["broken.jsonl"]


def test_sweep_reads_the_newest_rows_only(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "a.jsonl", [message("user", "x", 5), message("assistant", "y", 6), message("user", "o", 1, "s2")])
    sweep.sweep_stream(spark, source, target, state).awaitTermination()
    assert sorted((r.session_id, r.id) for r in spark.read.parquet(f"{target}.tips").collect()) == [("s1", "sweep_s1_u6"), ("s2", "sweep_s2_u1")]
    import shutil

    shutil.rmtree(f"{target}.tips")  # made again from the target
    write(tmp_path / "in", "b.jsonl", [message("user", "late", 2), message("user", "y", 6), message("user", "z", 9)])
    sweep.sweep_stream(spark, source, target, state).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == ["sweep_s1_u5", "sweep_s1_u6", "sweep_s1_u9", "sweep_s2_u1"]
