"""Chat exports as message tables.

Exports are read by Spark from any store it knows. Formats that are one JSON object per line, or one JSON document with
plain nesting, are parsed by Spark's own JSON functions. Two formats need state that depends on what came before (a walk
down a tree, roles dealt to speakers as they appear); they are parsed a whole file at a time, in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let, strip, strip_noise

MESSAGES = "source_file string, conversation int, position int, role string, text string"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, content), one row per file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("source_file"), F.col("value").alias("content"))


#: Kinds of files that hold conversations, what side files end in, and the largest file that is read.
KINDS, SIDE, LARGEST = (".txt", ".md", ".json", ".jsonl"), ".meta.json", 500 * 1024 * 1024


def conversation_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, content) of the files below a path that may be conversations: by kind, without side files, files in
    folders of tools, and files too large. Others aren't opened, as the conditions are on what the listing knows.
    """
    from .projects import SKIPPED

    file = F.col("_metadata.file_path")
    low, folders = F.lower(file), F.split(file, "/")
    known = reduce(lambda a, b: a | b, [F.endswith(low, F.lit(k)) for k in KINDS])
    good = known & ~F.endswith(low, F.lit(SIDE)) & (F.col("_metadata.file_size") <= LARGEST) & ~F.exists(F.slice(folders, 1, F.size(folders) - 1), lambda x: x.isin(*SKIPPED))
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).where(good).select(file.alias("source_file"), F.col("value").alias("content"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line_no, line). Numbers follow the file's order; a file is one group."""
    content = files(spark, path)
    return content.select("source_file", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))


def _block_text(content: Column) -> Column:
    """Text of a message's content: a string, or the text parts of its blocks."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    parts = F.filter(F.transform(blocks, lambda b: F.when(b["type"] == "text", b["text"])), lambda t: t.isNotNull())
    return strip(F.when(F.startswith(content, F.lit("[")), F.array_join(parts, "\n")).otherwise(content))


def sweep_records(rows: DataFrame) -> DataFrame:
    """Messages of line-wise session logs: (session_id, uuid, timestamp, role, content); other and broken lines go."""
    j = lambda p: F.get_json_object("line", p)
    out = rows.select(
        "source_file",
        F.coalesce(j("$.sessionId"), j("$.session_id")).alias("session_id"),
        j("$.uuid").alias("uuid"),
        j("$.timestamp").alias("timestamp"),
        j("$.message.role").alias("role"),
        _block_text(j("$.message.content")).alias("content"),
        j("$.type").alias("kind"),
    )
    good = "kind in ('user', 'assistant') and role in ('user', 'assistant') and session_id <> '' and uuid <> '' and timestamp <> '' and content <> ''"
    return out.where(good).drop("kind")


def human_messages(rows: DataFrame) -> DataFrame:
    """(source_file, n): messages that a person wrote, in session logs and event logs; those that carry a command don't count."""
    j = lambda p: F.get_json_object("line", p)
    said = F.when(j("$.message.role") == "user", _block_text(j("$.message.content"))).when((j("$.type") == "event_msg") & (j("$.payload.type") == "user_message"), F.coalesce(j("$.payload.message"), F.lit("")))
    kept = rows.select("source_file", said.alias("said")).where(F.col("said").isNotNull() & ~F.contains("said", F.lit("<command-message>")))
    return kept.groupBy("source_file").agg(F.count("*").alias("n"))


#: Lines shown of a shell's output at either end, matches shown, and characters of other results and of inputs.
ENDS, MATCHES, RESULT, INPUT = 20, 20, 2048, 200
BLOCK = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string>>"


def tool_use_line(name: Column, arguments: Column) -> Column:
    """One line for a tool's call: its command, file, pattern, or the start of its arguments (JSON)."""
    g = lambda k: F.get_json_object(arguments, f"$.{k}")
    start = lambda x: F.when(F.length(x) > INPUT, F.concat(F.substring(x, 1, INPUT), F.lit("..."))).otherwise(x)
    empty, path = F.lit(""), F.coalesce(g("file_path"), F.lit("?"))
    offset, limit = g("offset"), g("limit")
    end = F.coalesce(F.concat(F.lit("-"), (offset.try_cast("long") + limit.try_cast("long")).cast("string")), F.concat(F.lit("+"), limit))
    span = F.when(offset.isNotNull() & limit.isNotNull(), F.concat(F.lit(":"), offset, end)).otherwise(empty)
    target = F.coalesce(F.nullif(g("path"), empty), g("glob"), empty)
    return (
        F.when(name == "Bash", F.concat(F.lit("[Bash] "), start(F.coalesce(g("command"), empty))))
        .when(name == "Read", F.concat(F.lit("[Read "), path, span, F.lit("]")))
        .when(name == "Grep", F.concat(F.lit("[Grep] "), F.coalesce(g("pattern"), empty), F.lit(" in "), target))
        .when(name == "Glob", F.concat(F.lit("[Glob] "), F.coalesce(g("pattern"), empty)))
        .when(name.isin("Edit", "Write"), F.concat(F.lit("["), name, F.lit(" "), path, F.lit("]")))
        .otherwise(F.concat(F.lit("["), F.coalesce(name, F.lit("Unknown")), F.lit("] "), start(F.coalesce(arguments, F.lit("{}")))))
    )


def tool_result_text(content: Column, tool: Column) -> Column:
    """A tool's result, each line after an arrow. Files read or written are left out (empty); a shell's output keeps both ends, searches their first matches."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    listed = F.array_join(F.transform(F.filter(blocks, lambda x: x["type"] == "text"), lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    text = strip(F.coalesce(F.when(F.startswith(content, F.lit("[")), listed), content, F.lit("")))

    def shown(t: Column) -> Column:
        rows, arrow = F.split(t, "\n"), lambda x: F.concat(F.lit("→ "), F.array_join(x, "\n→ "))
        n = F.size(rows)
        more = lambda x, what: F.array(F.concat(F.lit("... ["), x.cast("string"), F.lit(what)))
        both = F.concat(F.slice(rows, 1, ENDS), more(n - 2 * ENDS, " lines omitted] ..."), F.slice(rows, -ENDS, ENDS))
        first = F.concat(F.slice(rows, 1, MATCHES), more(n - MATCHES, " more matches]"))
        return (
            F.when((t == "") | tool.isin("Read", "Edit", "Write"), F.lit(""))
            .when(tool == "Bash", F.when(n <= 2 * ENDS, arrow(rows)).otherwise(arrow(both)))
            .when(tool.isin("Grep", "Glob"), F.when(n <= MATCHES, arrow(rows)).otherwise(arrow(first)))
            .otherwise(F.concat(F.lit("→ "), F.substring(t, 1, RESULT), F.when(F.length(t) > RESULT, F.concat(F.lit("... [truncated, "), F.length(t).cast("string"), F.lit(" chars]"))).otherwise("")))
        )

    return let(text, shown)


def _messages(rows: DataFrame) -> DataFrame:
    """(source_file, line_no, kind, text) of session logs: blocks joined by lines; results find their tool by the call's id in the file."""
    j = lambda p: F.get_json_object("line", p)
    content = j("$.message.content")
    blocks = F.when(F.startswith(content, F.lit("[")), F.from_json(content, BLOCK))
    tool_only = F.coalesce(F.forall(blocks, lambda b: b["type"] == "tool_result"), F.lit(False))
    kind = F.when(j("$.type").isin("human", "user"), F.when(tool_only, "tool").otherwise("user")).when(j("$.type") == "assistant", "assistant")
    said = rows.select("source_file", "line_no", kind.alias("kind"), content.alias("content"), blocks.alias("blocks")).where("kind is not null")
    each = said.select("source_file", "line_no", "kind", "content", F.posexplode_outer("blocks").alias("i", "b"))
    tools = each.where("kind = 'assistant' and b.type = 'tool_use' and b.id <> ''").groupBy("source_file", F.col("b.id").alias("__id")).agg(F.min(F.coalesce("b.name", F.lit("Unknown"))).alias("__tool"))
    met = each.withColumn("__id", F.when(F.col("b.type") == "tool_result", F.col("b.tool_use_id"))).join(tools, ["source_file", "__id"], "left")
    part = (
        F.when(F.col("b").isNull(), F.when(F.startswith("content", F.lit("{")), F.get_json_object("content", "$.text")).otherwise(F.col("content")))
        .when(F.col("b.type") == "text", F.col("b.text"))
        .when(F.col("b.type") == "tool_use", tool_use_line(F.col("b.name"), F.col("b.input")))
        .when(F.col("b.type") == "tool_result", tool_result_text(F.col("b.content"), F.coalesce("__tool", F.lit("Unknown"))))
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(part != "", F.struct(F.col("i"), part.alias("t"))))), lambda x: x["t"]), "\n")
    return met.groupBy("source_file", "line_no", "kind").agg(text.alias("text")).withColumn("text", strip_noise(strip(F.col("text")))).where("text <> ''")


def session_turns(rows: DataFrame) -> DataFrame:
    """Turns of line-wise session logs: results of tools go to the assistant's turn before, consecutive ones are merged."""
    typed = _messages(rows)
    w = Window.partitionBy("source_file").orderBy("line_no")
    role = F.when(F.col("kind") == "user", "user").otherwise("assistant")
    runs = typed.withColumn("role", role).withColumn("__new", F.when(role == "user", 1).otherwise((F.lag("role").over(w) != "assistant").cast("int")))
    runs = runs.withColumn("position", F.sum(F.coalesce("__new", F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Results without an assistant's turn before them have no place.
    kept = runs.withColumn("__first", F.first("kind").over(Window.partitionBy("source_file", "position").orderBy("line_no"))).where("__first <> 'tool'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return kept.groupBy("source_file", "position", "role").agg(text.alias("text"))


def event_log_turns(rows: DataFrame) -> DataFrame:
    """Turns of event logs; only files with session metadata count, only user and agent messages are turns."""
    j = lambda p: F.get_json_object("line", p)
    typed = rows.select("source_file", "line_no", j("$.type").alias("type"), j("$.payload.type").alias("kind"), strip(j("$.payload.message")).alias("text"))
    known = typed.groupBy("source_file").agg(F.bool_or(F.col("type") == "session_meta").alias("ok")).where("ok")
    said = typed.where("type = 'event_msg' and kind in ('user_message', 'agent_message') and text <> ''").join(known, "source_file", "left_semi")
    return said.select("source_file", F.col("line_no").alias("position"), F.when(F.col("kind") == "user_message", "user").otherwise("assistant").alias("role"), "text")


def _each_file(content: DataFrame, parse: Callable[[object], Iterator[tuple[int, int, str, str]]]) -> DataFrame:
    def mapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, text in zip(frame.source_file, frame.content):
                try:
                    data = json.loads(text or "")
                except ValueError:
                    continue
                rows += [(name, *m) for m in parse(data)]
            yield pd.DataFrame(rows, columns=["source_file", "conversation", "position", "role", "text"])

    return content.select("source_file", "content").mapInPandas(mapped, MESSAGES)


def broken_files(content: DataFrame) -> DataFrame:
    """(source_file, error) of the files of JSON lines or values that can't be read: none of their lines, or not the value.

    All other files are read without them; one broken file never ends a sweep.
    """

    def mapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, text in zip(frame.source_file, frame.content):
                parts = [x for x in (text or "").splitlines() if x.strip()] if name.lower().endswith(".jsonl") else [text or ""]
                errors = [e for e in map(_error_of, parts) if e]
                if parts and len(errors) == len(parts):
                    rows.append((name, errors[0]))
            yield pd.DataFrame(rows, columns=["source_file", "error"])

    named = content.where(F.rlike(F.lower("source_file"), F.lit(r"\.jsonl?$")))
    return named.select("source_file", "content").mapInPandas(mapped, "source_file string, error string")


def _error_of(text: str) -> str | None:
    try:
        json.loads(text)
    except ValueError as e:
        return str(e)
    return None


def _dict(x: object) -> dict:
    return x if isinstance(x, dict) else {}


def _list(x: object) -> list:
    return x if isinstance(x, list) else []


def _name(x: object) -> str:
    return x if isinstance(x, str) else ""


def _text_of(content: object) -> str:
    if isinstance(content, str):
        return content.strip()
    if isinstance(content, dict):
        return str(content.get("text") or "").strip()
    if isinstance(content, list):
        return "\n".join(x for x in (b if isinstance(b, str) else _name(b.get("text")) if isinstance(b, dict) and b.get("type", "text") == "text" else "" for b in content) if x).strip()
    return ""


def _web(data: object) -> Iterator[tuple[int, int, str, str]]:
    inner = lambda d: _list(d.get("chat_messages") or d.get("messages"))
    if isinstance(data, dict):
        data = inner(data)
    if not isinstance(data, list):
        return
    many = bool(data) and isinstance(data[0], dict) and ("chat_messages" in data[0] or "messages" in data[0])
    for c, conversation in enumerate([inner(d) for d in data if isinstance(d, dict)] if many else [data]):
        roles = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant"}
        said = [(roles.get(_name(m.get("role")) or _name(m.get("sender"))), _text_of(m.get("content")) or str(m.get("text") or "").strip()) for m in conversation if isinstance(m, dict)]
        said = [(r, t) for r, t in said if r and t]
        if len(said) >= 2:
            yield from ((c, i, r, t) for i, (r, t) in enumerate(said))


def web_export(content: DataFrame) -> DataFrame:
    """Flat message lists, or lists of conversations; the author is in role or sender."""
    return _each_file(content, _web)


def _tree(data: object) -> Iterator[tuple[int, int, str, str]]:
    nodes = {k: n for k, n in _dict(_dict(data).get("mapping")).items() if isinstance(n, dict)}
    roots = [k for k, n in nodes.items() if n.get("parent") is None]
    at = next((k for k in roots if nodes[k].get("message") is None), roots[0] if roots else "")
    seen, said = set(), []
    while at in nodes and at not in seen:
        seen.add(at)
        message = _dict(nodes[at].get("message"))
        role = _name(_dict(message.get("author")).get("role"))
        text = " ".join(p for p in _list(_dict(message.get("content")).get("parts")) if isinstance(p, str)).strip()
        if role in ("user", "assistant") and text:
            said.append((role, text))
        at = _name(next(iter(_list(nodes[at].get("children"))), ""))
    if len(said) >= 2:
        yield from ((0, i, r, t) for i, (r, t) in enumerate(said))


def tree_export(content: DataFrame) -> DataFrame:
    """Message trees: from the root along first children, each node once."""
    return _each_file(content, _tree)


#: Fixed value: the line at the end of a channel's transcript, so that roles dealt out aren't taken for the speakers' own.
FOOTER = "\n[source: slack-export | multi-party chat — speaker roles are positional, not verified]"


def _channel(data: object) -> Iterator[tuple[int, int, str, str]]:
    roles: dict[str, str] = {}
    last, said = None, []
    for item in data if isinstance(data, list) else []:
        if not isinstance(item, dict) or item.get("type") != "message":
            continue
        who = re.sub(r"[\[\]\x00-\x1f]", "_", str(item.get("user", item.get("username", "")))).strip()
        text = str(item.get("text", "")).strip()
        if who and text:
            last = roles.setdefault(who, "assistant" if last == "user" else "user")
            said.append((last, f"[{who}] {text}"))
    if len(said) >= 2:
        yield from ((0, i, r, t) for i, (r, t) in enumerate(said))


def channel_export(content: DataFrame) -> DataFrame:
    """Channels of many speakers: each new speaker gets the role that the last one hasn't."""
    return _each_file(content, _channel)


def transcripts(messages: DataFrame) -> DataFrame:
    """One text per conversation: user lines are quoted, each exchange ends with an empty line."""
    keys = [c for c in ("source_file", "conversation") if c in messages.columns]
    w = Window.partitionBy(*keys).orderBy("position")
    alone = (F.col("role") != "user") | F.coalesce(F.lead("role").over(w) != "assistant", F.lit(True))
    line = F.concat(F.when(F.col("role") == "user", "> ").otherwise(""), F.col("text"), F.when(alone, "\n").otherwise(""))
    rows = messages.withColumn("line", line)
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("document"))


QUOTED = 3


def normalise(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, conversation, document) of every file below a path that may be one: chat exports as transcripts, all else as it is.

    A file with three quoted lines or more is a transcript already. Others that look like JSON are tried as session log,
    event log, web export, message tree and channel; the first that gives a conversation of two messages counts.
    """
    content = conversation_files(spark, path)
    quoted = F.size(F.filter(F.split("content", "\n"), lambda x: F.startswith(strip(x), F.lit(">")))) >= QUOTED
    jsonlike = F.rlike(F.lower("source_file"), F.lit(r"\.jsonl?$")) | F.substring(strip(F.col("content")), 1, 1).isin("{", "[")
    tried = content.where(~quoted & jsonlike & (strip(F.col("content")) != ""))
    rows = tried.select("source_file", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    one = lambda df: df.select("source_file", F.lit(0).alias("conversation"), F.col("position").cast("long").alias("position"), "role", "text")
    many = lambda df: df.withColumn("position", F.col("position").cast("long"))
    found = [one(session_turns(rows)), one(event_log_turns(rows)), many(web_export(tried)), many(tree_export(tried)), many(channel_export(tried))]
    ranked = reduce(lambda a, b: a.unionByName(b), [df.withColumn("format", F.lit(i)) for i, df in enumerate(found)])
    whole = ranked.withColumn("__n", F.count("*").over(Window.partitionBy("source_file", "format", "conversation"))).where("__n >= 2")
    first = whole.withColumn("__f", F.min("format").over(Window.partitionBy("source_file"))).where("format = __f")
    read = transcripts(first.select("source_file", "conversation", "position", "role", "text"))
    channels = first.where(f"format = {len(found) - 1}").select("source_file", F.lit(FOOTER).alias("__end")).distinct()
    read = read.join(channels, "source_file", "left").select("source_file", "conversation", F.concat("document", F.coalesce("__end", F.lit(""))).alias("document"))
    kept = content.join(read.select("source_file").distinct(), "source_file", "left_anti")
    return read.unionByName(kept.select("source_file", F.lit(0).alias("conversation"), F.col("content").alias("document")))
