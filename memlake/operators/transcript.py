"""Assembly of turns and segmentation of texts."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: Size, overlap and least size of chunks.
CHUNK, OVERLAP, LEAST = 800, 100, 50


def merge_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Consecutive turns of a role become one, their texts on lines of their own."""
    w = Window.partitionBy(key).orderBy(order)
    changed = F.coalesce((F.lag("role").over(w) != F.col("role")).cast("int"), F.lit(1))
    runs = turns.withColumn("__new", changed).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col("text").alias("t")))), lambda x: x["t"]), "\n")
    return runs.groupBy(key, "run").agg(F.first("role").alias("role"), text.alias("text"), F.count("*").alias("n_turns"))


def exchanges(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each user turn with the assistant's turns up to the next user turn, joined by spaces."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    said = turns.where("role in ('user', 'assistant')").withColumn("exchange", F.count_if(F.col("role") == "user").over(w)).where("exchange > 0")
    answer = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct(F.col(order).alias("i"), F.col("text").alias("t"))))), lambda x: x["t"]), " ")
    return said.groupBy(key, "exchange").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("question"), answer.alias("answer"))


def exchange_chunks(of: DataFrame, key: str = "conv_id", size: int = CHUNK, least: int = 30) -> DataFrame:
    """Question and answer as one text, split every *size* characters; parts of *least* characters or fewer go."""
    text = F.concat(F.lit("> "), F.col("question"), F.lit("\n"), F.col("answer"))
    parts = of.withColumn("__t", text).select(key, "exchange", "__t", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("__t") / size) - 1, F.lit(0)).cast("int"))).alias("part"))
    chunk = F.substring("__t", F.col("part") * size + 1, F.lit(size))
    return parts.select(key, "exchange", "part", chunk.alias("chunk")).where(F.length("chunk") > least)


def paragraphs(docs: DataFrame, key: str = "id", text: str = "document", least: int = 30, group: int = 25) -> DataFrame:
    """Blocks between blank lines; a text of one block with more than 20 line ends is cut every *group* lines."""
    blocks = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: strip(x)), lambda x: F.length(x) > 0)
    lines = F.split(text, "\n")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / group).cast("int")), lambda i: strip(F.array_join(F.slice(lines, i * group + 1, group), "\n")))
    long_one = (F.size(blocks) <= 1) & (F.size(lines) > 21)
    rows = docs.select(key, F.posexplode(F.when(long_one, groups).otherwise(blocks)).alias("position", "chunk"))
    return rows.where(F.length("chunk") > least)


def windows(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Where windows of *size* characters begin and end; each begins *overlap* before the end of the one before.

    A window but the last ends at the last blank line of its second half, else at the last line end there, else full.
    The places of both are gathered once, and each end is a binary search among them.
    """
    if 2 * overlap >= size:
        raise ValueError("windows must be more than twice their overlap")
    lines = [m.start() for m in re.finditer("\n", text)]
    blanks = [a for a, b in zip(lines, lines[1:]) if b == a + 1]

    def last(places: list[int], after: int, before: int) -> int | None:
        i = bisect_left(places, before) - 1
        return places[i] if i >= 0 and places[i] > after else None

    start = 0
    while len(text) - start > size:
        middle, limit = start + size // 2, start + size
        # A blank line is two characters, both within the window.
        ends = (last(blanks, middle, limit - 1), last(lines, middle, limit), limit)
        end = next(e for e in ends if e is not None)
        yield start, end
        start = end - overlap
    yield start, len(text)


def fixed_chunks(docs: DataFrame, key: str = "id", text: str = "document", size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, chunk_index, chunk): trimmed windows of the trimmed text, those of fewer than *least* characters left out.

    Each window depends on the one before, so this runs in Arrow batches of whole texts.
    """
    strip_ascii = lambda x: x.strip(" \t\n\v\f\r")
    own = [key, *keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own)

    def mapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for *kept, t in frame.itertuples(index=False, name=None):
                t = strip_ascii(t or "")
                pieces = [p for p in (strip_ascii(t[a:b]) for a, b in windows(t, size, overlap)) if len(p) >= least]
                rows += [(*kept, i, p) for i, p in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=[*own, "chunk_index", "chunk"])

    return docs.select(*own, text).mapInPandas(mapped, f"{kinds}, chunk_index int, chunk string")


def sessions(lines: DataFrame, header: str, key: str = "source_file", order: str = "line_no", text: str = "line", restored: str | None = None, within: int = 6) -> DataFrame:
    """Numbers the sessions of files: each line that matches *header* begins one.

    Unless a line that matches *restored* stands there or among the next ones, *within* lines in all: then an old
    session is only shown again.
    """
    w = Window.partitionBy(key).orderBy(order)
    begins = F.rlike(text, F.lit(header))
    if restored is not None:
        begins = begins & (F.max(F.rlike(text, F.lit(restored)).cast("int")).over(w.rowsBetween(0, within - 1)) == 0)
    rows = lines.withColumn("__b", begins)
    return rows.withColumn("session", F.count_if("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


#: Fixed value: what refusals say.
REFUSALS = [
    r"\bI can'?t\b",
    r"\bI cannot\b",
    r"\bI'?m not able\b",
    r"\bI am not able\b",
    r"\bI'?m unable\b",
    r"\bI apologize,? but\b",
    r"\bI'?m sorry,? but I (?:can'?t|cannot|won'?t)\b",
    r"\bI (?:must|have to) (?:decline|refuse)\b",
    r"\b(?:request|action) (?:was )?(?:refused|denied)\b",
    r"\bI won'?t (?:be able to|help with)\b",
]
SNIPPET = 500


def refusals(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, matched, snippet) of conversations whose last assistant text refuses; the snippet ends between words."""
    last = turns.where("role = 'assistant' and text <> ''").groupBy(key).agg(F.max_by("text", order).alias("t"))
    matched = F.array_compact(F.array(*[F.when(F.rlike("t", F.lit("(?i)" + p)), F.lit(p)) for p in REFUSALS]))
    snippet = F.when(F.length("t") > SNIPPET, F.concat(F.regexp_replace(F.substring("t", 1, SNIPPET), r" [^ ]*$", ""), F.lit(" ..."))).otherwise(F.col("t"))
    return last.select(key, matched.alias("matched"), snippet.alias("snippet")).where(F.size("matched") > 0)


#: The time line of a session and the shell commands that aren't its subject.
STAMP = r"⏺\s+(\d{1,2}:\d{2}\s+[AP]M)\s+\w+,\s+(\w+)\s+(\d{1,2}),\s+(\d{4})"
COMMANDS = r"^(\./|cd |ls |python|bash|git |cat |source |export |./activate)"
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
SHORTEST_SESSION = 10


def session_names(lines: DataFrame, people: list[str], key: str = "source_file", order: str = "line_no", text: str = "line") -> DataFrame:
    """(key, session, n_lines, name) of sessions of ten lines or more, from rows that sessions() has numbered.

    A name holds the file's stem, the time told in the first 50 lines (else the session's number), up to three of the
    known people met in the first 100, and the first prompt that is no shell command. One aggregation, no lists.
    """
    w = Window.partitionBy(key, "session").orderBy(order)
    rows = lines.where("session > 0").withColumn("__i", F.row_number().over(w))
    x = F.col(text)
    first = lambda value, cond: F.min_by(F.when(cond, value), F.when(cond, F.col("__i")))
    prompt = strip(F.expr(f"substring({text}, 3)"))
    asked = F.startswith(x, F.lit("> ")) & (F.length(prompt) > 5) & ~F.rlike(prompt, F.lit(COMMANDS))
    met = [F.max(F.when((F.col("__i") <= 100) & F.rlike(x, F.lit(rf"(?i)\b{p}\b")), F.lit(p))).alias(f"__p{i}") for i, p in enumerate(sorted(people))]
    of = rows.groupBy(key, "session").agg(F.count("*").alias("n_lines"), first(x, F.rlike(x, F.lit(STAMP)) & (F.col("__i") <= 50)).alias("__s"), first(prompt, asked).alias("__a"), *met)
    part = lambda i: F.regexp_extract("__s", STAMP, i)
    month = F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), part(2)).cast("string"), 2, "0")
    stamp = F.concat(part(4), F.lit("-"), month, F.lit("-"), F.lpad(part(3), 2, "0"), F.lit("_"), F.regexp_replace(part(1), r"[:\s]", ""))
    when = F.coalesce(stamp, F.concat(F.lit("part"), F.lpad(F.col("session").cast("string"), 2, "0")))
    who = F.slice(F.array_compact(F.array(*[F.col(f"__p{i}") for i in range(len(met))])), 1, 3) if met else F.array().cast("array<string>")
    persons = F.when(F.size(who) > 0, F.array_join(who, "-")).otherwise("unknown")
    subject = F.coalesce(F.substring(F.regexp_replace(strip(F.regexp_replace("__a", r"(?U)[^\w\s-]", "")), r"\s+", "-"), 1, 60), F.lit("session"))
    stem = F.substring(F.regexp_replace(F.regexp_replace(F.element_at(F.split(F.col(key).cast("string"), "/"), -1), r"(?<=.)\.[^.]*$", ""), r"(?U)[^\w-]", "_"), 1, 40)
    name = F.concat(stem, F.lit("__"), when, F.lit("_"), persons, F.lit("_"), subject, F.lit(".txt"))
    clean = F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w.\-]", "_"), "_+", "_")
    return of.where(F.col("n_lines") >= SHORTEST_SESSION).select(key, "session", "n_lines", clean.alias("name"))


def write_sessions(lines: DataFrame, names: DataFrame, path: str, key: str = "source_file", order: str = "line_no", text: str = "line") -> None:
    """Writes the lines of each session that has a name (key, session, name) as text files below ``<path>/name=<name>``, in order.

    Lines come from rows that sessions() has numbered. A session is one file; a rerun replaces what is there.
    """
    kept = lines.join(names.select(key, "session", "name"), [key, "session"])
    kept.repartition("name").sortWithinPartitions("name", key, "session", order).select("name", F.col(text).alias("value")).write.mode("overwrite").partitionBy("name").text(path)
