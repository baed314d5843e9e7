"""Project files, diaries, stores of key-value rows, and exports."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import short_hash, strip
from ..operators.collection import export_stats
from . import ignore

#: File types that are read, folders and files that are skipped, and the largest file in bytes.
EXTENSIONS = (".txt", ".md", ".py", ".js", ".ts", ".jsx", ".tsx", ".json", ".jsonl", ".yaml", ".yml", ".html", ".css", ".java", ".go", ".rs", ".rb", ".sh", ".csv", ".sql", ".toml")
SKIPPED = [
    ".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", "coverage", ".ruff_cache", ".mypy_cache",
    ".pytest_cache", ".cache", ".tox", ".nox", ".idea", ".vscode", ".ipynb_checkpoints", ".eggs", "htmlcov", "target",
]
SKIPPED_FILES = (".gitignore", "package-lock.json")
LARGEST = 500 * 1024 * 1024
LISTED = "path string, size long, mtime double"
#: Tasks that walk the folders of a project at most.
MOST_TASKS = 1000


#: Stores that the listing reads itself; the default is the local one.
DIRECT = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def _direct(path: str) -> bool:
    return "://" not in path or path.split("://")[0] in DIRECT


def _uri(path: str) -> str:
    return path if "://" in path else os.path.abspath(path)


def _below(spark: SparkSession, path: str) -> Column:
    """A file's path below the folder, as Spark names files."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/") + "/"
    return F.expr("substring(path, instr(path, :root) + length(:root))".replace(":root", "'" + root.replace("'", "\\'") + "'"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path relative to the folder, size, mtime) of every file below it, links aside.

    Spark's own file source leaves out names that begin with "_" or ".", such as ignore files, so the names are listed here.
    In a store that only Spark reads they are missing, and with them the ignore files.
    """
    if not _direct(path):
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        return rows.select(_below(spark, path).alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))
    uri = _uri(path)

    def level(store: fs.FileSystem, root: str, folder: str) -> tuple[list[tuple], list[str]]:
        """The files and the folders right in a folder, by their paths below the root."""
        local = isinstance(store, fs.LocalFileSystem)
        found = store.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/")))
        name = lambda f: f"{folder}/{f.base_name}".lstrip("/")
        files = [(name(f), f.size, f.mtime.timestamp()) for f in found if f.type == fs.FileType.File and not (local and os.path.islink(f.path))]
        return files, [name(f) for f in found if f.type == fs.FileType.Directory]

    def walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(uri)
        for frame in frames:
            open_ = list(frame.folder)
            while open_:
                files, more = level(store, root, open_.pop())
                open_ += more
                if files:
                    yield pd.DataFrame(files, columns=["path", "size", "mtime"])

    # The driver lists one level; each folder there is walked by a task, a folder at a time.
    files, folders = level(*fs.FileSystem.from_uri(uri), "")
    top = spark.createDataFrame(files, LISTED)
    if not folders:
        return top
    dealt = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(min(len(folders), MOST_TASKS), "folder")
    return top.unionByName(dealt.mapInPandas(walked, LISTED))


def _read(files: DataFrame, path: str) -> DataFrame:
    """Adds the content (UTF-8, invalid bytes replaced), read where the rows are, a file at a time."""
    uri = _uri(path)
    if not _direct(path):
        spark = files.sparkSession
        content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        return files.join(content.select(_below(spark, path).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content")), "path")

    def mapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(uri)
        for frame in frames:
            for i in range(len(frame)):
                one = frame.iloc[i : i + 1].copy()
                with store.open_input_stream(f"{root}/{one.path.iloc[0]}", compression=None) as f:
                    one["content"] = [f.read().decode("utf-8", "replace")]
                yield one

    return files.mapInPandas(mapped, LISTED + ", content string")


def project_files(spark: SparkSession, path: str, respect_ignore: bool = True, include: list[str] | None = None) -> DataFrame:
    """(source_file, mtime, content) of the readable files below a folder.

    Left out are other file types, skipped names and folders, files over 500 MB and what ignore files name; what
    *include* lists (files or folders, relative) comes back, whatever its type if it is the file itself.
    """
    files = listing(spark, path)
    asked = ignore.force_included(F.col("path"), include or [])
    kind = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    exact = F.col("path").isin(*[x.strip().strip("/") for x in include or []])
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    dull = F.exists(folders, lambda x: x.isin(*SKIPPED) | F.endswith(x, F.lit(".egg-info"))) | F.element_at(parts, -1).isin(*SKIPPED_FILES)
    kept = files.where((F.col("size") <= LARGEST) & (kind.isin(*EXTENSIONS) | exact) & (~dull | asked))
    if respect_ignore:
        named = files.where(F.element_at(parts, -1) == ".gitignore")
        base = F.regexp_replace("path", "/?[^/]*$", "")
        kept = kept.join(ignore.ignored(kept, ignore.rules(_read(named, path).select(base.alias("base"), "content")), include), "path", "left_anti")
    where = _uri(path).rstrip("/")
    return _read(kept, path).select(F.concat(F.lit(where + "/"), F.col("path")).alias("source_file"), "mtime", "content")


def diary_entries(files: DataFrame, wing: str) -> DataFrame:
    """Entries of diary files (yyyy-MM-dd*.md), split at second-level headings, with the day's fixed id."""
    day = F.regexp_extract("source_file", r"([0-9]{4}-[0-9]{2}-[0-9]{2})[^/]*\.md$", 1)
    dated = files.withColumn("date", day).where("date <> ''")
    entries = dated.select("source_file", "date", F.posexplode(F.split("content", r"(?m)^(?=## )")).alias("position", "entry"))
    kept = entries.withColumn("entry", strip(F.col("entry"))).where("entry <> ''")
    return kept.withColumn("id", F.concat(F.lit("drawer_diary_"), short_hash(24, F.lit(wing), F.col("date"))))


def pivot_store(rows: DataFrame) -> DataFrame:
    """(id, document, metadata) from entity-attribute-value rows (id, key, string_value, int_value, float_value, bool_value)."""
    value = F.coalesce("string_value", F.col("int_value").cast("string"), F.col("float_value").cast("string"), F.col("bool_value").cast("string"))
    document = F.max(F.when(F.col("key") == "chroma:document", F.col("string_value")))
    pairs = F.collect_list(F.when((F.col("key") != "chroma:document") & value.isNotNull(), F.struct("key", value.alias("value"))))
    return rows.groupBy("id").agg(document.alias("document"), F.map_from_entries(pairs).alias("metadata"))


def pivot_joined(ids: DataFrame, attributes: DataFrame) -> DataFrame:
    """(id, document, metadata) of a store that keeps its ids (id, embedding_id) apart; keys of the store's own are left out, and rows without a document."""
    named = attributes.join(ids.select(F.col("id").alias("__id"), "embedding_id"), F.col("id") == F.col("__id")).withColumn("id", F.col("embedding_id")).drop("__id", "embedding_id")
    kept = named.where("key = 'chroma:document' or key not like 'chroma:%'")
    return pivot_store(kept).where("document <> ''")


def _safe(name: Column) -> Column:
    return F.regexp_replace(name, r'[/\\:*?"<>|]', "_")


def export_markdown(drawers: DataFrame, path: str) -> None:
    """Quoted drawers with a table of their origin, as text files by wing and room."""
    quoted = F.array_join(F.transform(F.split(F.regexp_replace("document", "\n+$", ""), "\n"), lambda x: F.concat(F.lit("> "), x)), "\n")
    told = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown")) if c in drawers.columns else F.lit("unknown")
    rows = [F.concat(F.lit(f"| {name} | "), told(c), F.lit(" |\n")) for name, c in (("Source", "source_file"), ("Filed", "filed_at"), ("Added by", "added_by"))]
    value = F.concat(F.lit("## "), F.col("id").cast("string"), F.lit("\n\n"), quoted, F.lit("\n\n| Field | Value |\n|-------|-------|\n"), *rows, F.lit("\n---\n"))
    drawers.select(_safe(F.coalesce("wing", F.lit("unknown"))).alias("wing"), _safe(F.coalesce("room", F.lit("general"))).alias("room"), value.alias("value")).write.mode("overwrite").partitionBy("wing", "room").text(path)


def export_index(drawers: DataFrame, path: str, date: str) -> None:
    """A table of the wings with their numbers of rooms and drawers, as one text; there is a line for each wing."""
    line = F.concat(F.lit("| ["), "wing", F.lit("]("), _safe(F.col("wing")), F.lit("/) | "), F.col("rooms"), F.lit(" | "), F.col("drawers"), F.lit(" |"))
    lines = export_stats(drawers).groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("wing", line.alias("l")))), lambda x: x["l"]), "\n").alias("l"))
    head = f"# Export — {date}\n\n| Wing | Rooms | Drawers |\n|------|-------|---------|\n"
    lines.select(F.concat(F.lit(head), "l").alias("value")).write.mode("overwrite").text(path)


def audit_log(operations: DataFrame, path: str, hidden: tuple[str, ...] = ("content", "document", "query", "text")) -> None:
    """Appends operations (op, params map, result) as JSON lines; texts among the parameters show their length only."""
    params = F.transform_values("params", lambda k, v: F.when(k.isin(*hidden), F.concat(F.lit("<"), F.length(v).cast("string"), F.lit(" chars>"))).otherwise(v))
    operations.withColumn("params", params).write.mode("append").json(path)
