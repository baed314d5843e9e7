"""Ignore files of project folders: rules as rows, joined to the paths below their folder.

Paths are relative to the project, with "/" between parts. A rule sees only entries below the folder that holds its file.
The last rule that matches an entry decides on it, deeper files after shallower ones; what lies in an ignored folder is
ignored whatever later rules say, as a walk never enters it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, strip


def _glob(part: Column) -> Column:
    """A pattern's part as a regular expression; stars and question marks stay within one part of a path."""
    x = F.regexp_replace(part, r"([\\.+^$(){}|])", r"\\$1")
    x = F.regexp_replace(x, r"\[(?![^\]]+\])", r"\\[")
    x = F.replace(x, F.lit("[!"), F.lit("[^"))
    x = F.regexp_replace(x, r"\*(?![^\[\]]*\])", "[^/]*")
    return F.regexp_replace(x, r"\?(?![^\[\]]*\])", "[^/]")


def _pattern(body: Column, anchored: Column) -> Column:
    """Matches a path with a "/" at its end, at any of its leading folders too."""
    parts = F.split(body, "/")
    fixed = anchored | (F.size(parts) > 1)
    each = F.transform(parts, lambda p: F.when(fixed & (p == "**"), F.lit("(?:[^/]+/)*")).otherwise(F.concat(_glob(p), F.lit("/"))))
    return F.concat(F.when(fixed, F.lit("^")).otherwise(F.lit("(?:^|/)")), F.array_join(each, ""))


def rules(files: DataFrame) -> DataFrame:
    """(base, line_no, negated, dir_only, pattern) of ignore files (base folder, "" at the top; content)."""
    lines = files.select("base", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("line_no", "raw")).withColumn("raw", strip(F.col("raw")))
    escaped = F.rlike("raw", F.lit(r"^\\[#!]"))
    kept = lines.where((F.col("raw") != "") & ~F.startswith("raw", F.lit("#")))
    kept = kept.withColumn("raw", F.when(escaped, F.expr("substring(raw, 2)")).otherwise(F.col("raw")))
    kept = kept.withColumn("negated", F.startswith("raw", F.lit("!"))).withColumn("raw", F.regexp_replace("raw", "^!", ""))
    kept = kept.withColumn("anchored", F.startswith("raw", F.lit("/"))).withColumn("raw", F.regexp_replace("raw", "^/+", ""))
    kept = kept.withColumn("dir_only", F.endswith("raw", F.lit("/"))).withColumn("raw", F.regexp_replace("raw", "/+$", ""))
    return kept.where("raw <> ''").select("base", "line_no", "negated", "dir_only", _pattern(F.col("raw"), F.col("anchored")).alias("pattern"))


def _folders(path: Column) -> Column:
    """Every folder above a path, the top ("") first."""
    return let(F.split(path, "/"), lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.array_join(F.slice(p, 1, i), "/")))


def force_included(path: Column, include: list[str]) -> Column:
    """Whether a path was asked for, lies below one that was, or leads to one."""
    out = F.lit(False)
    for one in (x.strip().strip("/") for x in include):
        if one:
            out = out | (path == one) | F.startswith(path, F.lit(one + "/")) | F.startswith(F.lit(one), F.concat(path, F.lit("/")))
    return out


def ignored(paths: DataFrame, of: DataFrame, include: list[str] | None = None) -> DataFrame:
    """The distinct paths that the rules drop. Empty rules drop none; paths asked for stay, and so do the folders to them.

    Paths are exploded to the entries on their way and these to the folders above, so that rules are joined by equality.
    """
    entry = paths.select("path").distinct().select("path", F.explode(F.array_append(F.slice(_folders(F.col("path")), 2, 1 << 20), F.col("path"))).alias("entry"))
    entry = entry.withColumn("is_dir", F.col("entry") != F.col("path")).where(~force_included(F.col("entry"), include or []))
    met = entry.select("*", F.explode(_folders(F.col("entry"))).alias("base")).join(of, "base")
    below = F.when(F.col("base") == "", F.col("entry")).otherwise(F.expr("substring(entry, length(base) + 2)"))
    whole = F.concat(below, F.lit("/"))
    target = F.when(F.col("dir_only") & ~F.col("is_dir"), F.regexp_replace(below, "[^/]*$", "")).otherwise(whole)
    hits = met.where(F.rlike(target, F.col("pattern")))
    last = hits.groupBy("path", "entry").agg(F.max_by("negated", F.struct(F.length("base"), "line_no")).alias("negated"))
    return last.where("not negated").select("path").distinct()
