"""Rooms of a project told by its folders or its files' names."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of folders by the room they stand for.
FOLDERS = {
    "frontend": ["frontend", "front-end", "front_end", "client", "ui", "views", "components", "pages"],
    "backend": ["backend", "back-end", "back_end", "server", "api", "routes", "services", "controllers", "models", "database", "db"],
    "documentation": ["docs", "doc", "documentation", "wiki", "readme", "notes"],
    "design": ["design", "designs", "mockups", "wireframes", "assets", "storyboard"],
    "costs": ["costs", "cost", "budget", "finance", "financial", "pricing", "invoices", "accounting"],
    "meetings": ["meetings", "meeting", "calls", "meeting_notes", "standup", "minutes"],
    "team": ["team", "staff", "hr", "hiring", "employees", "people"],
    "research": ["research", "references", "reading", "papers"],
    "planning": ["planning", "roadmap", "strategy", "specs", "requirements"],
    "testing": ["tests", "test", "testing", "qa"],
    "scripts": ["scripts", "tools", "utils"],
    "configuration": ["config", "configs", "settings", "infrastructure", "infra", "deploy"],
}
KEYWORDS = {k: room for room, words in FOLDERS.items() for k in words}
#: Folders that tell nothing.
SKIPPED = (".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", "coverage")
MOST_ROOMS = 6


def _map():
    return F.create_map(*[F.lit(x) for pair in KEYWORDS.items() for x in pair])


def from_folders(paths: DataFrame) -> DataFrame:
    """(room, folder) of relative paths: known names of first and second folders, other first ones under their own name.

    Where several folders tell a room, first ones come before second ones, then the alphabet decides. "general" is always there.
    """
    parts = paths.select(F.split("path", "/").alias("p")).where(F.size("p") > 1)
    one = parts.select(F.lit(1).alias("level"), F.element_at("p", 1).alias("folder")).where(~F.col("folder").isin(*SKIPPED))
    two = parts.where((F.size("p") > 2) & ~F.element_at("p", 1).isin(*SKIPPED)).select(F.lit(2).alias("level"), F.get("p", F.lit(1)).alias("folder")).where(~F.col("folder").isin(*SKIPPED))
    named = one.union(two).distinct().withColumn("known", F.element_at(_map(), F.regexp_replace(F.lower("folder"), "-", "_")))
    own = F.when((F.col("level") == 1) & F.rlike("folder", F.lit(r"^\p{L}..")), F.regexp_replace(F.lower("folder"), "[- ]", "_"))
    rooms = named.select(F.coalesce("known", own).alias("room"), "level", "folder").where("room is not null").groupBy("room").agg(F.min_by("folder", F.struct("level", "folder")).alias("folder"))
    general = paths.sparkSession.createDataFrame([("general", "")], "room string, folder string")
    return rooms.unionByName(general.join(rooms, "room", "left_anti"))


def from_names(paths: DataFrame) -> DataFrame:
    """(room, n): rooms whose keywords lie in file names at least twice, the six most frequent; else "general" alone."""
    name = F.regexp_replace(F.lower(F.element_at(F.split("path", "/"), -1)), "[- ]", "_")
    met = paths.select(name.alias("name")).select(F.explode(F.array_compact(F.array(*[F.when(F.contains("name", F.lit(k)), F.lit(r)) for k, r in KEYWORDS.items()]))).alias("room"))
    rooms = met.groupBy("room").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.col("n").desc(), "room").limit(MOST_ROOMS)
    general = paths.sparkSession.createDataFrame([("general", 0)], "room string, n long")
    return rooms.unionByName(general.join(rooms.limit(1).select(F.lit(1).alias("x")), F.lit(True), "left_anti"))


def project_config(spark: SparkSession, folder: str, names: tuple[str, ...] = ("rooms.yaml", "rooms.yml")) -> dict:
    """A project's wing and rooms (name, description, keywords): those of the first of the YAML files that is there, which
    ``ingest.room_of`` takes; without one the folder's name and one general room. What a file lacks is filled in; a file
    that isn't a mapping is an error.
    """
    general = {"name": "general", "description": "All project files", "keywords": ["general"]}
    wing = folder.rstrip("/").rsplit("/", 1)[-1]
    for name in names:
        try:
            text = spark.read.text(f"{folder.rstrip('/')}/{name}", wholetext=True).first()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        import yaml  # asked for only where a project has such a file

        told = yaml.safe_load(text["value"] if text else "") or {}
        if not isinstance(told, dict):
            raise ValueError(f"{name} of {folder} is no mapping")
        rooms = [r if isinstance(r, dict) else {"name": str(r)} for r in told.get("rooms") or []]
        rooms = [{"name": str(r["name"]), "description": str(r.get("description", "")), "keywords": [str(k) for k in r.get("keywords") or []]} for r in rooms if r.get("name")]
        return {"wing": str(told.get("wing") or wing), "rooms": rooms or [general]}
    return {"wing": wing, "rooms": [general]}
