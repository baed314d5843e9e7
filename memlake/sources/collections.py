"""Named collections below one root folder, and adapters that fill them."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import checked_name
from ..operators.ingest import latest, with_provenance
from .stores import _at, exists, read_if_there


def _folder(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{checked_name(name, 'collection')}"


def _told(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/_embedders/{checked_name(name, 'collection')}"


def create(spark: SparkSession, root: str, name: str, schema: str, embedder: str | None = None) -> DataFrame:
    """A new empty collection, or the one that is there; *embedder* names what makes its vectors, and is kept."""
    if not exists(spark, _folder(root, name)):
        if embedder is not None:  # told first, so that no collection is without it
            spark.createDataFrame([(embedder,)], "embedder string").coalesce(1).write.mode("overwrite").parquet(_told(root, name))
        spark.createDataFrame([], schema).write.parquet(_folder(root, name))
    return get(spark, root, name, embedder)


def get(spark: SparkSession, root: str, name: str, embedder: str | None = None) -> DataFrame:
    """The collection; vectors of another embedder than the one that was told can't be compared, so asking with it fails."""
    if not exists(spark, _folder(root, name)):
        raise LookupError(f"no collection {name}")
    told = read_if_there(spark, _told(root, name)) if embedder is not None else None
    if told is not None and (own := told.first()["embedder"]) != embedder:
        raise ValueError(f"collection {name} holds vectors of {own}, not of {embedder}")
    return spark.read.parquet(_folder(root, name))


def delete(spark: SparkSession, root: str, name: str) -> bool:
    """Whether there was one."""
    store, told = _at(spark, _told(root, name))
    store.delete(told, True)
    store, p = _at(spark, _folder(root, name))
    return store.delete(p, True)


def listed(spark: SparkSession, root: str) -> list[str]:
    store, p = _at(spark, root)
    return sorted(f.getPath().getName() for f in store.listStatus(p) if f.isDirectory() and not f.getPath().getName().startswith("_")) if store.exists(p) else []


class Adapter(ABC):
    """A kind of source. Subclasses with a name are known by it."""

    name: str = ""
    version: str = "1"
    known: dict[str, type[Adapter]] = {}

    def __init_subclass__(cls, **more):
        super().__init_subclass__(**more)
        if cls.name:
            Adapter.known[checked_name(cls.name, "adapter")] = cls

    @abstractmethod
    def files(self, spark: SparkSession) -> DataFrame:
        """(source_file, mtime, ...) of all that could be read."""

    @abstractmethod
    def records(self, files: DataFrame) -> DataFrame:
        """(source_file, chunk_index, document, ...) of some of them."""

    def stale(self, files: DataFrame, state: DataFrame) -> DataFrame:
        """The files that the state (source_file, mtime, adapter_version) doesn't know as they are."""
        current = state.where(F.col("adapter_version") == self.version).select("source_file", "mtime")
        return files.join(current, ["source_file", "mtime"], "left_anti")

    def drawers(self, spark: SparkSession, state: DataFrame | None = None) -> DataFrame:
        """Stamped records of the stale files, one for each id."""
        files = self.files(spark)
        return latest(with_provenance(self.records(files if state is None else self.stale(files, state)), self.name, self.version))


def adapter(name: str) -> type[Adapter]:
    if name not in Adapter.known:
        raise LookupError(f"no adapter {name}; there are {sorted(Adapter.known)}")
    return Adapter.known[name]


def known_entities(spark: SparkSession, path: str) -> DataFrame:
    """(category, name) of a JSON object whose categories hold lists of names or objects by name."""
    by_category = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("category", "v"))
    names = F.coalesce(F.from_json("v", "array<string>"), F.map_keys(F.from_json("v", "map<string,string>")))
    listed_ = F.when(F.startswith(F.ltrim("v"), F.lit("[")), F.from_json("v", "array<string>")).otherwise(names)
    return by_category.select("category", F.explode(listed_).alias("name")).where("name <> ''").distinct()
