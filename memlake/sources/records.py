"""A data source of records: files of any store that Arrow knows, read by Spark in batches or as a stream.

    spark.dataSource.register(RecordSource)
    spark.read.format("memlake_records").option("path", folder).option("adapter", "lines").load()

An adapter says how a file becomes records (source_file, document); ``text`` takes a file as one, ``lines`` each line that
is a JSON object with a ``document`` and, if it has one, a ``source_file``. Records are cut into windows as mined files
are. Rows are (source_file, chunk_index, document, mtime). Files are dealt to tasks by bytes; a task holds one file at a
time. As a stream the files are taken in the order of (time of modification, path), and an offset is the last of them, so
a restarted stream goes on behind it. A file counts once it is *settle* seconds old, so that one that turns up late with
an earlier time isn't passed over; what takes longer to turn up isn't seen.
"""

from __future__ import annotations

import io
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.transcript import CHUNK, LEAST, OVERLAP, windows

SCHEMA = "source_file string, chunk_index int, document string, mtime double"
#: Bytes of files that one task reads; a larger file is a task of its own.
TASK_BYTES = 64 << 20
_WHITE = " \t\n\v\f\r"


def _text(path: str, data: bytes) -> Iterator[tuple[str, str]]:
    yield path, data.decode("utf-8", "replace")


def _lines(path: str, data: bytes | io.BufferedIOBase) -> Iterator[tuple[str, str]]:
    for line in io.BytesIO(data) if isinstance(data, bytes) else data:
        try:
            record = json.loads(line.decode("utf-8", "replace"))
        except ValueError:
            continue
        if isinstance(record, dict) and isinstance(record.get("document"), str):
            yield str(record.get("source_file", path)), record["document"]


#: How a file becomes records, by name. A subclass of RecordSource in a module of its own may add to it.
ADAPTERS: dict[str, Callable[[str, bytes], Iterator[tuple[str, str]]]] = {"text": _text, "lines": _lines}
#: Adapters that read an open file piece by piece, so that a file of any size passes a task's memory by lines.
STREAMED = (_lines,)


def store_of(path: str):
    """The Arrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, float]]):
        self.files = files


class _Reader:
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("adapter", "text")
        self.parse = ADAPTERS.get(self.kind)
        if self.parse is None:
            raise LookupError(f"no adapter {self.kind}; there are {sorted(ADAPTERS)}")
        self.suffix = options.get("suffix", "")
        self.settle = float(options.get("settle", "2"))

    def listed(self) -> list[tuple[str, int, int]]:
        """(path, bytes, modification in ns) of the files, without those whose name or folder below begins with _ or a dot."""
        from pyarrow import fs

        store, base = store_of(self.path)
        found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        hidden = lambda p: any(x[:1] in "_." for x in p[len(base) :].strip("/").split("/"))
        return sorted((f.path, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and not hidden(f.path) and f.path.endswith(self.suffix))

    def dealt(self, files: list[tuple[str, int, int]]) -> list[Files]:
        out, room = [], 0
        for path, size, mtime in files:
            if not out or room + size > TASK_BYTES:
                out.append(Files([]))
                room = 0
            out[-1].files.append((path, size, mtime / 1e9))
            room += size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = store_of(self.path)
        for path, _, mtime in partition.files:
            with store.open_input_stream(path) as f:
                data = io.BufferedReader(f, 1 << 20) if self.parse in STREAMED else f.read()
                for source, document in self.parse(path, data):
                    text = document.strip(_WHITE)
                    pieces = (text[a:b].strip(_WHITE) for a, b in windows(text, CHUNK, OVERLAP))
                    for i, piece in enumerate(p for p in pieces if len(p) >= LEAST):
                        yield source, i, piece, mtime


class BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.dealt(self.listed()) or [Files([])]


class StreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"mtime": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((m, p) for p, _, m in self.listed() if m <= (time.time() - self.settle) * 1e9), default=(-1, ""))
        return {"mtime": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((o["mtime"], o["path"]) for o in (start, end))
        return self.dealt([f for f in self.listed() if low < (f[2], f[0]) <= high])

    def commit(self, end: dict) -> None:
        """Nothing to let go: files stay where they are."""


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "memlake_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))
