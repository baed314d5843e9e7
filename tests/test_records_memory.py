"""Files of records pass by lines."""

import json
import tracemalloc

from memlake.sources.records import BatchReader, Files


def _read(path):
    tracemalloc.start()
    n = sum(1 for _ in BatchReader({"path": path, "adapter": "lines"}).read(Files([(path, 0, 0.0)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return n, peak


def test_a_large_file_of_lines_takes_no_more_memory_than_a_small_one(tmp_path):
    found = []
    for n in (1000, 6000):
        path = tmp_path / f"{n}.jsonl"
        path.write_bytes(b"".join(json.dumps({"source_file": str(i), "document": "añb wörds " * 100}, ensure_ascii=False).encode() + b"\n" for i in range(n)) + b"broken\xff\n\n")
        found.append(_read(str(path)))
    assert found[1][0] == 6 * found[0][0] > 0
    assert found[1][1] < 2 * found[0][1] and found[1][1] < 4 << 20
