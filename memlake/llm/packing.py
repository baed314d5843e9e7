"""Mixture-controlled packing into sequences (operator 8).

Documents become token ids (plus an end mark), cut into packets of at most LENGTH tokens, which queue up by source.
Windows of about WINDOW tokens are filled by deficit round-robin: in each window a source earns its target share, and
sends packets while what it has earned reaches them; what is left over or short is its deficit, carried to the next
window. Sources begin with deficits of their own (a hash of the name), so that small ones do not all come at once.

What a source s has earned when all have earned T is its target p(s) times T, so its packet that begins after b of its
tokens goes at T = (b + u(s) n) / p(s): this closed form is the deficit counter, and any partition can place its packets
alone, knowing where its part of each queue begins. With an emptied queue the others share its place: the tokens sent up
to T are F(T), the sum over sources of min(S(s), p(s) T), and the packet's window is F(T) / WINDOW.

Targets are shares of the tokens of each window for some sources; the others share the rest by their own tokens. Without
targets every source has its own share of the corpus. There may be any number of sources.

The windows' tokens lie one after another and are cut every LENGTH tokens; the rest is cut into lengths that are powers
of two, so nothing is padded. Running sums give the places: over packets within a block of BLOCK windows, over blocks
within a group of GROUP blocks, and over groups (one for about 70 billion tokens) on the driver. Token ids are written
once and go with their packets in the shuffle by block; a block's size depends neither on sources nor on documents. The
beginnings of the queues' parts, one for each (partition, source), are broadcast only if counted to be at most
BROADCAST_ROWS; else they are joined by shuffle.

Null texts count as empty: one token, the end mark. The input's other columns may have any names. A source of null has a queue. Repeated rows, with an id of null too,
are packed each. An empty table gives no rows. The order within a queue follows the input's partitions, so sequence ids
depend on how the input is split into files; all else in this docstring does not.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import cut, drop, slices

LENGTH = 1024
WINDOW = 16 * LENGTH
END = 0
BLOCK = 64
GROUP = 1 << 16
BROADCAST_ROWS = 100_000
#: Bytes of ids that a partition of the shuffle by block holds, about.
PART_BYTES = 64 << 20


class Tokens:
    """Ids as the tokenizers library gives them for a byte-level file, by a faster library with the file's ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_characters())}
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if spec["normalizer"] is not None or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("a tokenizer file of another kind")
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        # Fixed value: the split pattern of byte-level pre-tokenizers.
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.kind = np.uint16 if max([*ranks.values(), *self.specials.values()]) < 1 << 16 else np.uint32
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.specials)
        self.path = path

    @functools.cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if any(s in text for s in self.specials):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=self.kind)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.kind)
        except BaseException as e:  # its matcher gives up on some very long runs; the panic is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=self.kind)


@functools.lru_cache(2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def queued(docs: DataFrame, path: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, part, source, before, start, n, doc_tokens, ids): packets and their places in their partition's part of the queue."""
    chosen = docs.select(F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("__source"), F.col(text_col).alias("__text"))
    id_type = chosen.schema["__id"].dataType.simpleString()
    names = ["id", "part", "source", "before", "start", "n", "doc_tokens", "ids"]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, passed = TaskContext.get().partitionId(), tokens(path), {}
        for batch in batches:
            for few in slices(batch, 2):
                index, sources, rows, ids = [], [], [], []
                for i, (source, text) in enumerate(zip(few.column(1).to_pylist(), few.column(2).to_pylist())):
                    own = np.append(encode(text), encode.kind(END))
                    data, width, begin = own.astype(own.dtype.newbyteorder("<")).tobytes(), own.itemsize, passed.get(source, 0)
                    for start in range(0, len(own), LENGTH):
                        n = min(LENGTH, len(own) - start)
                        index.append(i)
                        sources.append(source)
                        rows.append((begin + start, start, n, len(own)))
                        ids.append(data[width * start : width * (start + n)])
                    passed[source] = begin + len(own)
                before, start, n, total = (pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4))
                arrays = [few.column(0).take(pa.array(index, pa.int64())), pa.array([part] * len(ids), pa.int32()), pa.array(sources, pa.string()), before, start, n, total, pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return chosen.mapInArrow(mapped, f"id {id_type}, part int, source string, before long, start long, n long, doc_tokens long, ids binary")


class Earned:
    """F, and what share a source earns. *named* are tokens and targets of the sources with targets, *rest* the others' tokens."""

    def __init__(self, named: dict[str | None, tuple[int, float]], rest: int):
        asked = sum(p for _, p in named.values())
        if any(p <= 0 for _, p in named.values()) or asked > 1 + 1e-9 or (rest and asked > 1 - 1e-9):
            raise ValueError("targets must be above 0 and leave a share for the sources without one")
        self.rest, self.left = rest, 1 - asked
        self.queues = [(float(s), p) for s, p in named.values()] + ([(float(rest), self.left)] if rest else [])

    def sent(self, t):
        """F as a column of T."""
        return sum((F.least(F.lit(s), F.lit(p) * t) for s, p in self.queues), F.lit(0.0))


def _cuts(total: int) -> list[int]:
    """Where the sequences after the full ones begin and end: powers of two, largest first."""
    out = [total - total % LENGTH]
    for bit in range(LENGTH.bit_length() - 1, -1, -1):
        if total % LENGTH >> bit & 1:
            out.append(out[-1] + (1 << bit))
    return out


def pieces_of(at: int, n: int, cuts: list[int]) -> list[tuple[int, int, int, int]]:
    """The tokens at .. at + n of the whole as (start in them, length, sequence, offset)."""
    out, done = [], 0
    while done < n:
        if at < cuts[0]:
            sequence, offset, room = at // LENGTH, at % LENGTH, LENGTH - at % LENGTH
        else:
            k = int(np.searchsorted(cuts, at, side="right"))
            sequence, offset, room = cuts[0] // LENGTH + k - 1, at - cuts[k - 1], cuts[k] - at
        take = min(room, n - done)
        out.append((done, take, sequence, offset))
        at, done = at + take, done + take
    return out


def windows(held: DataFrame, targets: dict[str | None, float] | None = None) -> DataFrame:
    """The packets with the window that each goes to."""
    parts = cut(held.groupBy("part", "source").agg(F.sum("n").alias("n")))
    sums = cut(parts.groupBy("source").agg(F.sum("n").alias("total")))
    known = F.lit(False)
    for name in targets or ():
        known = known | F.col("source").eqNullSafe(F.lit(name).cast("string"))
    named = {r["source"]: (r["total"], float(targets[r["source"]])) for r in sums.where(known).collect()} if targets else {}
    earned = Earned(named, sums.where(~known).agg(F.sum("total")).first()[0] or 0)
    share = F.col("total") * F.lit(earned.left / max(1, earned.rest))
    for name, (_, p) in named.items():
        share = F.when(F.col("source").eqNullSafe(F.lit(name).cast("string")), F.lit(p)).otherwise(share)
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    begins = parts.select("part", "source", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("begin"))
    same = F.col("s").eqNullSafe(F.col("source"))
    begins = cut(begins.join(sums.select(F.col("source").alias("s"), "total"), same).select(F.col("part").alias("p"), F.col("source").alias("s"), "begin", share.alias("share"), first.alias("first")))
    few = F.broadcast(begins) if begins.count() <= BROADCAST_ROWS else begins
    placed = held.join(few, (F.col("part") == F.col("p")) & same).drop("p", "s")
    t = (F.col("begin") + F.col("before") + F.col("first") * F.col("n")) / F.col("share")
    drop(parts, sums)
    return placed.withColumn("window", F.floor(earned.sent(t) / WINDOW).cast("long")).drop("begin", "share", "first")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: dict[str | None, float] | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id and offset; *targets* are shares by source."""
    held = cut(queued(docs, path, id_col, text_col, source_col))
    placed = windows(held, targets).withColumn("block", F.expr(f"window div {BLOCK}"))
    blocks = cut(placed.groupBy("block").agg(F.sum("n").alias("n")).withColumn("group", F.expr(f"block div {GROUP}")))
    sums = sorted((r["group"], r["n"]) for r in blocks.groupBy("group").agg(F.sum("n").alias("n")).collect())
    total, bases = 0, []
    for group, n in sums:
        bases.append((group, total))
        total += n
    before = Window.partitionBy("group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = F.element_at(F.create_map(*[F.lit(x) for pair in bases for x in pair]), F.col("group")) if bases else F.lit(0)
    begins = cut(blocks.select("block", (base + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("base")))
    drop(blocks)
    kind = np.dtype(tokens(path).kind).newbyteorder("<")
    width = kind.itemsize
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if total * width > partitions * PART_BYTES:  # more partitions where the set ones would grow too large
        placed = placed.repartition(total * width // PART_BYTES + 1, "block")
    running = F.sum("n").over(Window.partitionBy("block").orderBy("window", "source", "part", "before").rowsBetween(Window.unboundedPreceding, -1))
    laid = placed.select("id", "block", F.coalesce(running, F.lit(0)).alias("within"), "start", "n", "doc_tokens", "ids")
    few = F.broadcast(begins) if begins.count() <= BROADCAST_ROWS else begins
    laid = laid.join(few, "block").select("id", (F.col("base") + F.col("within")).alias("at"), "start", "n", "doc_tokens", "ids")
    id_type, cuts = docs.schema[id_col].dataType.simpleString(), _cuts(total)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, rows = [], []
            for i, (at, begin, n, size, ids) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 6)))):
                data = memoryview(np.frombuffer(ids, dtype=kind).astype("<u4").tobytes())
                for start, length, sequence, offset in pieces_of(at, n, cuts):
                    index.append(i)
                    rows.append((begin + start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), size, sequence, offset))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), *columns], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return laid.mapInArrow(pieces, f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
