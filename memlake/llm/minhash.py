"""Near-duplicate documents by MinHash bands and sequential Bayesian verification (operator 9).

A text's words (A-Z lower-cased) give its set of 5-word shingles. Texts with the same words are one class, stood for by
their smallest id. Each class has HASHES minima in bands of so many rows as the threshold t allows; classes that share a
band are candidates. A pair at the threshold shares no band with probability (1 - t ** rows) ** bands, below one in a
million: 24 bands of 5 at 0.85, the default, and 30 bands of 4 at 0.80.

Candidates are compared by batches of minima. After each batch the posterior of the similarity (uniform prior) given the
matches so far drops the pair once it reaches the threshold with a probability below MISS. Survivors are verified
exactly on their full sets.

1. Stars. In each bucket all classes meet one leader: the class that shares the most with others over all its buckets,
   so that a group of edits finds its original. Verified links make components, and the leader, which has met all, leaves
   the bucket. While a round links more than one in STAR_SHARE of the classes that are left in buckets of several
   components, another follows, led by the best class outside the bucket's largest component. A round is as many rows
   as there are classes in open buckets.
2. Tiles. Classes outside a bucket's largest component then meet all others of it; the largest component never meets
   itself. They are dealt to blocks of about BLOCK by a hash, so that one very large bucket is many tiles, which hold
   signatures only. A pair that shares several bands counts in the first of them alone. A tile names the classes with a
   surviving partner in another component; only the full sets of those are fetched, dealt to blocks of about SET_BYTES,
   and verified. A tile returns a star for each of its components.

So all candidate pairs are looked at but those whose ends are linked already, and pairs are never written out.
Empty and null texts (no words) have no shingles, link with nothing, and are kept. A text of fewer words than 5 is one
shingle. Repeated rows are copies of each other. An id of null is in no component but its own. Texts are taken whole, a
very long one alone. Of leaders that share equally much the smallest id leads. An empty table gives no rows; the input's
other columns may have any names. Of rows with one id and other texts, all are compared, and ``keep_first`` keeps each
text of a kept id once.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, map_texts, mix64, word_hashes
from .graph import components, smallest_reachable

SHINGLE = 5
#: The least similarity in hundredths, if none is given; compared in whole numbers.
PERCENT = 85
HASHES = 120
BATCH = 24
MISS = 1e-6
#: Another round of stars pays while it links at least one in so many of the classes in open buckets.
STAR_SHARE = 10
BLOCK = 1024
SET_BYTES = 8 << 20
#: Rows of a few numbers; the driver holds such a table several times while it is built and sent.
BROADCAST_ROWS = 100_000

_random = np.random.default_rng(9)
_A = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: list[str | None]) -> tuple[list[np.ndarray], list[bytes]]:
    """Of each text the hashed shingles in order (not yet distinct) and a digest of its words; none without words."""
    data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    starts, _, hashes = word_hashes(b" ".join(data), _WORD)
    ends = np.cumsum([len(d) + 1 for d in data])
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
    rolled = np.zeros(0, dtype=np.uint64)
    if len(hashes) >= SHINGLE:
        n = len(hashes) - SHINGLE + 1
        rolled = hashes[:n].copy()
        for k in range(1, SHINGLE):
            rolled = mix64(rolled * _STEP + hashes[k : k + n])
    sets, keys = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        own = hashes[a:b]
        keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
        if b - a >= SHINGLE:
            sets.append(rolled[a : b - SHINGLE + 1])
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in own:
                    whole = mix64(np.array([whole * _STEP + h], dtype=np.uint64))[0]
            sets.append(np.array([whole], dtype=np.uint64))
        else:
            sets.append(own)
    return sets, keys


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of each set (rows of sets without elements are unset)."""
    out = np.zeros((len(sets), HASHES), dtype=np.uint32)
    filled = [i for i, s in enumerate(sets) if len(s)]
    if filled:
        flat = np.concatenate([sets[i] for i in filled])
        flat = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
        at = np.cumsum([0] + [len(sets[i]) for i in filled[:-1]])
        for k in range(HASHES):
            v = flat * _A[k] + _B[k]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x85EBCA6B)
            v ^= v >> np.uint32(13)
            out[filled, k] = np.minimum.reduceat(v, at)
    return out


def band_rows(percent: int = PERCENT) -> int:
    """The most rows of a band at which a pair at the threshold is missed with a probability below MISS."""
    return max((r for r in range(1, HASHES + 1) if HASHES % r == 0 and (1 - (percent / 100) ** r) ** (HASHES // r) < MISS), default=1)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), HASHES // rows, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, HASHES // rows + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        h = mix64(h * _STEP + parts[:, :, k])
    return h.view(np.int64)


@functools.lru_cache(None)
def fewest_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """The fewest of n matches at which the similarity may still reach the threshold: posterior at least *miss*."""
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def survivors(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Of the index pairs into signatures a and b those that no batch drops, with their matches."""
    matches = np.zeros(len(i), dtype=np.int32)
    alive = np.arange(len(i))
    for k in range(HASHES // BATCH):
        part = slice(k * BATCH, (k + 1) * BATCH)
        for at in range(0, len(alive), 1 << 16):
            own = alive[at : at + (1 << 16)]
            matches[own] += (a[i[own], part] == b[j[own], part]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= fewest_matches((k + 1) * BATCH, percent)]
    return alive, matches[alive]


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted arrays of distinct elements are similar enough."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(x) + len(y) - both)


# --- the distributed part --------------------------------------------------------------------------------------------


def _sketches(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    rows = band_rows(percent)

    def made(texts: list[str | None]) -> list:
        sets, keys = shingles(texts)
        sizes = [len(np.unique(s)) for s in sets]
        signature = signatures(sets)
        bands = band_keys(signature, rows).tolist()
        return [keys, sizes, [b if n else [] for b, n in zip(bands, sizes)], [s.tobytes() if n else None for s, n in zip(signature, sizes)]]

    return map_texts(docs, [id_col], text_col, made, [("key", "binary"), ("n", "long"), ("bands", "array<long>"), ("sig", "binary")]).withColumnRenamed(id_col, "id")


def _few(table: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it is counted to be small enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of *df* whose id is among *ids* (a written table)."""
    return df.join(_few(ids), "id", "left_semi")


def _both(pairs: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b) with the columns of both ends. Hubs are at end a, which meets written tables on both sides."""
    left = values.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = values.select(F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return pairs.join(right, "b").join(left, "a")


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs that sequential verification keeps."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint32).reshape(-1, HASHES) for k in (2, 3))
                at = np.arange(batch.num_rows)
                alive, _ = survivors(x, y, at, at, percent)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).take(pa.array(alive))

    return _both(pairs, sketches, ["sig"]).select("a", "b", "a_sig", "b_sig").mapInArrow(kept, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, members): the sorted distinct hashed shingles of the texts with these ids."""
    chosen = _only(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ids)
    made = map_texts(chosen, ["id"], "text", lambda texts: [[np.unique(s).tobytes() for s in shingles(texts)[0]]], [("members", "binary")])
    repeated = chosen.groupBy("id").count().where("count > 1").limit(1).count()
    return made.distinct() if repeated else made


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_pylist() for k in (2, 3))
            good = [linked(np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64), percent) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return _both(pairs, sets, ["members"]).select("a", "b", "a_members", "b_members").mapInArrow(kept, "a long, b long")


def _links(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Of the pairs those that are similar enough on their full sets; signatures go first, sets only where they leave doubt."""
    likely = cut(_likely(pairs, sketches, percent))
    ends = cut(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = cut(_sets(docs, ends, id_col, text_col))
    links = cut(_verified(likely, sets, percent))
    drop(likely, ends, sets)
    return links


def _open(members: DataFrame, joined: DataFrame) -> DataFrame:
    """The classes of buckets that hold several components, with their own and the bucket's largest (main) component."""
    placed = members.join(joined, "id", "left").select("bucket", "id", "reach", F.coalesce("component", "id").alias("comp"))
    placed = cut(placed)
    main = F.max(F.struct("n", -F.col("comp")))
    kinds = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.count("*").alias("kinds"), (-main["col2"]).alias("main"))
    open_ = cut(kinds.where("kinds > 1").drop("kinds"))
    found = cut(placed.join(_few(open_), "bucket"))
    drop(placed, open_)
    return found


def _blocks(members: DataFrame, weight, room: int) -> DataFrame:
    """(bucket, outer, inner): blocks that weigh about *room* for what is outside the main component and for the main one.

    A bucket that fits into one block is one tile.
    """
    out = F.col("comp") != F.col("main")
    sizes = members.groupBy("bucket").agg(F.sum(F.when(out, weight).otherwise(0)).alias("w0"), F.sum(F.when(out, 0).otherwise(weight)).alias("w1"))
    fits = F.col("w0") + F.col("w1") <= room
    need = lambda w: F.ceil(F.col(w) / room).cast("int")
    return cut(sizes.select("bucket", F.when(fits, 1).otherwise(F.greatest(need("w0"), F.lit(1))).alias("outer"), F.when(fits, 0).otherwise(need("w1")).alias("inner")))


def _tiles(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (bucket, comp, main, ...) dealt to tiles (low, high) of blocks.

    Blocks from 0 to outer hold what is outside the main component and meet all blocks; the others hold the main
    component and meet only the outer ones.
    """
    # Members carry signatures or sets; where the blocks are broadcast, those aren't shuffled for them.
    placed = members.join(_few(blocks), "bucket")
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    outer, inner = F.col("outer"), F.col("inner")
    block = F.when((F.col("comp") != F.col("main")) | (inner == 0), deal(outer)).otherwise(outer + deal(F.greatest(inner, F.lit(1))))
    placed = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("block") < outer, outer + inner).otherwise(outer) - 1)))
    return placed.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "outer", "inner")


def _likely_in(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a tile's rows in different components that survive, and share no band before the tile's own."""
    comp, block = table.column("comp").to_numpy(), table.column("block").to_numpy()
    low, high, bucket = (table.column(c)[0].as_py() for c in ("low", "high", "bucket"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, HASHES)
    a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
    fewest, keys, found = fewest_matches(BATCH, percent), band_keys(sig, band_rows(percent)), []
    columns = np.ascontiguousarray(sig[b, :BATCH].T)
    for at in range(0, len(a), BLOCK):
        own = a[at : at + BLOCK]
        same = np.zeros((len(own), len(b)), dtype=np.uint8)
        for k in range(BATCH):
            same += sig[own, k][:, None] == columns[k][None, :]
        may = (same >= fewest) & (comp[own][:, None] != comp[b][None, :])
        if low == high:
            may &= own[:, None] > b[None, :]
        i, j = np.nonzero(may)
        alive, _ = survivors(sig, sig, own[i], b[j], percent)
        i, j = own[i[alive]], b[j[alive]]
        for part in range(0, len(i), 1 << 16):
            p, q = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            first = (keys[p] == keys[q]).argmax(axis=1)
            mine = keys[p, first] == bucket
            found.append((p[mine], q[mine]))
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate([none, *(f[k] for f in found)]) for k in (0, 1))


def _surviving(table: pa.Table, percent: int) -> pa.Table:
    """The rows of a tile that have a likely partner in another component."""
    i, j = _likely_in(table, percent)
    return table.select(["bucket", "id", "comp", "main", "n", "sig"]).take(pa.array(np.unique(np.concatenate([i, j]))))


def shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many elements the sets of each index pair share; by products of incidence matrices where pairs are many."""
    if len(i) <= 8 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())], dtype=np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = counts[column] > 1
    row, column = row[keep], (np.cumsum(counts > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    # Sums stay below 2 ** 24 for sets up to that size, so they are exact in float32; beyond, in float64.
    kind = np.float32 if max(map(len, sets)) < 1 << 24 else np.float64
    total = np.zeros((len(sets), len(sets)), dtype=kind)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 1024):
        p, q = np.searchsorted(column, [at, at + 1024])
        part = np.zeros((len(sets), 1024), dtype=kind)
        part[row[p:q], column[p:q] - at] = 1
        total += part @ part.T
    return total[i, j].astype(np.int64)


def _tile_links(table: pa.Table, percent: int) -> pa.Table:
    """A star for each component that the links of a tile make."""
    ids = table.column("id").to_numpy()
    sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("members").to_pylist()]
    i, j = _likely_in(table, percent)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    both = shared(sets, i, j)
    good = 100 * both >= percent * (sizes[i] + sizes[j] - both)
    root = smallest_reachable(len(ids), i[good], j[good])
    hit = np.flatnonzero(root != np.arange(len(ids)))
    return pa.table({"a": pa.array(ids[root[hit]], pa.int64()), "b": pa.array(ids[hit], pa.int64())})


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id and kept; *percent* is the least similarity."""
    every = cut(_sketches(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, percent))
    classes = cut(every.where("n > 0 and id is not null").groupBy("key").agg(F.min("id").alias("id")))
    stand = cut(every.join(classes, ["id", "key"], "left_semi").dropDuplicates(["id", "key"]).select("id", "n", "bands", "sig"))

    banded = stand.select("id", F.explode("bands").alias("bucket"))
    sizes = cut(banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    reach = F.sum("size").over(Window.partitionBy("id"))
    members = cut(banded.join(sizes, "bucket").select("bucket", "id", reach.alias("reach")))
    involved = cut(members.select("id").distinct())
    sketches = cut(_only(stand.select("id", "n", "sig"), involved))
    drop(sizes, stand, involved)

    joined = cut(members.select(F.col("id"), F.col("id").alias("component")).where("false"))
    left = cut(members.withColumn("comp", F.col("id")).withColumn("main", F.lit(None).cast("long")))
    while True:
        best = F.max(F.struct(F.coalesce(F.col("comp") != F.col("main"), F.lit(True)).alias("out"), "reach", (-F.col("id")).alias("low"), "comp")).alias("best")
        # Written first, so that the members of a hot bucket stay where they are, or are split as a skewed join.
        leaders = cut(left.groupBy("bucket").agg(best).select("bucket", (-F.col("best.low")).alias("leader"), F.col("best.comp").alias("leads")))
        met = cut(left.join(_few(leaders), "bucket").where("id != leader"))
        pairs = cut(met.where("comp != leads").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
        links = _links(pairs, sketches, docs, id_col, text_col, percent)
        before, joined = joined, cut(components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links), "a", "b"))
        old, left = left, _open(met, joined)
        fresh, size = links.count(), left.count()
        drop(leaders, met, pairs, links, old, before)
        if fresh * STAR_SHARE <= size or not size:
            break

    if size:
        rows = cut(left.join(sketches, "id"))
        tile, key = "bucket long, id long, comp long, main long, n long, sig binary", ["bucket", "low", "high"]
        blocks = _blocks(rows, F.lit(1), BLOCK)
        hits = _tiles(rows, blocks).groupBy(*key).applyInArrow(lambda t: _surviving(t, percent), tile)
        hits = cut(hits.dropDuplicates(["bucket", "id", "sig"]))
        drop(blocks)
        ends = cut(hits.select("id").distinct())
        sets = cut(_sets(docs, ends, id_col, text_col))
        full = hits.join(sets, "id").withColumn("weight", F.octet_length("members") + 4 * HASHES)
        blocks = _blocks(full, F.col("weight"), SET_BYTES)
        more = cut(_tiles(full, blocks).groupBy(*key).applyInArrow(lambda t: _tile_links(t, percent), "a long, b long"))
        joined = components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), "a", "b")
        drop(rows, hits, ends, sets, blocks, more)

    known = cut(classes.join(joined, "id", "left").select("key", F.coalesce("component", "id").alias("component")))
    drop(classes, members, sketches, left)
    out = every.select("id", "key", "n").join(known, "key", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each component, all columns as they came. Rows repeated with id and text stay once."""
    dropped = cut(near_documents(docs, id_col, text_col, percent).where("not kept").select(F.col(id_col).alias("id")).distinct())
    few = F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped
    kept = docs.join(few, docs[id_col] == few["id"], "left_anti")
    repeated = cut(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).count().where("count > 1").select("id"))
    n = repeated.count()
    if not n:
        return kept
    repeated = F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated
    once = kept.join(repeated, kept[id_col] == repeated["id"], "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(repeated, kept[id_col] == repeated["id"], "left_anti").unionByName(once)
