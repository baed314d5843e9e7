"""SentencePiece encoding and decoding with a table of distinct chunks (operator 11).

The model file (BPE with byte fallback) is read through its library for its pieces and scores; segmentation is done here.
A text gets a marker (U+2581) in front, and its spaces become markers. As no piece holds a marker behind another
character (checked when the file is read), no piece crosses from a character to a marker: a text is cut there into marked
words, which merge independently of each other. The cuts of many texts are found at once in one array of bytes, the
marked words are dictionary-encoded by Arrow, each distinct one is segmented once by a worker, and ids, decoded bytes and
counts are taken back by position.

Within a word the adjacent pair whose joined piece has the best score merges first, the leftmost of equal ones. Words of
up to SHORT characters that a worker has not met yet are merged together in numpy rounds, one merge of each word a round;
longer ones by a heap over a linked list, so that a word of any length costs little more than its letters. A character
without a piece becomes its UTF-8 bytes.

Null and empty texts have no ids and decode to an empty text. Texts are read whole, of any length. A marker in a text is
a space from then on, as in the library. Repeated rows give repeated results. An empty table gives no rows. Columns are
taken by position, so other columns may have any names. A worker keeps words up to CACHE_BYTES of text and results, then
starts its table afresh; results don't depend on it.
"""

from __future__ import annotations

import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

MARK = "▁"
#: Bytes of words and results that a worker keeps; then it starts afresh.
CACHE_BYTES = 192 << 20
#: Characters up to which words are merged together in rounds.
SHORT = 48


class Pieces:
    """Pieces, scores and bytes of a model file; segments words and decodes ids."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        spelt = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        self.byte_ids, self.plain, self.spelt = {}, {}, []
        for i, p in enumerate(spelt):
            if lib.is_byte(i):
                value = int(p[1:-1], 16)
                self.byte_ids[value] = i
                self.spelt.append(bytes([value]))
            elif lib.is_control(i):
                self.spelt.append(b"")
            elif lib.is_unknown(i):
                self.spelt.append(" ⁇ ".encode())
            else:
                self.plain[p] = (lib.get_score(i), i)
                self.spelt.append(p.replace(MARK, " ").encode())
        self.is_byte = np.zeros(len(spelt), dtype=bool)
        self.is_byte[list(self.byte_ids.values())] = True
        whole = lib.encode("  a b ", out_type=str)
        if len(self.byte_ids) != 256 or any(lib.is_unused(i) for i in range(len(spelt))) or any(MARK in p.lstrip(MARK) for p in self.plain) or any(c not in self.plain for p in self.plain for c in p) or "".join(whole) != f"{MARK * 3}a{MARK}b{MARK}":
            raise ValueError("a model file of another kind")
        self.decimal, self.spelt_array = pa.array([b",%d" % i for i in range(len(spelt))], type=pa.large_binary()), pa.array(self.spelt, type=pa.large_binary())
        self._pair_table(len(spelt))
        self.known: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.held = 0

    def _pair_table(self, size: int) -> None:
        """Sorted keys of all pairs of pieces that make a piece, with its id and its rank by score; symbols of characters."""
        plain = self.plain
        rank = {s: k for k, s in enumerate(sorted({s for s, _ in plain.values()}, reverse=True))}
        pairs = [(plain[p[:k]][1], plain[p[k:]][1], i, rank[s]) for p, (s, i) in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
        left, right, made, ranks = (np.array(x, dtype=np.int64) for x in zip(*pairs))
        self.size = size + 0x110000  # a character without a piece is a symbol of its own, behind the pieces
        order = np.argsort(left * self.size + right)
        self.keys, self.made, self.ranks = (left * self.size + right)[order], made[order], ranks[order].astype(np.int32)
        self.none = np.int32(len(rank))
        self.symbols = np.arange(size, size + 0x110000)
        for p, (_, i) in plain.items():
            if len(p) == 1:
                self.symbols[ord(p)] = i
        self.vocabulary = size

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pairs (none where they make no piece) and the pieces they make."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none), self.made[at]

    def segment_together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (none of them empty), one after another, and how many each has."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbol = self.symbols[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        word = np.repeat(np.arange(len(words)), sizes)
        rank, made = np.full(len(symbol), self.none, dtype=np.int32), np.zeros(len(symbol), dtype=np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], made[inner] = self._pairs(symbol[inner], symbol[inner + 1])
        done = []
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest, sizes = np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word)))
            live = np.repeat(lowest < self.none, sizes)
            if not live.all():
                done.append((word[~live], symbol[~live]))
                symbol, word, rank, made, sizes, lowest = symbol[live], word[live], rank[live], made[live], sizes[lowest < self.none], lowest[lowest < self.none]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, sizes))
            hit = hit[np.concatenate([[True], np.diff(word[hit]) > 0])]  # the leftmost of each word
            symbol[hit] = made[hit]
            keep = np.ones(len(symbol), dtype=bool)
            keep[hit + 1] = False
            hit = hit - np.arange(len(hit))  # one symbol went from each word before
            symbol, word, rank, made = symbol[keep], word[keep], rank[keep], made[keep]
            beside = np.concatenate([hit, hit[hit > 0] - 1])
            rank[hit] = self.none
            beside = beside[beside < len(symbol) - 1]
            beside = beside[word[beside] == word[beside + 1]]
            rank[beside], made[beside] = self._pairs(symbol[beside], symbol[beside + 1])
        every, ids = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(every, kind="stable")
        every, ids = every[order], ids[order]
        odd = np.flatnonzero(ids >= self.vocabulary)
        if len(odd):
            spread = [[i] for i in ids.tolist()]
            for k in odd.tolist():
                spread[k] = [self.byte_ids[b] for b in chr(spread[k][0] - self.vocabulary).encode("utf-8", "surrogatepass")]
            every, ids = np.repeat(every, list(map(len, spread))), np.array([i for s in spread for i in s], dtype=np.int64)
        return ids, np.bincount(every, minlength=len(words))

    def segment(self, word: str) -> list[int]:
        """The ids of a marked word."""
        plain = self.plain
        parts: list[str | None] = list(word)
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, str]] = []
        for i in range(n - 1):
            joined = parts[i] + parts[i + 1]
            if joined in plain:
                heap.append((-plain[joined][0], i, joined))
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if parts[i] is None or after[i] >= n or parts[i] + parts[after[i]] != joined:
                continue
            gone = after[i]
            parts[i], parts[gone] = joined, None
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (wider := parts[a] + parts[b]) in plain:
                    heapq.heappush(heap, (-plain[wider][0], a, wider))
        out = []
        for p in parts:
            if p is None:
                continue
            if p in plain:
                out.append(plain[p][1])
            else:
                out += [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def look_up(self, words: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """(number of ids, ids in decimal with a comma before each, decoded bytes) of each distinct word."""
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            spelt = [w.decode().replace(" ", MARK) for w in new]
            long = [k for k, w in enumerate(spelt) if len(w) > SHORT]
            for k in long:
                ids = self.segment(spelt[k])
                self._keep([new[k]], np.array(ids), np.array([len(ids)]))
            short = [k for k, w in enumerate(spelt) if len(w) <= SHORT] if long else range(len(new))
            if short:
                self._keep([new[k] for k in short], *self.segment_together([spelt[k] for k in short]))
        return [known[w] for w in words]

    def _keep(self, words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        ends = np.append(0, np.cumsum(counts))
        parts = []
        for table in (self.decimal, self.spelt_array):
            taken = table.take(pa.array(ids))
            _, offsets, values = taken.buffers()
            parts.append((np.frombuffer(offsets, dtype=np.int64)[ends].tolist(), values.to_pybytes()))
        (a, decimal), (b, spelt) = parts
        for k, (w, n) in enumerate(zip(words, counts.tolist())):
            self.known[w] = n, decimal[a[k] : a[k + 1]], spelt[b[k] : b[k + 1]]
        self.held += len(decimal) + len(spelt) + sum(map(len, words)) + 300 * len(words)

    def __call__(self, texts: list[str | None]) -> list[tuple[int, memoryview, memoryview]]:
        """(number of ids, ids in decimal joined by commas, decoded text in UTF-8) of every text."""
        data = [b" " + t.replace(MARK, " ").encode() if t else b"" for t in texts]
        sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        starts = np.cumsum(sizes) - sizes
        raw = np.frombuffer(b"".join(data), dtype=np.uint8)
        if not len(raw):
            return [(0, memoryview(b""), memoryview(b""))] * len(texts)
        space = raw == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[starts[sizes > 0]] = True
        cuts = np.flatnonzero(first)
        bounds = np.append(cuts, len(raw)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        rows = self.look_up(words.dictionary.to_pylist())
        at = words.indices
        counts = np.append(0, np.cumsum(np.array([r[0] for r in rows], dtype=np.int64)[at.to_numpy(zero_copy_only=False)]))
        columns = []
        for k in (1, 2):
            taken = pa.array([r[k] for r in rows], type=pa.large_binary()).take(at)
            _, offsets, values = taken.buffers()
            columns.append((np.frombuffer(offsets, dtype=np.int64)[: len(taken) + 1], memoryview(values or b"")))
        (id_at, ids), (out_at, out) = columns
        a = np.searchsorted(cuts, starts)
        b = np.searchsorted(cuts, starts + sizes)
        # Without its first byte: the comma before the first id, and the marker that was put in front.
        return [(int(counts[j] - counts[i]), ids[id_at[i] + 1 : id_at[j]], out[out_at[i] + 1 : out_at[j]]) if j > i else (0, memoryview(b""), memoryview(b"")) for i, j in zip(a.tolist(), b.tolist())]

    def decode(self, ids: list[int] | None) -> str | None:
        """The text of ids: bytes that make no character become U+FFFD each; a marker that begins the text goes."""
        if ids is None:
            return None
        out, run, begun = [], b"", False
        for i in ids:
            if self.is_byte[i]:
                run += self.spelt[i]
                continue
            out.append(_characters(run))
            begun = begun or bool(run)
            run, piece = b"", self.spelt[i].decode()
            if not begun and i in self._marked:
                piece, begun = piece[1:], True
            begun = begun or bool(piece)
            out.append(piece)
        return "".join([*out, _characters(run)])

    @functools.cached_property
    def _marked(self) -> set[int]:
        return {i for p, (_, i) in self.plain.items() if p.startswith(MARK)}


def _characters(data: bytes) -> str:
    """The characters of a run of byte pieces; each byte that belongs to none is U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@functools.lru_cache(2)
def pieces(path: str) -> Pieces:
    """One table for each worker process and file."""
    return Pieces(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_values: bool = False) -> DataFrame:
    """One row per document: number of ids and digests of ids and decoded text; with the values if asked for."""

    def encoded(texts: list[str | None]) -> list:
        rows = pieces(path)(texts)
        out: list = [[n for n, _, _ in rows], [hashlib.sha256(i).hexdigest() for _, i, _ in rows], [hashlib.sha256(d).hexdigest() for _, _, d in rows]]
        return out + ([[list(map(int, bytes(i).split(b","))) if n else [] for n, i, _ in rows], [bytes(d).decode() for _, _, d in rows]] if with_values else [])

    fields = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")] + ([("ids", "array<long>"), ("decoded", "string")] if with_values else [])
    return map_texts(docs, [id_col], text_col, encoded, fields)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the text of their ids; null ids give a null text. Ids outside the vocabulary end the job."""
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())])
    at = rows.columns.index(ids_col)

    def mapped(batches):
        for batch in batches:
            texts = pa.array([pieces(path).decode(ids) for ids in batch.column(at).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, into])

    return rows.mapInArrow(mapped, schema)
