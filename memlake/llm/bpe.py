"""Byte-pair encoding and decoding in batched numpy merge rounds (operator 7).

The tokenizer is read from its JSON file: Unicode form, lower case and white space as its normaliser has them, its split
pattern, bytes as characters, and merges by rank. Words that a worker has not met yet are encoded together: their symbols
stand in one flat array; in each round every word merges its lowest-ranked pair, all its places at once; ranks are found
by binary search over the sorted pair keys, anew only beside a merge. Words without pairs left drop out.

Decoding joins the token strings with a space, as the file names no decoder.
Null counts as empty: no tokens, empty decoded text. Texts are read whole. Strings of special tokens in a text become
their ids. Repeated rows give repeated results. An empty table gives no rows. The input's other columns may have any names. A round merges one pair kind of a word, so
the time of a single word grows faster than its letters: 80,000 of them take about a second, 320,000 about six.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_texts

#: Words kept by a worker; then it starts afresh.
CACHE = 400_000


@functools.lru_cache(1)
def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.marks = {s[0] for s in self.specials}
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(steps[0]["pattern"]["Regex"])
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or spec["decoder"] is not None:
            raise ValueError("a tokenizer file of another kind")
        self.tokens = {i: t.encode() for t, i in [*self.vocab.items(), *self.specials.items()]}
        characters = byte_characters()
        self.plain = np.array([self.vocab[c] for c in characters])
        self.final = np.array([self.vocab[c + self.suffix] for c in characters])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = len(self.vocab) + 1
        keys = np.array([self.vocab[a] * self.size + self.vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.none = np.int32(len(pairs))
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words (none of them empty), one after another, and where each word's end."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(sizes)
        symbol = self.plain[raw]
        symbol[ends - 1] = self.final[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbol), self.none, dtype=np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(word)))
            live = np.repeat(lowest < self.none, sizes)
            if not live.all():
                done.append((word[~live], symbol[~live]))
                symbol, word, rank, lowest, sizes = symbol[live], word[live], rank[live], lowest[lowest < self.none], sizes[lowest < self.none]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, sizes))
            if len(hit) > 1:  # of overlapping places of one pair every second counts, from the left
                fresh = np.concatenate([[True], np.diff(hit) > 1])
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbol), dtype=bool)
            keep[hit + 1] = False
            at = np.cumsum(keep)[hit] - 1
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            touched = np.zeros(len(symbol), dtype=bool)
            touched[at] = True
            touched[at[at > 0] - 1] = True
            beside = np.flatnonzero(touched)
            rank[beside] = self.none
            inner = beside[beside < len(symbol) - 1]
            inner = inner[word[inner] == word[inner + 1]]
            rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
        every, ids = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        return ids[np.argsort(every, kind="stable")], np.cumsum(np.bincount(every, minlength=len(words)))

    def learn(self, words: list[str]) -> None:
        """Encodes words that are new and keeps their ids and token strings, as bytes."""
        ids, ends = self.merge([w.encode("utf-8", "surrogatepass") for w in words])
        data, spelt = ids.astype("<u4").tobytes(), list(map(self.tokens.__getitem__, ids.tolist()))
        a = 0
        for w, b in zip(words, ends.tolist()):
            self.known[w] = data[4 * a : 4 * b], b" ".join(spelt[a:b])
            a = b

    def pieces(self, text: str) -> list[str]:
        """The words of a text; a special token is a word of its own."""
        if not any(mark in text for mark in self.marks):
            return self._words(text)
        out = []
        for part in self.special.split(text):
            if part in self.specials:
                self.known[part] = np.array([self.specials[part]], dtype="<u4").tobytes(), part.encode()
                out.append(part)
            else:
                out += self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.split.findall(text.lower())

    def __call__(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids as little-endian 32-bit integers and the decoded text in UTF-8, for each text."""
        if len(self.known) > CACHE:
            self.known.clear()
        words = [self.pieces(t or "") for t in texts]
        new = list({w for own in words for w in own} - self.known.keys())
        if new:
            self.learn(new)
        known, out = self.known, []
        for own in words:
            both = [known[w] for w in own]
            ids, spelt = zip(*both) if both else ((), ())
            out.append((b"".join(ids), b" ".join(spelt)))
        return out


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_values: bool = False) -> DataFrame:
    """One row per document: number of tokens and digests of ids and decoded text; with the values if asked for."""

    def encoded(texts: list[str | None]) -> list:
        both = encoder(path)(texts)
        out: list = [[len(i) // 4 for i, _ in both], [hashlib.sha256(i).hexdigest() for i, _ in both], [hashlib.sha256(d).hexdigest() for _, d in both]]
        return out + ([[np.frombuffer(i, dtype="<u4").tolist() for i, _ in both], [d.decode("utf-8", "replace") for _, d in both]] if with_values else [])

    fields = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")] + ([("ids", "array<long>"), ("decoded", "string")] if with_values else [])
    return map_texts(docs, [id_col], text_col, encoded, fields)
