"""Interleaved document sequences with media columns (operator 2).

``parse_html`` turns a page into an ordered array of text and media-reference structs; a reference names its payload
by SHA-256 digest and keeps its position and caption. ``resolve`` joins references to stored payloads by digest.
``store_media`` writes payloads losslessly as 8-bit mono WAV samples into a binary column of a table in a folder that
driver and executors share; ``describe_media`` reads the table in tasks of its own, and takes all that is known of a
payload from the bytes that it reads. Equal payloads of one slice of rows are stored once.

The join is done on the descriptors (a digest and some numbers), not on the bytes. Digests that many documents name
(at least 1 / HOT_SHARE of all references, so at most HOT_SHARE of them) are broadcast; the rest are joined by shuffle.

Null texts count as empty; repeated texts share one descriptor; a page without media has only text structs;
a reference whose digest is unknown stays, with null payload columns. Rows repeat as often as they come; an empty table
gives no rows. A very long text is one payload, stored whole. The input's other columns may have any names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, delete, map_texts, shared_folder, slices

UNIT = 64
RATE = 8000
HOT_SHARE = 1024
SEGMENTS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
#: Elements whose text is not content, and elements that end a run of text.
HIDDEN = {"script", "style", "template", "noscript"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "section", "article", "br", "hr", "pre", "blockquote", "figure", "figcaption", "body", "title", "header", "footer", "nav"}


class _Sequence(HTMLParser):
    """Collects text runs and media references in document order; a figcaption goes to the media of its figure."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.figures: list[list[int]] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        run = " ".join("".join(self.text).split())
        self.text = []
        if run:
            self.out.append({"position": len(self.out), "kind": "text", "text": run, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS:
            self.flush()
        if tag == "figure":
            self.figures.append([])
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "audio", "video", "source", "embed"):
            named = dict(attrs)
            source = named.get("data-digest") or named.get("src") or ""
            self.flush()
            if self.figures:
                self.figures[-1].append(len(self.out))
            digest = source.removeprefix("sha256:") or None
            self.out.append({"position": len(self.out), "kind": "media", "text": None, "digest": digest, "caption": named.get("alt") or None})

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag == "figcaption" and self.caption is not None:
            words, self.caption = " ".join("".join(self.caption).split()), None
            for i in self.figures[-1] if self.figures else ():
                self.out[i]["caption"] = words or self.out[i]["caption"]
        if tag == "figure" and self.figures:
            self.figures.pop()
        if tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parse_html(page: str | None) -> list[dict]:
    """Ordered structs (position, kind, text, digest, caption) of one page."""
    parser = _Sequence()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.out


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: its ordered segments."""
    return map_texts(pages, [id_col], html_col, lambda many: [[parse_html(p) for p in many]], [("segments", SEGMENTS)])


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the text with bytes 0 up to a positive multiple of UNIT, and its unpadded length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(UNIT * max(1, -(-len(raw) // UNIT)) - len(raw)), len(raw)


def store(payload: bytes) -> bytes:
    """8-bit mono PCM in a RIFF container; every byte is one sample."""
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + bytes(pad)


def load(media: bytes) -> bytes:
    """Samples of a stored form, found by walking its chunks."""
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def describe(payload: bytes) -> str:
    """Mean, standard deviation, zero crossings about 128 and the energy of 8 equal spans, from the samples."""
    x = np.frombuffer(payload, dtype=np.uint8)
    high = x >= 128
    spans = x.astype(np.float32).reshape(8, -1).mean(axis=1)
    return f"{x.mean():.4f};{x.std():.4f};{int(np.count_nonzero(high[1:] != high[:-1]))};" + ",".join(f"{v:.2f}" for v in spans)


MEDIA = [("digest", "string"), ("n_bytes", "long"), ("media", "binary")]
DESCRIPTOR = [("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]
#: Bytes of a row group of the stored table; what a writing task holds.
ROW_GROUP = 16 << 20


def store_media(docs: DataFrame, folder: str, text_col: str = "text") -> DataFrame:
    """Writes the payloads of all texts to *folder* and returns the table as it is read there: digest, n_bytes, media.

    The digest covers the padded payload, the text's own length also counts, as texts may end in bytes 0.
    """

    def stored(texts: list[str | None]) -> list:
        rows = {}
        for payload, n in map(payload_of, set(texts)):
            rows[hashlib.sha256(payload).hexdigest(), n] = payload
        return [[[{"digest": digest, "n_bytes": n, "media": store(payload)} for (digest, n), payload in rows.items()]] + [None] * (len(texts) - 1)]

    made = map_texts(docs, [], text_col, stored, [("rows", "array<struct<digest:string,n_bytes:long,media:binary>>")])
    made = made.select(F.inline("rows"))
    made.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(folder)
    return docs.sparkSession.read.schema(made.schema).parquet(folder)


def _descriptor(media: bytes) -> tuple:
    back = load(media)
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), describe(back)


def describe_media(stored: DataFrame) -> DataFrame:
    """One row per distinct payload of a stored table: its key and what the stored bytes say."""
    kept = [f for f in MEDIA if f[0] != "media"]

    def read(batches):
        for batch in batches:
            for part in slices(batch, 2):
                rows = list(zip(*(_descriptor(m) for m in part.column(2).to_pylist())))
                types = [pa.string() if t == "string" else pa.int64() for _, t in DESCRIPTOR]
                columns = [part.column(0), part.column(1), *(pa.array(c, type=t) for c, t in zip(rows, types))]
                yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in kept + DESCRIPTOR])

    made = stored.select("digest", "n_bytes", "media").mapInArrow(read, ", ".join(f"{n} {t}" for n, t in kept + DESCRIPTOR))
    return made.dropDuplicates(["digest", "n_bytes"])


def pages_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A page per document: its whole text in paragraphs, the first followed by a figure of the text as media, with a caption.

    The media is named by digest and length.
    """

    def page(text: str | None) -> str:
        payload, n = payload_of(text)
        first, *more = [f"<p>{escape(line, quote=False)}</p>" for line in (text or "").split("\n") if line.strip()] or [""]
        figure = f'<figure><audio src="sha256:{hashlib.sha256(payload).hexdigest()}:{n}"></audio><figcaption>{n} bytes</figcaption></figure>'
        return f"<article>{first}{figure}{''.join(more)}</article>"

    return map_texts(docs, [id_col], text_col, lambda many: [[page(t) for t in many]], [("html", "string")])


def segments(parsed: DataFrame, id_col: str) -> DataFrame:
    """One row per segment: its page, position, kind, text, digest and caption."""
    return parsed.select(F.col(id_col), F.inline("segments"))


def references(parsed: DataFrame, id_col: str) -> DataFrame:
    """One row per media reference: its page, position, caption and key."""
    one = parsed.select(F.col(id_col), F.explode("segments").alias("s")).where("s.kind = 'media'")
    return one.select(id_col, F.col("s.position").alias("position"), F.col("s.caption").alias("caption"), F.col("s.digest").alias("key"))


def resolve(refs: DataFrame, payloads: DataFrame) -> DataFrame:
    """Left join by key. Hot keys go by broadcast; there are at most HOT_SHARE of them, by their definition."""
    total = refs.count()
    hot = refs.groupBy("key").count().where(F.col("count") >= max(2, -(-total // HOT_SHARE))).select("key")
    hot = cut(hot)
    known = payloads.join(F.broadcast(hot), "key", "left_semi")
    common = refs.join(F.broadcast(hot), "key", "left_semi").join(F.broadcast(known), "key", "left")
    rest = refs.join(F.broadcast(hot), "key", "left_anti").join(payloads.join(F.broadcast(hot), "key", "left_anti"), "key", "left")
    return common.unionByName(rest)


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's text as a stored payload, reached through its page: parse, reference, digest join.

    The stored table lies in the shared folder until its descriptors are written.
    """
    refs = cut(references(sequences(pages_of(docs, id_col, text_col), id_col, "html"), id_col))
    folder = f"{shared_folder(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    stored = store_media(docs, folder, text_col)
    payloads = cut(describe_media(stored).withColumn("key", F.concat_ws(":", "digest", F.col("n_bytes").cast("string"))))
    delete(docs.sparkSession, folder)
    return resolve(refs, payloads).select(id_col, "n_bytes", *[n for n, _ in DESCRIPTOR], "position", "caption")
