"""Operator 11 against the sentencepiece library."""

import hashlib
import random

import pytest

from memlake.llm import sentencepieces

sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")

PARTS = ["a", "e", "the", "in", " ", "  ", "▁", "\n", "\t", "é", "中", "\x00", "😀", "ß", "1", ".", " " * 17, "ing", "<0x41>", "</s>", "\r", "　", " ", "ﬁ", "qzx" * 30]
TEXTS = [None, "", " ", "   ", "▁", "▁▁ a", "a", "x" * 300_000, "word " * 50_000, " 中" * 9_000, "<s> </s> <unk>"]


@pytest.fixture(scope="module")
def both():
    path = public.path("piece_bpe_32k.model")
    return sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.Pieces(path)


def test_texts_against_the_library(both):
    library, own = both
    r = random.Random(11)
    texts = TEXTS + ["".join(r.choice(PARTS) for _ in range(r.randrange(50))) for _ in range(5_000)]
    for t, (n, ids, decoded) in zip(texts, own(texts)):
        want = library.encode(t or "")
        assert (n, bytes(ids).decode(), bytes(decoded).decode()) == (len(want), ",".join(map(str, want)), library.decode(want)), repr(t)[:80]


def test_decoding_of_any_ids(both):
    library, own = both
    r = random.Random(12)
    for _ in range(5_000):
        ids = [r.choice([r.randrange(32_000), r.randrange(3, 259), r.randrange(3), 259, 28705, 264]) for _ in range(r.randrange(8))]
        assert own.decode(ids) == library.decode(ids), ids
    assert own.decode(None) is None


def test_a_table_that_starts_afresh_and_long_words_change_nothing(both, monkeypatch):
    _, own = both
    r = random.Random(13)
    texts = ["".join(r.choice(PARTS) for _ in range(30)) for _ in range(200)]
    want = [(n, bytes(i)) for n, i, _ in own(texts)]
    monkeypatch.setattr(sentencepieces, "CACHE_BYTES", 0)
    assert [(n, bytes(i)) for n, i, _ in own(texts)] == want
    monkeypatch.setattr(sentencepieces, "SHORT", 0)
    own.known.clear()
    assert [(n, bytes(i)) for n, i, _ in own(texts)] == want


def test_tables(spark, both):
    library, _ = both
    path = public.path("piece_bpe_32k.model")
    schema = "n_tokens long, doc_id long, text string, ids string, `odd name` int"
    rows = [(7, i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(7, 6, "a", "x", 1), (None, None, "no id", None, None)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    got = sentencepieces.encode(docs, path, with_values=True)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    back = sentencepieces.decode(got, path, into="again").collect()
    assert len(back) == len(rows)
    for r in back:
        want = library.encode(("no id" if r.doc_id is None else TEXTS[r.doc_id]) or "")
        assert r.ids == want and r.n_tokens == len(want) and r.again == r.decoded == library.decode(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert sentencepieces.encode(docs.limit(0), path).count() == 0


def test_query_over_whole_documents(spark, both):
    from memlake.llm import queries

    library, _ = both
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "")
        assert got[d.doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
