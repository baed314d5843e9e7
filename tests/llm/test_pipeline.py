"""The pipeline against its stages done one by one in plain Python, and the entry point."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
DIR = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import corpus_pipeline
    from memlake.llm import secrets
    from tests.llm.test_operators import _check_packing, _components, _shingles

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    a = corpus_pipeline.identify_language(spark, docs, DIR)
    b = corpus_pipeline.filter_quality(spark, a, DIR)
    assert a.columns == b.columns == docs.columns and docs.count() >= a.count() >= b.count() > 0.5 * docs.count()
    held = b.collect()
    sets = [_shingles(r.text) for r in held]
    links = [(i, j) for i in range(len(held)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= corpus_pipeline.NEAR_PERCENT * len(sets[i] | sets[j])]
    order = sorted(range(len(held)), key=lambda i: held[i].doc_id)
    place = {i: k for k, i in enumerate(order)}
    reach = _components(len(held), [(place[i], place[j]) for i, j in links])
    want = {held[i].doc_id for k, i in enumerate(order) if reach[k] == k}
    c = corpus_pipeline.drop_near_duplicates(spark, b, DIR)
    assert {r.doc_id for r in c.collect()} == want
    d = {r.doc_id: r.text for r in corpus_pipeline.mask_secrets(spark, c, DIR).collect()}
    assert set(d) == want and not any(secrets.base_spans(t or "") for t in d.values())
    rows = corpus_pipeline.run(spark, DIR).collect()
    assert {r.doc_id for r in rows} == want
    _check_packing(rows, d)


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 12
    assert set(e.oracle_sql()) <= set(names)


def test_near_duplicates_from_080(spark):
    import corpus_pipeline
    from memlake.llm import minhash
    from tests.llm.test_operators import _shingles

    words = [f"w{i}" for i in range(104)]
    other = [*words[:92], *(f"x{i}" for i in range(12))]  # 88 of 112 shingles: 0.786
    near = [*words[:95], *(f"y{i}" for i in range(9))]  # 91 of 109: 0.835
    exact = [*words[:94], "z", *words[95:]]  # 95 of 105: 0.905
    rows = [(0, " ".join(words)), (1, " ".join(other)), (2, " ".join(near)), (3, " ".join(exact))]
    likeness = lambda i: len(_shingles(rows[0][1]) & _shingles(rows[i][1])) / len(_shingles(rows[0][1]) | _shingles(rows[i][1]))
    assert likeness(1) < 0.80 <= likeness(2) < 0.85 <= likeness(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in minhash.keep_first(df).collect()} == {0, 1, 2}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, DIR).collect()} == {0, 1}
    assert [minhash.band_rows(p) for p in (85, 80)] == [5, 4]


def test_odd_rows_pass_every_stage(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = [(100001, None, "en", "s", None), (100002, "", None, None, 0), (100003, " ²½ 12 !", "en", "s", 8), (None, "A text without an id, of some plain words that mean little.", "en", "s", 60), (100004, docs.first().text + " und" * 50_000, None, None, 1)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.where("doc_id < 5"))
    for name in ("key", "id", "n", "sig", "bands", "part", "score", "stats", "held_out", "comp", "bucket"):
        rows = rows.withColumn(name, F.lit("clash"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DIR}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    now = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == rows.columns and now.count() > 0, name
    kept = [r.doc_id for r in now.collect()]
    assert len(kept) == len(set(kept)) and not {100001, 100002, 100003} & set(kept)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(kept)


def test_empty_corpus(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{DIR}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    folder, ran = str(tmp_path / "run"), []

    def noted(name, stage, stop):
        def call(*args):
            ran.append(name)
            if name == stop:
                raise RuntimeError("lost")
            return stage(*args)

        return name, call

    stages = corpus_pipeline.STAGES
    monkeypatch.setattr(corpus_pipeline, "STAGES", [noted(n, f, "near_duplicates") for n, f in stages])
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, DIR, folder)
    assert sorted(p.name for p in (tmp_path / "run").iterdir()) == ["quality"]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [noted(n, f, None) for n, f in stages])
    rows = corpus_pipeline.run(spark, DIR, folder).collect()
    assert ran == ["language", "quality", "near_duplicates", "near_duplicates", "secrets", "packing"]
    assert sorted(p.name for p in (tmp_path / "run").iterdir()) == ["secrets"]
    assert len({r.doc_id for r in rows}) == len({r.doc_id for r in corpus_pipeline.run(spark, DIR).collect()})
