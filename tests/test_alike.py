"""Indexes are built in small batches, and questions of the same words are answered once for all of them."""

from pyspark.sql import functions as F

from memlake.operators import fulltext, lexical

TEXTS = [(i, f"alpha {'beta ' * (i % 5)}gamma{i % 3} delta" if i % 7 else None) for i in range(60)]


def _index(spark, tmp_path, kind):
    docs = spark.createDataFrame(TEXTS, "id long, document string").coalesce(1)
    kind.build(docs, str(tmp_path / kind.__name__))
    return lexical.load(spark, str(tmp_path / kind.__name__))


def test_batches_of_a_build_are_small(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "id long, document string").coalesce(1)
    for kind, name in ((lexical, "tf"), (fulltext, "positions")):
        order = ["id", "term"]
        whole = kind.postings(docs).orderBy(*order).collect()
        monkeypatch.setattr(kind, "PIECE", 5)
        assert kind.postings(docs).orderBy(*order).collect() == whole and len(whole) > 60


def test_questions_of_the_same_words_are_scored_once(spark, tmp_path):
    index = _index(spark, tmp_path, lexical)
    asked = spark.createDataFrame([(q, [["beta", "gamma1"], ["gamma1", "beta", "beta"], ["delta"], None, []][q % 5]) for q in range(40)], "qid long, terms array<string>")
    forms, same = lexical.alike(asked.select("qid", F.array_sort(F.array_distinct("terms")).alias("terms")).where("terms IS NOT NULL"), "terms")
    assert sorted(r.qid for r in forms.collect()) == [0, 2, 4] and same.count() == 32
    got = {}
    for r in lexical.search(index, asked, 4).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id, round(r.bm25, 9)))
    one = sorted((r["rank"], r.id, round(r.bm25, 9)) for r in lexical.search(index, asked.where("qid = 6"), 4).collect())
    assert sorted(got) == [q for q in range(40) if q % 5 < 3]
    assert all(sorted(v) == one for q, v in got.items() if q % 5 < 2) and len(one) == 4
    assert lexical.search(index, asked).where("qid = 7").count() == sum(1 for _, t in TEXTS if t)


def test_full_text_of_the_same_words_is_matched_once(spark, tmp_path):
    index = _index(spark, tmp_path, fulltext)
    asked = spark.createDataFrame([(q, ["beta gamma1", '"gamma1 delta"', "alpha -beta", None][q % 4]) for q in range(16)], "qid long, question string")
    rows = lambda df: sorted((r.qid % 4, r.id, r.covers, round(r.density, 9)) for r in df.collect())
    every, few = rows(fulltext.match(index, asked)), rows(fulltext.match(index, asked.where("qid < 4")))
    assert sorted(set(every)) == few and len(every) == 4 * len(few) and {q for q, *_ in few} == {0, 1, 2}
    found = fulltext.search(index, asked, 2)
    assert found.groupBy("qid").count().where("count <> 2").count() == 0 and found.count() == 24
    # What the questions meet is dealt once by text; nothing but that is shuffled for the pairs.
    plan = fulltext._matched(index, lexical.alike(asked, "question")[0], "id", None)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" not in plan.split("MapInArrow")[0] and "REPARTITION_BY_COL" in plan
