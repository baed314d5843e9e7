"""Inverted lists against a scan of all rows; pairs by tiles."""

import numpy as np
from pyspark.sql import functions as F

from memlake.operators import inverted, near_dup, search

SCHEMA = "label int, id long, embedding array<double>"


def odd_rows():
    return [(1, 9001, [0.0] * 8), (1, 9002, None), (1, 9003, [1.0, float("nan")] + [0.0] * 6), (1, 9004, [1.0, None] + [0.0] * 6), (1, 9005, [1.0, 0.0]), (1, 9006, [0.0, 1.0]), (1, None, [1.0] * 8), (1, 9007, [1e200] * 8), (1, 9008, [1e-200] * 8)]


def clustered(n, clusters, dims=8, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dims))
    v = centres[np.arange(n) % clusters] + 0.05 * r.normal(size=(n, dims))
    return [(i % clusters, i, x.tolist()) for i, x in enumerate(v)]


def both(spark, rows, tmp_path, k, lists=None, others=False, some="id % 7 = 0"):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    folder = str(tmp_path / f"lists{k}{others}")
    inverted.build(df, folder, lists=lists)
    index = inverted.load(spark, folder)
    asked = df.where(some).select(F.col("id").alias("qid"), "embedding")
    found, visited = inverted.knn(index, asked, k, others)
    rows_of = lambda x: sorted((r.qid, r["rank"], r.id, round(r.distance, 9)) for r in x.collect())
    assert rows_of(found) == rows_of(search.nearest(df, asked, k, others=others))
    return index, asked, visited


def test_clusters_are_skipped_and_results_stay_exact(spark, tmp_path):
    index, asked, visited = both(spark, clustered(1200, 24), tmp_path, 10, lists=24)
    share = visited.count() / (asked.count() * len(index.centres))
    assert share < 0.5 and sum(c[4] for c in index.centres) == 1200
    assert visited.count() == visited.distinct().count()


def test_ties_zeros_lengths_and_repeats(spark, tmp_path):
    r = np.random.default_rng(1)
    some = [(0, i, r.integers(-1, 2, 8).astype(float).tolist()) for i in range(300)]  # many equal directions
    rows = some + odd_rows() + [some[5], some[5]]
    both(spark, rows, tmp_path, 7, lists=9, some="id % 7 = 0 or id > 9000")
    both(spark, some + odd_rows(), tmp_path, 400, others=True, some="id % 50 = 0 or id > 9000")  # more than there are


def test_random_vectors_and_one_list(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(0, i, r.normal(size=8).tolist()) for i in range(200)]
    both(spark, rows, tmp_path, 3, lists=1)
    both(spark, rows, tmp_path, 5, others=True)


def test_a_question_is_sent_once_and_not_once_for_each_list(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(0, i, r.normal(size=8).tolist()) for i in range(900)]  # no clusters, so nearly all lists are read
    sent, plain = [], F.broadcast

    def spy(df):
        columns = [c for c, kind in df.dtypes if kind == "binary"]
        sent.append(sum(df.agg(F.sum(F.length(c))).first()[0] or 0 for c in columns))
        return plain(df)

    monkeypatch.setattr(inverted.F, "broadcast", spy)
    index, asked, visited = both(spark, rows, tmp_path, 10, lists=30, others=True)
    assert visited.count() > 20 * asked.count()
    assert 0 < max(sent) <= asked.count() * 8 * 8


def test_blocks_that_are_not_broadcast_and_equal_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "QUESTION_BYTES", -1)
    monkeypatch.setattr(inverted, "BLOCK_BYTES", 8 * 8 * 20)  # 20 questions
    r = np.random.default_rng(7)
    hot = r.normal(size=8).tolist()
    rows = [(0, i, hot if i % 2 else r.normal(size=8).tolist()) for i in range(400)] + [(0, 7, hot)] * 30 + odd_rows()
    both(spark, rows, tmp_path, 5, lists=12, others=True, some="id % 25 = 0 or id in (7, 11) or id > 9000")
    both(spark, rows, tmp_path, 40, lists=12, some="id % 25 = 0 or id = 11 or id > 9000")


def test_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    inverted.build(none, str(tmp_path / "lists"))
    found, visited = inverted.knn(inverted.load(spark, str(tmp_path / "lists")), none.select(F.col("id").alias("qid"), "embedding"), 3)
    assert found.count() == 0 and visited.count() == 0


def test_pairs_of_a_hot_label_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(search, "PAIR_BLOCK", 50)
    rows = clustered(260, 40, seed=5)
    rows = [(0 if i % 3 else label, i, v) for label, i, v in rows] + odd_rows() + [(None, 9100, [1.0] * 8)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.g, r.a, r.b) for r in search.near_pairs(df, 0.05).collect())
    good = [(g, i, np.array(v, dtype=float)) for g, i, v in rows if g is not None and i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: (g, v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())) for g, i, v in good}
    want = sorted((unit[a][0], a, b) for a in unit for b in unit if a < b and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and 1 - unit[a][1] @ unit[b][1] < 0.05)
    assert got == want and len(want) > 100
    plan = search.near_pairs(df, 0.05)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan


def test_centroids_of_odd_rows(spark):
    rows = clustered(60, 4) + [(1, 9001, [0.0] * 8), (2, 9002, None), (None, 9003, [1.0] * 8)]
    got = {r.id: (r.wing, r.similarity) for r in search.nearest_centroid(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 63 and got[9001] == (None, None) and got[9002] == (None, None)
    assert sum(got[i][0] == i % 4 for i in range(60)) == 60


def test_greedy_removal_of_many_rows(spark):
    rows = [("f", i, "x" * (100 - i % 60), v) for _, i, v in clustered(400, 37, seed=9)]
    df = spark.createDataFrame(rows, "source_file string, id long, document string, embedding array<double>")
    kept = []
    for _, i, t, v in sorted(rows, key=lambda r: (-len(r[2]), r[1])):
        u = np.array(v) / np.linalg.norm(v)
        if len(t) >= near_dup.SHORTEST and not any(1 - u @ w < near_dup.DISTANCE for _, w in kept):
            kept.append((i, u))
    assert sorted(r.id for r in near_dup.greedy(df).where("kept").collect()) == sorted(i for i, _ in kept)


def test_distances_by_batches(spark):
    from memlake.functions.vectors import cosine_distance, packed_distance

    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=6).tolist(), r.normal(size=6).tolist()) for i in range(50)] + [(60, [0.0] * 6, [1.0] * 6), (61, None, [1.0]), (62, [1.0, 2.0], [2.0, 4.0]), (63, [1.0], [1.0, 2.0]), (64, [1.0, None], [1.0, 2.0]), (65, [], [])]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>").repartition(3)
    got = {x.id: (x.p, x.c) for x in df.select("id", packed_distance(F.col("a"), F.col("b")).alias("p"), F.when(F.size("a") == F.size("b"), cosine_distance(F.col("a"), F.col("b"))).alias("c")).collect()}
    assert all(p is None for i, (p, _) in got.items() if i in (60, 61, 63, 64, 65)) and abs(got[62][0]) < 1e-12
    assert all(abs(p - c) < 1e-12 for i, (p, c) in got.items() if i < 50)
