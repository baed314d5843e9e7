"""Few names go to the texts; many are joined by shuffles with the same result."""

from memlake.operators import names


def test_few_names_are_broadcast_and_many_give_the_same(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a b c d".split()), (2, ["a"]), (3, []), (4, "b c a b d".split())], "id long, w array<string>")
    known = spark.createDataFrame([("A", ["a"]), ("BC", ["b", "c"]), ("ABC", ["a", "b", "c"]), ("ABD", ["a", "b", "d"]), ("none", [])], "name string, f array<string>")
    few = names.known_names(texts, "w", "id", known, "f")
    want = [(1, "A"), (1, "ABC"), (1, "BC"), (2, "A"), (4, "A"), (4, "ABD"), (4, "BC")]
    assert sorted(map(tuple, few.collect())) == want
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(array_distinct") == 1 and "strategy=broadcast" in plan
    monkeypatch.setattr(names, "BROADCAST_NAMES", 0)
    many = names.known_names(texts, "w", "id", known, "f")
    assert "strategy=broadcast" not in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, many.collect())) == want
