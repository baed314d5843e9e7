"""Facts about given entities: what was told before counts as seen, whether it holds or not."""

from memlake.operators import context, kg


def test_a_fact_that_was_closed_before_is_seen_already(spark):
    rows = [("u4", "view", "k1", "2024-01-01", "2024-01-02"), ("u4", "view", "k1", "2024-01-03", None), ("u4", "click", "k2", "2024-01-01", None), ("u6", "click", "k2", "2024-01-04", "2024-01-04"), ("u6", "click", "k2", "2024-01-04", None)]
    triples = spark.createDataFrame(rows, "subject string, predicate string, object string, valid_from string, valid_to string")
    entities = spark.createDataFrame([(x, x.upper()) for x in ("u4", "u6", "k1", "k2")], "id string, name string")
    told = lambda as_of: [(r.subject, r.predicate, r.object, r.valid_from) for r in context.facts(triples, entities, ["u4", "u6"], as_of=as_of).collect()]
    assert told(None) == [("u4", "click", "k2", "2024-01-01")]
    assert ("u4", "view", "k1", "2024-01-03") in told("2024-01-03")


def test_similar_names_are_looked_for_once_for_each_name_and_not_for_each_text(spark):
    mentioned = spark.createDataFrame([(1, "Anna"), (1, "Anna"), (2, "Anna"), (2, "Hanna"), (3, "Zoe"), (4, "Otto")], "id long, name string")
    registry = spark.createDataFrame([("Anna",), ("Hanna",), ("ANNA",), ("Ann",), ("Zoe",)], "name string")
    found = kg.confusable(mentioned, registry)
    told = sorted((r.id, r.mention, r.candidate, r.distance) for r in found.collect())
    assert told == [(1, "Anna", "Ann", 1), (1, "Anna", "Hanna", 1), (2, "Anna", "Ann", 1), (2, "Hanna", "ANNA", 1), (2, "Hanna", "Ann", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    below = [plan[i + 1] for i, line in enumerate(plan) if "Generate explode" in line]
    assert below and not any("id#" in line for line in below)  # keys are made of names alone
