"""What a signal needs is looked for as plain text before its pattern is tried."""

from memlake.operators import entities
from memlake.operators.entities import needed


def test_what_templates_need():
    assert [needed(t) for t in entities.DIRECT + entities.CODE + entities.VERSIONED] == [["hey", "thank", "hi"], ["."], None]
    assert needed(r"\b{name}-core\b") == ["-core"] and needed(r"^\[{name}\]") == ["["] and needed(r"\bship(?:ping|ped)?\s+{name}\b") == ["ship"]
    assert [needed(t) for t in (r"a|b?", r"{name}(?:a(b|c))zz", r"\p{L}foo", r"fo{2}", r"abc|", r"(?xi) a b", r"\Qa\E")] == [None] * 7
    assert needed(r"x\(a|b\)y") == ["x(a", "b)y"] and needed(r"f.*oo+k[a|b]c?") == ["oo"]


def test_letters_that_patterns_take_for_others_are_still_met(spark):
    rows = [(1, "Anna ſaİd so"), (2, "THANKS Anna"), (3, "hı Anna"), (4, "Anna sat")]
    docs = spark.createDataFrame(rows, "id long, document string")
    found = entities.signals(docs, spark.createDataFrame([("Anna",)], "word string"))
    row = found.first()
    assert (row.action, row.addressed) == (3, 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "__low" in plan
