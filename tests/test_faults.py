"""Faults of names and contents are found with work that grows with the text."""

from memlake.functions import checks
from memlake.plans import catalogue
from pyspark.sql import functions as F


def test_a_content_is_checked_once_and_not_for_each_of_its_pieces(spark):
    plan = catalogue.QUERIES["faults"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "Generate posexplode" in line)
    assert not any("text#" in line for line in plan[:at])
    assert any("too long" in line for line in plan[at + 1 :])


def test_blank_and_trimmed_values(spark):
    rows = [(1, None), (2, " \t\n"), (3, " a b \n"), (4, " " + "x" * 128 + " "), (5, "x" * 129), (6, " a/b"), (7, " "), (8, "a\0b")]
    df = spark.createDataFrame(rows, "i int, v string")
    told = df.select("i", checks.name_fault(F.col("v")).alias("n"), checks.value_fault(F.col("v")).alias("f"), checks.content_fault(F.col("v")).alias("c")).collect()
    assert {r.i: (r.n, r.f, r.c) for r in told} == {
        1: ("empty",) * 3, 2: ("empty",) * 3, 3: (None,) * 3, 4: (None,) * 3, 5: ("too long", "too long", None), 6: ("path characters", None, None),
        7: ("characters", None, None), 8: ("null bytes",) * 3,
    }
