"""Summaries are made within the row."""

from memlake.operators import summary


def test_a_summary_shuffles_neither_words_nor_texts(spark):
    rows = [(1, "Alpha beta alpha. Beta_x beta_x gamma iPhone the the the"), (2, None), (3, "zz the of"), (4, "one two three two Three ONE one-two")]
    df = spark.createDataFrame(rows, "id long, document string").repartition(2)
    made = summary.compress(df)
    assert made.columns == ["id", "document", "summary"]
    told = {r.id: r.summary.split("|")[1] for r in made.collect()}
    assert told == {1: "beta_x_alpha_iphone", 2: "misc", 3: "misc", 4: "one_three_one-two"}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not any(step in plan for step in ("Aggregate", "Join", "Window", "Generate"))
