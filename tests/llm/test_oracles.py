"""The queries of this subpackage that have SQL against DuckDB."""

import duckdb
import pytest

pytest.importorskip("public_tokenizers")
DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op6_vectors", "op12_turns", "op9_minhash", "pii_base", "secret_base", "licence_base", "media_base"])
def test_oracle(spark, name):
    from memlake.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    out = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in out.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want
