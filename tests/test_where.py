import pytest
from pyspark.sql import functions as F

from memlake.operators import collection
from memlake.operators.where import Metadata, UnsupportedFilter, compile_where, wing_room


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (1, "alpha beta", '{"a": "x", "n": 5, "t": true}'),
        (2, "Alpha", '{"a": null, "n": "7"}'),
        (3, "gamma", '{"n": "no", "t": "true", "d": "2024-01-15"}'),
        (4, "", "{}"),
    ]
    return spark.createDataFrame(data, "id long, document string, metadata string")


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ({"a": "x"}, [1]),
        ({"a": {"$ne": "x"}}, []),
        ({"a": None}, [2]),
        ({"a": {"$ne": None}}, [1]),
        ({"n": 5}, [1]),
        ({"n": {"$gt": 5}}, [2]),
        ({"n": {"$in": [5, 7]}}, [1, 2]),
        ({"n": {"$nin": [5]}}, [2]),
        ({"t": True}, [1]),
        ({"d": {"$gte": "2024-01", "$lt": "2024-02"}}, [3]),
        ({"$or": [{"a": "x"}, {"n": 7}]}, [1, 2]),
        ({"$and": [{"a": "x"}, {"n": {"$lte": 5}}]}, [1]),
    ],
)
def test_where(rows, where, want):
    assert ids(collection.get(rows, where=where)) == want


def test_document(rows):
    assert ids(collection.get(rows, where_document={"$contains": "lpha"})) == [1, 2]
    assert ids(collection.get(rows, where_document={"$and": [{"$contains": "lpha"}, {"$contains": "beta"}]})) == [1]


@pytest.mark.parametrize("where", [{"a": {"$regex": "x"}}, {"$not": []}, {"$and": []}, {"a": {}}, {"a": {"$in": []}}, {"a": {"$in": [None]}}, {"a": {"$gt": True}}, {"a'": 1}, {"a": {"$eq": [1]}}])
def test_unsupported_filters_raise(rows, where):
    with pytest.raises(UnsupportedFilter):
        compile_where(where, None, Metadata(json=F.lit("{}")), F.lit(""))


def test_wing_room():
    assert wing_room() == {} and wing_room("a") == {"wing": "a"} and wing_room("a", "b") == {"$and": [{"wing": "a"}, {"room": "b"}]}


def test_writes(spark, rows):
    new = spark.createDataFrame([(2, "new", "{}"), (9, "nine", "{}")], rows.schema)
    assert {(r.id, r.document) for r in collection.upsert(rows, new).collect()} == {(1, "alpha beta"), (2, "new"), (3, "gamma"), (4, ""), (9, "nine")}
    assert ids(collection.update(rows, new, ["document"])) == [1, 2, 3, 4, 9]
    assert ids(collection.add(rows, new.where("id = 9"))) == [1, 2, 3, 4, 9]
    with pytest.raises(Exception, match="duplicate id"):
        collection.add(rows, new).collect()
    assert ids(collection.delete(rows, where={"a": "x"})) == [2, 3, 4]
    assert ids(collection.delete(rows, ids=[1, 2])) == [3, 4]
    with pytest.raises(ValueError):
        collection.delete(rows)
    assert collection.include(rows, ("documents",)).columns == ["id", "document"]
