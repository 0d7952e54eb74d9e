import pytest
from pyspark.sql import functions as F

from logstrata.errors import InvalidVectorError, VectorDimensionError
from logstrata.functions import vectors as V
from logstrata.functions.predicates import parameters_column, where_column
from logstrata.operators import search


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_vector_arithmetic(spark):
    a, b = V.literal([1, 2, 3]), V.literal([4, 5, 6])
    assert one(spark, V.dot(a, b)) == 32
    assert one(spark, V.magnitude(V.literal([3, 4]))) == 5
    assert one(spark, V.euclidean(V.literal([0, 0]), V.literal([3, 4]))) == 5
    assert one(spark, V.cosine(V.literal([1, 0]), V.literal([0, 1]))) == 0
    assert one(spark, V.cosine(V.literal([2, 2]), V.literal([1, 1]))) == pytest.approx(1)
    assert one(spark, V.cosine(V.literal([0, 0]), V.literal([1, 1]))) == 0
    assert one(spark, V.normalize(V.literal([3, 4]))) == [0.6, 0.8]
    assert one(spark, V.normalize(V.literal([0, 0]))) == [0, 0]


def test_validity(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([1.0, None],), ([1.0, float("nan")],), ([1.0, float("inf")],), (None,)], "v array<double>")
    assert [r.x for r in df.select(V.is_valid("v", 2).alias("x")).collect()] == [True, False, False, False, False, False]
    for bad in ([1, float("nan")], "x", [1, "2"], [1, True]):
        with pytest.raises(InvalidVectorError):
            search.check_vector(bad, 2)
    with pytest.raises(VectorDimensionError):
        search.check_vector([1], 2)


@pytest.mark.parametrize(
    "where, ids",
    [({"role": "admin"}, "ac"), ({"role": "admin", "active": True}, "a"), ({"score": 50}, "b"), ({"score": "50"}, ""), ({"active": 1}, ""), ({"role": None}, "d"),
     ({"nosuch": None}, "abcd"), ({"nosuch": 1}, ""), ({}, "abcd"), ("score >= 75", "ac"), (lambda df: df["score"] < 75, "b"), (lambda df: F.lit(False), ""), (None, "abcd")],
)
def test_where(spark, where, ids):
    df = spark.createDataFrame([("a", "admin", True, 100), ("b", "user", True, 50), ("c", "admin", False, 75), ("d", None, None, None)], "id string, role string, active boolean, score bigint")
    assert "".join(sorted(r.id for r in df.where(where_column(df, where)).collect())) == ids


@pytest.mark.parametrize(
    "params, ids",
    [({"active": "true"}, "ab"), ({"score": "50"}, "b"), ({"score": "50.0"}, "b"), ({"role": "true"}, ""), ({"prefix": "a"}, "a"), ({"limit": "3", "q": "zz", "role": "admin"}, "ac"), ({"nosuch": "1"}, ""), ({"score": ""}, "")],
)
def test_parameters(spark, params, ids):
    df = spark.createDataFrame([("a", "admin", True, 100), ("b", "user", True, 50), ("c", "admin", False, 75)], "id string, role string, active boolean, score bigint")
    assert "".join(sorted(r.id for r in df.where(parameters_column(df, params)).collect())) == ids


def test_search_metrics_thresholds_and_odd_vectors(spark):
    log = spark.createDataFrame(
        [("a", False, 1, 1, [1.0, 0.0, 0.0]), ("b", False, 1, 2, [0.0, 1.0, 0.0]), ("c", False, 1, 3, [0.9, 0.1, 0.0]), ("d", True, 1, 4, None), ("e", False, 1, 5, None), ("f", False, 1, 6, [1.0]), ("z", False, 1, 7, [0.0, 0.0, 0.0])],
        "id string, deleted boolean, ts bigint, ord bigint, vector array<double>",
    )
    q = [1, 0, 0]
    assert [r.id for r in search.search(log, q, 3, 2).collect()] == ["a", "c"]
    assert [(r.id, r.score) for r in search.search(log, q, 3, 2, "euclidean").collect()] == [("a", 0.0), ("c", 0.141421)]
    assert [r.id for r in search.search(log, q, 3, None, "dotProduct", threshold=0.9).collect()] == ["a", "c"]
    assert [r.id for r in search.search(log, q, 3, None, threshold=1.0).collect()] == ["a"]
    assert [r.id for r in search.search(log, q, 3, 10, "euclidean", threshold=1.0).collect()] == ["a", "c", "z"]
    assert search.search(log, q, 3, 0).count() == 0
    assert "vector" not in search.search(log, q, 3).columns and "vector" in search.search(log, q, 3, include_vector=True).columns
    with pytest.raises(VectorDimensionError):
        search.search(log, [1, 0], 3)
    many = search.search_many(log.where("not deleted"), spark.createDataFrame([("q", [1.0, 0.0, 0.0]), ("bad", [1.0])], "query_id string, query array<double>"), 3, 2)
    assert sorted((r.query_id, r.id, r["rank"]) for r in many.collect()) == [("q", "a", 1), ("q", "c", 2)]


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dotProduct"])
def test_many_searches_by_blocks_equal_brute_force(spark, metric):
    import random

    r = random.Random(5)
    docs = [(f"d{i:03d}", [r.choice([0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(150)] + [("null", None), ("short", [1.0]), (None, [1.0, 1.0, 1.0])]
    asked = [(f"q{i}", [r.choice([0.0, 1.0]) for _ in range(3)]) for i in range(9)] + [("zero", [0.0] * 3), ("bad", None)]
    df = spark.createDataFrame([(*d, 1, 1.0) for d in docs], "id string, vector array<double>, block int, score double")
    got = search.search_many(df, spark.createDataFrame(asked, "query_id string, query array<double>"), 3, 7, metric, block_rows=20)

    def score(a, b):
        dot = sum(x * y for x, y in zip(a, b))
        if metric == "euclidean":
            return round(sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5, 6)
        norms = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return dot if metric == "dotProduct" else round(dot / norms, 6) if norms else 0.0

    want = set()
    for q, v in asked:
        if v is not None:
            best = sorted(((score(v, x) * (1 if metric == "euclidean" else -1), i) for i, x in docs if i and x and len(x) == 3))[:7]
            want |= {(q, i, n + 1) for n, (_, i) in enumerate(best)}
    assert {(x.query_id, x.id, x["rank"]) for x in got.collect()} == want
    assert search.search_many(df.limit(0), spark.createDataFrame(asked, "query_id string, query array<double>"), 3).count() == 0
